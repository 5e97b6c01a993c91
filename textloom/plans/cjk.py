"""Queries over inline rows for the filters of Chinese, Japanese and Korean, which the tables have no text for.

A query's rows are (case_id, input) of CASES; what they have to give stands beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chinese, japanese

#: Query -> expression, and its inputs with their results.
CASES: dict[str, tuple[Callable[[Column], Column], dict[str, str]]] = {
    "cjk_width": (japanese.width, {"Ｔｅｓｔ１２": "Test12", "ｶﾞｷﾞｸﾞ": "ガギグ", "ﾊﾟﾋﾟ": "パピ", "ｱｲｳﾞ": "アイヴ", "漢字": "漢字", "！＃": "!#"}),
    "cjk_iteration_marks": (japanese.expand_iteration_marks, {"時々": "時時", "馬鹿々々しい": "馬鹿馬鹿しい", "こゝろ": "こころ", "みすゞ": "みすず", "スヾキ": "スズキ", "々": "々"}),
    "cjk_number_japanese": (japanese.normalize_number, {"十二": "12", "三億五千万": "350000000", "１２．５": "12.5", "3.2兆": "3200000000000", "〇〇七": "7", "本": "本"}),
    "cjk_number_korean": (lambda t: japanese.normalize_number(t, japanese.KOREAN), {"십이": "12", "천이백": "1200", "３억": "300000000", "육천만": "60000000", "바다": "바다"}),
    "cjk_hepburn": (japanese.romanize, {"トウキョウ": "tōkyō", "キャッシュ": "kyasshu", "テンプラ": "tempura", "カンイ": "kan'i", "マッチ": "matchi", "ヴァイオリン": "vaiorin", "日本": "日本"}),
    "cjk_hiragana_uppercase": (japanese.hiragana_uppercase, {"ちょっと": "ちよつと", "ぁぃぅ": "あいう", "カタ": "カタ"}),
    "cjk_katakana_uppercase": (japanese.katakana_uppercase, {"ストップウォッチ": "ストツプウオツチ", "ㇷ゚": "プ", "かな": "かな"}),
    "cjk_katakana_stem": (japanese.katakana_stem, {"パーティー": "パーティ", "タクシー": "タクシ", "コピー": "コピー", "明後日": "明後日"}),
    "cjk_lowercase": (japanese.lowercase, {"ABCdef": "abcdef", "İstanbul": "istanbul", "ΣΊΣΥΦΟΣ": "σίσυφοσ", "ＡＢＣ": "ａｂｃ"}),
    "cjk_chinese_normalize": (chinese.normalize, {"ＡＢＣ": "abc", "１２３": "123", "Hello": "hello", "中国": "中国"}),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f, rows = CASES[name]
        schema = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("input", T.StringType())])
        df = spark.createDataFrame(list(enumerate(rows)), schema)
        return df.select("case_id", "input", f(F.col("input")).alias("output"))

    return run


def _sql(name: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(CASES[name][1].items()))
    return f"SELECT case_id::BIGINT AS case_id, input, output FROM (VALUES {rows}) AS t(case_id, input, output)"


QUERIES = {name: _query(name) for name in CASES}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(name) for name in CASES}

"""Japanese and Korean filters without a dictionary."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import japanese as ja


@pytest.mark.parametrize("text,want", [("ＡＢＣ１２", "ABC12"), ("ﾊﾟﾋﾟﾌﾞ", "パピブ"), ("ｱﾞ", "ア゙"), ("ｳﾞ", "ヴ"), ("ﾞｶ", "゙カ"), ("plain", "plain"), ("", "")])
def test_width(text, want):
    out, at = ja.cjk_width(text)
    assert out == want and len(at) == len(out) + 1 and at[-1] == len(text)


@pytest.mark.parametrize("text,want", [("時々", "時時"), ("馬鹿々々しい", "馬鹿馬鹿しい"), ("ところゞゝゝ", "ところどころ"), ("みすゞ", "みすず"), ("じゝ", "じし"), ("々", "々"), ("あ。々", "あ。々"), ("バナヽ", "バナナ")])
def test_iteration_marks(text, want):
    assert ja.iteration_marks(text) == want


@pytest.mark.parametrize("text,want", [("七百", "700"), ("３億5千", "300005000"), ("1,234.50", "1234.5"), ("一〇〇", "100"), ("万", "10000"), ("1.2.3", "1.2.3"), ("0.10", "0.1"), ("垓", "1" + "0" * 20), ("2万5千", "25000")])
def test_numbers(text, want):
    assert ja.JAPANESE.normalize(text) == want


def test_korean_numbers():
    assert ja.KOREAN.normalize("이천십오") == "2015"


def tokens(*texts, inc=None):
    out, at = [], 0
    for i, t in enumerate(texts):
        out.append({"text": t, "position_increment": 1 if inc is None else inc[i], "position_length": 1, "byte_start": at, "byte_end": at + len(t.encode())})
        at += len(t.encode())
    return out


def test_number_filter():
    got = ja.number(tokens("価格", "三", "千", "円", "2", ",", "5", "x"))
    assert [(t["text"], t["byte_start"], t["byte_end"]) for t in got] == [("価格", 0, 6), ("3000", 6, 12), ("円", 12, 15), ("25", 15, 18), ("x", 18, 19)]
    assert [t["text"] for t in ja.number(tokens("1", "2"))] == ["12"]


def test_dropping_keeps_positions():
    got = ja.stop(tokens("a", "The", "of", "b"), frozenset({"the", "of"}))
    assert [(t["text"], t["position_increment"]) for t in got] == [("a", 1), ("b", 3)]
    tagged = [{**t, "part_of_speech": p} for t, p in zip(tokens("a", "b", "c"), ("助詞", "名詞", None), strict=True)]
    assert [t["text"] for t in ja.part_of_speech_stop(tagged, frozenset({"助詞"}))] == ["b", "c"]
    assert [t["text"] for t in ja.reading_form([{"text": "ひら", "reading": None}, {"text": "漢", "reading": "カン"}])] == ["ヒラ", "カン"]


def test_columns(spark):
    df = spark.createDataFrame([("ちょっとゃ", "ァㇷ゚ー", "コーヒー", "İΣA"), (None, None, None, None)], "a string, b string, c string, d string")
    r = df.select(ja.hiragana_uppercase(F.col("a")), ja.katakana_uppercase(F.col("b")), ja.katakana_stem(F.col("c")), ja.lowercase(F.col("d")), ja.width(F.lit("ﾊﾟ")), ja.expand_iteration_marks(F.lit("時々")), ja.normalize_number(F.lit("二十"))).collect()
    assert tuple(r[0]) == ("ちよつとや", "アプー", "コーヒ", "iσa", "パ", "時時", "20") and tuple(r[1])[:4] == (None,) * 4


TABLE = ja.keystroke_table(["# comment", "シ,si,shi", "ン,n,nn", "カ,ka", "シャ,sha,sya,", "ッカ,kka"])


@pytest.mark.parametrize("text,want", [("シン", ["sin", "shin", "sinn", "shinn"]), ("シャ", ["sha", "sya"]), ("カx", ["kax"]), ("xカ", []), ("", []), ("ッカ", ["kka"])])
def test_keystrokes(text, want):
    assert ja.keystrokes(text, TABLE) == want


def test_completion():
    t = [{**x, "reading": r} for x, r in zip(tokens("下", "か", "か", "k"), ("シ", None, None, None), strict=True)]
    assert [(x["text"], x["position_increment"]) for x in ja.completion(t, TABLE)] == [("下", 1), ("si", 0), ("shi", 0), ("か", 1), ("ka", 0), ("か", 1), ("ka", 0), ("k", 1)]
    assert [x["text"] for x in ja.completion(t, TABLE, query=True)] == ["下", "si", "shi", "かかk", "kakak"]

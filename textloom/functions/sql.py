"""Registration of the functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.analyzer import TOKEN, Analyzer
from ..operators.japanese import JAPANESE, cjk_width, iteration_marks
from . import features, segment


def _mapped(f):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register every function under its name (with a prefix, if given); the names.

    word_breaks, sentence_breaks, analyze, analyze_english, element_similarity, field_match, iteration_marks,
    cjk_width, normalize_number, and as SQL expressions legacy_significance, element_completeness.
    """
    default, english = Analyzer(), Analyzer(stemming=True, remove_stopwords=True, ascii_folding=True)
    strings, ints = T.StringType(), T.ArrayType(T.IntegerType())

    def lists(analyzer: Analyzer):
        return lambda t: [dict(zip(TOKEN.names, x, strict=True)) for x in analyzer.analyze([t])]

    one = {
        "word_breaks": (ints, lambda t: segment.to_bytes(t, segment.word_boundaries(t))),
        "sentence_breaks": (ints, lambda t: segment.to_bytes(t, segment.sentence_boundaries(t))),
        "analyze": (T.ArrayType(TOKEN), lists(default)),
        "analyze_english": (T.ArrayType(TOKEN), lists(english)),
        "iteration_marks": (strings, iteration_marks),
        "cjk_width": (strings, lambda t: cjk_width(t)[0]),
        "normalize_number": (strings, JAPANESE.normalize),
    }
    for name, (kind, f) in one.items():
        spark.udf.register(prefix + name, F.pandas_udf(_mapped(f), kind))
    spark.udf.register(prefix + "element_similarity", features._similarity_udf)
    spark.udf.register(prefix + "field_match", features._field_match_udf)
    top = "ln(1000000D)"
    share = "greatest(1D, least(1000000D, df * 1000000D / n))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}legacy_significance(df BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN 0.5D + 0.5D * (({top} - ln({share})) / {top}) ELSE 0.5D END")
    hit = "size(filter(q, t -> array_contains(d, t)))"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}element_completeness(q ARRAY<STRING>, d ARRAY<STRING>) RETURNS DOUBLE "
        f"RETURN CASE WHEN size(q) > 0 AND size(d) > 0 THEN 0.5D * least({hit}, size(d)) / size(d) + 0.5D * {hit} / size(q) ELSE 0D END"
    )
    return [prefix + n for n in (*one, "element_similarity", "field_match", "legacy_significance", "element_completeness")]

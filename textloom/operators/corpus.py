"""Statistics of terms over a corpus, for the significance features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analyzer import exploded


def term_stats(docs: DataFrame, terms: str) -> DataFrame:
    """(term, document_frequency, term_frequency) of an array column of terms, a row being a document.

    A row's terms are sorted within the row, so that the first of each can be told from its repeats and one shuffle,
    of partial sums by term, gives both counts.
    """
    by_term = docs.select(F.sort_array(terms).alias("w"))
    first = by_term.select(F.transform("w", lambda t, i: F.struct(t.alias("term"), F.when(F.get("w", i - 1) == t, 0).otherwise(1).alias("first"))).alias("w"))
    return exploded(first, "w", "t").groupBy("t.term").agg(F.sum("t.first").alias("document_frequency"), F.count(F.lit(1)).alias("term_frequency"))


def with_document_count(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """stats with document_count, the number of rows of docs: one row, broadcast."""
    n = docs.agg(F.count(F.lit(1)).alias("document_count"))
    return stats.join(F.broadcast(n), F.lit(True))

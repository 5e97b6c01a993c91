"""The same columns on streams: analysis keeps no state between rows, term counts keep one row per term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyzer import Analyzer


def read_texts(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def analyze_stream(docs: DataFrame, analyzer: Analyzer, text: str = "text") -> DataFrame:
    """docs with a ``tokens`` column; stateless, for append mode."""
    return docs.withColumn("tokens", analyzer.tokens(F.col(text)))


def windowed_term_counts(docs: DataFrame, analyzer: Analyzer, time: str, window: str, late: str, text: str = "text") -> DataFrame:
    """Counts of terms by event-time window; rows later than ``late`` are left out and state is dropped."""
    terms = docs.withWatermark(time, late).select(time, F.explode(analyzer.terms(F.col(text))).alias("term"))
    return terms.groupBy(F.window(time, window), "term").agg(F.count(F.lit(1)).alias("n"))

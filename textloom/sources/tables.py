"""Reading text tables: Parquet, and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Session setting: partitions that a table is dealt over when it is read; unset: as its files are split. For tables of
#: fewer row groups than cores, where the one who runs the session knows them to be so.
PARTITIONS = "spark.textloom.read.partitions"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    partitions = spark.conf.get(PARTITIONS, None)
    return df.repartition(int(partitions)) if partitions else df


def texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """The text column of Parquet files; nothing else is read."""
    return spark.read.parquet(path).select(F.col(column).alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    r"""One text per line, with the escapes \\ \n \r \t and \u{hex} undone."""
    t = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("text"))
    return t.select(unescaped(F.col("text")).alias("text"))


def unescaped(text: Column) -> Column:
    """A text with its escapes undone: cut into escapes and what is between, each of which has one meaning."""
    parts = F.regexp_extract_all(text, F.lit(r"\\u\{[0-9a-fA-F]+\}|\\.|[^\\]+|\\"), F.lit(0))
    code = lambda x: F.decode(F.unhex(F.lpad(F.regexp_extract(x, r"\{([0-9a-fA-F]+)\}", 1), 8, "0")), "UTF-32BE")
    one = lambda x: F.when(x == "\\n", "\n").when(x == "\\r", "\r").when(x == "\\t", "\t").when(x == "\\\\", "\\").when(x.startswith("\\u{"), code(x)).otherwise(x)
    return F.array_join(F.transform(parts, one), "")

"""What the operators of this subpackage share: word rule, tables, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but U+0020 and U+0009 to U+000D.
SPACE = r"[ \t\n\x0B\f\r]"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where none is set one is made for a local master (tests);
    on a cluster that is an error, as no folder of this machine is shared."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while an operator runs inside temporary(): long texts make batches of fewer rows, so that a
#: worker's memory does not follow their length.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Tables written since each temporary() that is open began, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, whether it ends well or not. Inside, Arrow batches
    are of BATCH_BYTES; the session's own setting is back at the end."""
    mine: list[str] = []
    token = _open.set((*_open.get(), mine))
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)
        _open.reset(token)
        for path in mine:
            remove(spark, path)


def materialize(df: DataFrame, what: str, codec: str = "zstd", result: bool = False) -> DataFrame:
    """Cut lineage through a written table in the shared folder; a lost executor loses none of it.

    The table lasts as long as the temporary() around it, and a ``result`` as long as the one around that.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    around = _open.get()[:-1] if result else _open.get()
    if around:
        around[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def n_words(text: Column) -> Column:
    """Number of words (null: 0) without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")

"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

``targets``: sources ordered by code point, null last, get weights 1, 2, 3, 1, ... and share the
total size; a target stops at ``max_repeat`` times its source's size and the excess is reshared by
weight until none is above. The fixed point is found in closed form: ordered by cap / weight, the
capped sources are a prefix, so one running sum over the (few) source rows finds the level.

``mix``: the prefix sum of expected copies runs over a source's documents, the largest first; one offset per
source, drawn by hash from the seed, shifts it; a document is taken once per integer the shifted sum crosses
in it. Expected copies are target / size of the source for its largest documents. Documents of whom one is
less than a part of the target (LEVELS) come after these and share what is left of it: their expected copies are
what the larger ones left over of the target, for their size. On average over offsets that is the same rate for
all (but where it would be below 0 or above ``max_repeat``), and the taken words miss the target by no more
than about the last level's part of it, wherever documents that small can make up for it. Choosing among offsets
by nearness would do that too, but leave out a very long document of a small source, or take it, whatever the seed.
The rank behind the prefix sum is put together from counts by (source, size), counts by hash bucket
within one size, and a row number within a bucket; no task holds a whole source, and buckets
multiply with the count, so a hot source or a hot size is spread.

Defined results: null text has size 0; a null source is a source of its own; size-0 documents get
copies like others and take 0 words; equal (source, size, doc_id) rows are interchangeable, so reruns
agree as multisets; null doc_ids sort first; an empty table gives an empty mix; other columns pass
through ``mix`` (helper columns use a ``__m_`` prefix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import n_words, table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 20240607
#: Documents of one source and size to a bucket, on average; a bound on a window's rows, not on the data.
BUCKET_ROWS = 256
#: Documents larger than a 4th of the target come first, then those larger than a 16th, and so on, then all others.
LEVELS = (4, 16, 64, 256)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> (source, source_size, target). Windows over source rows only."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(by_name) - 1) % len(weights)
    x = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in weights]), k + 1))
    x = x.withColumn("cap", F.col("source_size") * max_repeat)
    all_rows = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    x = x.withColumns({
        "total": F.sum("source_size").over(all_rows),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open_w": F.sum("w").over(onward),
    })
    x = x.withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open_w"))
    # the first source that its cap does not stop sets the level for itself and all after it
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(all_rows)["level"]
    x = x.withColumn("level", level)
    return x.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce(F.col("level"), F.lit(float("inf")))).alias("target"))


def _offset(source: str, seed: int) -> Column:
    # 20 bits: the sum of a rank's copies and an offset stays exact where copies are whole
    return F.pmod(F.xxhash64(F.coalesce(F.col(source), F.lit("")), F.col(source).isNull(), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def mix(docs: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target and copies (long), one row per document."""
    docs = docs.drop("source_size", "target", "copies")
    out = [F.col(f"d.`{c}`") for c in docs.columns]
    n = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("__m_n"))
    goal = targets(n.groupBy("source").agg(F.sum(F.col("size") * F.col("__m_n")).alias("source_size")), weights, max_repeat)
    n = n.alias("n").join(goal.alias("g"), F.col("n.source").eqNullSafe(F.col("g.source"))).select(
        F.col("n.source").alias("__m_source"), F.col("n.size").alias("__m_size"), "__m_n", "source_size", "target", _offset("n.source", seed).alias("__m_offset")
    )
    n = _planned(n, max_repeat)
    hashed = F.xxhash64(F.col("d.doc_id"), F.lit(seed))
    d = docs.alias("d").join(n.alias("n"), F.col("d.source").eqNullSafe(F.col("n.__m_source")) & (F.col("d.size") == F.col("n.__m_size")))
    d = d.select(
        *out, "source_size", "target", "__m_n", "__m_start", "__m_rate", "__m_offset",
        F.pmod(hashed, F.ceil(F.col("__m_n") / bucket_rows)).alias("__m_bucket"),
    )
    one = ["source", "size", "__m_bucket"]
    counts = d.groupBy(*one).agg(F.count(F.lit(1)).alias("__m_k"))
    counts = counts.withColumn("__m_k", F.coalesce(F.sum("__m_k").over(W.partitionBy("source", "size").orderBy("__m_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = d.withColumn("__m_row", F.row_number().over(W.partitionBy(*one).orderBy("doc_id")))
    c = counts.alias("c")
    r = ranked.alias("d").join(
        c, F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")) & (F.col("d.__m_bucket") == F.col("c.__m_bucket"))
    )
    rank = F.col("c.__m_k") + F.col("d.__m_row")
    crossed = _crossed("d.__m_start", rank, "d.__m_rate", "d.__m_offset") - _crossed("d.__m_start", rank - 1, "d.__m_rate", "d.__m_offset")
    return r.select(*out, F.col("d.source_size"), F.col("d.target"), F.least(crossed, F.lit(max_repeat)).cast("long").alias("copies"))


def _crossed(start: str, k: Column, rate: str, offset: str) -> Column:
    """Integers up to the shifted prefix sum at the kth document of a size."""
    return F.floor(F.col(start) + k * F.col(rate) + F.col(offset))


def _planned(n: DataFrame, max_repeat: int) -> DataFrame:
    """Rows of (source, size) with the prefix sum __m_start before their documents and the rate __m_rate of each.

    Windows run over a source's distinct sizes, not over its documents.
    """
    level = F.lit(len(LEVELS))
    for i, part in reversed(list(enumerate(LEVELS))):
        level = F.when(F.col("__m_size") * part > F.col("target"), i).otherwise(level)
    whole = W.partitionBy("__m_source")
    larger = whole.orderBy(F.desc("__m_size")).rowsBetween(W.unboundedPreceding, -1)
    words = F.col("__m_size") * F.col("__m_n")
    n = n.withColumn("__m_level", level).withColumn("__m_before", F.coalesce(F.sum("__m_n").over(larger), F.lit(0)))
    zero = F.lit(0.0)
    n = n.withColumns({"__m_start": zero, "__m_rate": zero, "__m_sum": zero, "__m_taken": F.lit(0).cast("long"), "__m_done": F.lit(0).cast("long"), "__m_left": F.col("source_size")})
    for i in range(len(LEVELS) + 1):
        mine = F.col("__m_level") == i
        rate = F.when(F.col("__m_left") > 0, F.greatest(zero, F.least(F.lit(float(max_repeat)), (F.col("target") - F.col("__m_taken")) / F.col("__m_left")))).otherwise(zero)
        n = n.withColumn("__m_rate", F.when(mine, rate).otherwise(F.col("__m_rate")))
        n = n.withColumn("__m_start", F.when(mine, F.col("__m_sum") + (F.col("__m_before") - F.col("__m_done")) * F.col("__m_rate")).otherwise(F.col("__m_start")))
        copies = _crossed("__m_start", F.col("__m_n"), "__m_rate", "__m_offset") - _crossed("__m_start", F.lit(0), "__m_rate", "__m_offset")
        own = lambda c, mine=mine: F.coalesce(F.sum(F.when(mine, c)).over(whole), F.lit(0))
        n = n.withColumns({
            "__m_sum": F.col("__m_sum") + own(F.col("__m_n") * F.col("__m_rate")), "__m_taken": F.col("__m_taken") + own(F.col("__m_size") * copies),
            "__m_done": F.col("__m_done") + own(F.col("__m_n")), "__m_left": F.col("__m_left") - own(words),
        })
    return n.select("__m_source", "__m_size", "__m_n", "source_size", "target", "__m_start", "__m_rate", "__m_offset")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(d).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL: dict[str, str] = {}

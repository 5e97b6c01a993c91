"""Exact top-k by distributed histogram selection.

All candidates are scored against a block of queries on the executors, several times, and scores never
leave them. Each pass counts the scores of every query into BINS equal bins of the query's current
interval; the counts, summed over all candidates, name the bin that holds its kth highest score, which
is the next interval. When an interval is one score wide, the kth value is exact, and the last pass
emits what lies above it, and of the ties at it the smallest ids, as many as are left to fill.
A task sends BINS counts per query, then at most k rows per query: never one row per pair.

Queries go in blocks of at most BLOCK, each broadcast (BLOCK x dimensions x 8 bytes, a fixed bound)
against all candidates; the driver holds three numbers per query of one block. There is no cap on
candidates, and ties of any number are broken by the smaller id.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, as
queries or candidates, nor do rows with a null id; a vector of another length than the query's is not
its candidate; a candidate with the query's own id is the query's own row; queries with the same id and
vector are one query; repeated candidate rows each count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize, table

BLOCK = 4096
BINS = 256
#: Scores of this many pairs are in memory at once.
PAIRS = 4_000_000


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length dim as int64, and their places."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    places = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(places)).flatten()
    return np.asarray(flat, np.int64).reshape(-1, dim), places


def _scores(batches: Iterator[pa.RecordBatch], qs: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores, allowed) of chunks; scores and allowed are candidates x queries."""
    q = qs.astype(np.float64).T
    step = max(1, PAIRS // max(1, len(ids)))
    for batch in batches:
        m, places = _matrix(batch.column("vector"), qs.shape[1])
        own = np.asarray(batch.column("id"))[places]
        for i in range(0, len(m), step):
            part = m[i : i + step]
            # doubles are exact for sums below 2^53; larger components go the slow, exact way
            small = np.abs(part).max(initial=0) * float(np.abs(qs).max(initial=0)) * qs.shape[1] < 2.0**53
            s = (part.astype(np.float64) @ q).astype(np.int64) if small else part @ qs.T
            c = own[i : i + step]
            yield c, s, c[:, None] != ids[None, :]


def _count(batches, qs, ids, low, width, span) -> Iterator[pa.RecordBatch]:
    """Counts above each query's interval and per bin of it: one row per query."""
    n = len(ids)
    hist = np.zeros(n * (BINS + 2), np.int64)
    base = np.arange(n, dtype=np.int64) * (BINS + 2)
    some = False
    for _, s, allowed in _scores(batches, qs, ids):
        some = True
        up = s - low
        b = np.where(up >= span, BINS, np.maximum(up // width, -1)) + 1
        hist += np.bincount((b + base)[allowed], minlength=len(hist))
    if some:
        rows = hist.reshape(n, -1)
        flat = pa.array(rows.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, BINS + 2, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), lists], names=["q", "hist"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of each query as they come; a block's queries bound the memory."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        rows = np.asarray(batch.column("hist").flatten(), np.int64).reshape(-1, BINS + 2)
        for q, r in zip(batch.column("q").to_pylist(), rows, strict=True):
            total[q] = total[q] + r if q in total else r.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tolist() for r in total.values()], pa.list_(pa.int64()))], names=["q", "hist"])


def _emit(batches, qs, ids, kth, ties) -> Iterator[pa.RecordBatch]:
    """Rows above a query's kth score, and of its ties the smallest ids of this task, ``ties`` at most."""
    above: list[tuple[np.ndarray, ...]] = []
    tied: dict[int, np.ndarray] = {}
    for c, s, allowed in _scores(batches, qs, ids):
        i, q = np.nonzero((s > kth) & allowed)
        above.append((q, c[i], s[i, q]))
        for j in np.flatnonzero((((s == kth) & allowed).any(axis=0)) & (ties > 0)):
            mine = c[(s[:, j] == kth[j]) & allowed[:, j]]
            tied[j] = np.sort(np.concatenate([tied.get(j, mine[:0]), mine]))[: ties[j]]
    for j, c in tied.items():
        above.append((np.full(len(c), j), c, np.full(len(c), kth[j])))
    if above:
        q, c, s = (np.concatenate(x) for x in zip(*above, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(c.astype(np.int64)), pa.array(s.astype(np.int64))], names=["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """vectors and queries (id long, vector array<long>, no nulls) -> query_id, rank, id, score."""
    spark = vectors.sparkSession
    queries = queries.distinct()
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    largest = vectors.agg(F.max(norm)).first()[0] or 0.0
    by_dim = queries.groupBy(F.size("vector").alias("dim")).count().collect()  # one row per vector length
    parts: list[DataFrame] = []
    for dim, n in sorted((r[0], r[1]) for r in by_dim):
        # dealt by hash to slices of two thirds of a block; one that is more than a block by chance makes two
        slices = -(-3 * n // (2 * block))
        own = queries.where(F.size("vector") == dim).withColumn("slice", F.pmod(F.xxhash64("id", "vector"), F.lit(slices)))
        for i in range(slices):
            q = own.where(F.col("slice") == i).orderBy("id", "vector").toArrow()
            if not q.num_rows:
                continue
            qs, _ = _matrix(q.column("vector").combine_chunks(), dim)
            ids = np.asarray(q.column("id"), np.int64)
            parts += [_block(spark, vectors, qs[j : j + block], ids[j : j + block], k, largest) for j in range(0, len(ids), block)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _block(spark: SparkSession, vectors: DataFrame, qs: np.ndarray, ids: np.ndarray, k: int, largest: float) -> DataFrame:
    bq = spark.sparkContext.broadcast((qs, ids))
    # |score| is at most the product of the norms
    bound = np.ceil(np.sqrt((qs.astype(np.float64) ** 2).sum(axis=1) * largest)).astype(np.int64) + 1
    low, span = -bound, 2 * bound + 1
    width = np.maximum(1, -(-span // BINS))
    need = np.full(len(ids), k, np.int64)  # of what is still inside the interval
    full = np.zeros(len(ids), bool)  # fewer candidates than k: all of them count
    first = True
    while first or (width > 1).any():
        if not first:
            span, width = width, np.maximum(1, -(-width // BINS))
        b = spark.sparkContext.broadcast((low, width, span))
        counted = vectors.mapInArrow(lambda x: _count(x, *bq.value, *b.value), "q int, hist array<long>")
        sums = counted.repartition("q").mapInArrow(_add, "q int, hist array<long>").toArrow()
        hist = np.zeros((len(ids), BINS + 2), np.int64)
        if sums.num_rows:
            rows = np.asarray(sums.column("hist").combine_chunks().flatten(), np.int64).reshape(-1, BINS + 2)
            hist[np.asarray(sums.column("q"))] = rows
        if first:
            full = hist.sum(axis=1) <= k
        down = np.cumsum(hist[:, -2:0:-1], axis=1)  # from the highest bin; what lies above the interval is done with
        hit = (down >= need[:, None]).argmax(axis=1)
        at = np.arange(len(ids))
        need = np.where(full, need, need - np.where(hit > 0, down[at, hit - 1], 0))
        low = np.where(full, low, low + (BINS - 1 - hit) * width)
        first = False
    kth = np.where(full, -bound - 1, low)
    ties = np.where(full, 0, need)
    bk = spark.sparkContext.broadcast((kth, ties))
    return vectors.mapInArrow(lambda x: _emit(x, *bq.value, *bk.value), "query_id long, id long, score long")


def quantized(df: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, vector) with components floor(scale * x), x as double; rows that take no part are left out."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = materialize(quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    out = top_k(v, v.where(F.col("id") % 50 == 0), 5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

QUERIES = {"op5_topk": op5_topk}
ORACLE_SQL = {"op5_topk": ORACLE}

"""Language ID by rank-order profiles of character n-grams.

A text is lowered, every run of non-letters becomes one space, and its 1- to 3-grams of code points are
counted, whole text. A profile is the ``PROFILE`` most frequent n-grams in rank order, ties to the
smaller code. The distance of a text to a language sums, over the text's own most frequent n-grams, how
far out of place each is in the language's profile, a missing one counting PROFILE. The nearest
language wins, ties to the smaller name; the score is 1 - distance / greatest possible distance.

Profiles are fitted on labelled rows, at most SAMPLE of each language (those with the smallest id
hashes): a documented bound on training alone. Counting them is distributed; the driver holds the
profiles, whose size is languages x PROFILE, not a function of the corpus.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any training
row every text is ``und``; rows with a null language don't train; a null id counts as not held out;
repeated rows each get a row; extra columns are ignored; an empty table gives an empty result. Very
long texts are counted in one array of three codes per character.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table

PROFILE = 300
SAMPLE = 2000
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower case if a letter (first code point of it), else a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's 1- to 3-grams, codes ascending; both empty if it has no letter."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = points != 32
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep[1:] |= points[:-1] != 32  # one space after each run of letters
    x = points[keep].astype(np.int64)
    x = np.concatenate([[32], x, [32]]) if x[-1] != 32 else np.concatenate([[32], x])
    two = x[:-1] << 21 | x[1:]
    three = two[:-1] << 21 | x[2:]
    every = np.concatenate([x[x != 32], two, three])
    every.sort()
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[starts], np.diff(np.append(starts, len(every)))


def top(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent codes by rank."""
    if len(codes) > 4 * n:  # all that tie with the nth stay in
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:n]]


class Model:
    """Profiles of all languages as one table: gram code x language -> rank, PROFILE where absent."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), size, np.int32)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return UND, 0.0
        codes, counts = grams(text)
        if not len(codes):
            return UND, 0.0
        own = top(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == own, at, len(self.codes))
        ranks = self.ranks[at]
        off = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        off[ranks == self.size] = self.size
        d = off.sum(axis=0)
        j = int(d.argmin())
        return self.names[j], 1.0 - float(d[j]) / (self.size * len(own))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            mine = total.setdefault(lang, {})
            codes, counts = grams(text or "")
            for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                mine[c] = mine.get(c, 0) + n
    for lang, mine in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["lang", "code", "n"])


def fit(labelled: DataFrame, id_col: str = "doc_id", size: int = PROFILE, sample: int = SAMPLE) -> Model:
    """A model of labelled(id, lang, text): at most ``sample`` rows a language, chosen by the hash of their id."""
    keys = labelled.select(id_col, "lang").where(F.col("lang").isNotNull() & F.col(id_col).isNotNull()).distinct()
    h = F.xxhash64(F.col(id_col))
    # a share of the hash range that holds about twice the sample is enough for the ranking; rare languages keep all
    counts = F.broadcast(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))  # a row per language
    share = F.least(F.lit(1.0), F.lit(2.0 * sample + 100) / F.col("n"))
    near = keys.join(counts, "lang").where(F.pmod(h, F.lit(1_000_000)) < share * 1_000_000).drop("n")
    chosen = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(h, id_col))).where(F.col("r") <= sample).drop("r")
    rows = labelled.join(F.broadcast(chosen), [id_col, "lang"], "left_semi").select("lang", "text")
    grams_of = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = grams_of.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= size)
    profiles: dict[str, list[int]] = {}
    for lang, code in ranked.orderBy("lang", "r").select("lang", "code").collect():
        profiles.setdefault(lang, []).append(code)
    return Model(profiles, size)


def _predict(batches: Iterator[pa.RecordBatch], names: list[str], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [model.predict(v.as_py()) for v in batch.column("text")]
        new = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    names = [c for c in keep if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    model_b = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(lambda b: _predict(b, names, model_b.value), schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}

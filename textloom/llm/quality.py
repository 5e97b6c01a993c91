"""Quality rules as a bitmask ledger: every rule runs once, policies are masks over its bits.

``ledger`` appends the measurements and one long ``fail_bits``: bit i is set where rule i fails.
A policy is a versioned mask over these bits, so changing a policy, comparing policies and ablating
a rule never measures a text again: they are bitwise operations on ``fail_bits``.

Defined results: a null text counts as empty (no words: fails ``few_words`` alone); repeated rows
each get their own row; an empty table gives an empty ledger; other columns pass through, and where
one has the name of a measurement the measurement replaces it. Everything is built of DataFrame
functions: no Python runs on executors, nothing is shuffled, memory is one text's words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NOT_SPACE, SPACE, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

#: Rule name -> condition over the measurements under which a text fails; bit i is the i-th rule.
#: Written without division, so no ratio of an empty text is taken.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "duplicate_lines": lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"],
    "word_length": lambda m: (m["n_words"] > 0) & ((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    "upper_case": lambda m: 2 * m["n_upper"] > m["word_chars"],
}
RULES_VERSION = 1


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(RULES))
POLICIES = (BASE, STANDARD)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is mentioned and wherever a filter moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    zero = F.lit(0).cast("long")
    # 64 bits tell the windows of one text apart
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))

    def places(s: Column) -> Column:
        flagged = F.transform(s, lambda x, k: F.when(same(x, F.get(s, k + 1)) | ((k > 0) & same(x, F.get(s, k - 1))), x["i"]).otherwise(F.lit(-1)))
        return F.sort_array(F.filter(flagged, lambda i: i >= 0))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x)), zero, lambda a, x: a + x)

    def count(h: Column) -> Column:
        # only texts in which a window repeats sort their windows
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(pairs, lambda s: _let(places(s), covered))).otherwise(zero)

    return F.when(F.size(w) >= 3, _let(windows, count)).otherwise(zero)


def measurements(text: Column) -> Column:
    """A struct of MEASURES and ``fail_bits``, all long, of a text."""
    size = lambda c: F.size(c).cast("long")

    def of(t: Column) -> Column:
        words_of = F.filter(F.split(t, SPACE + "+"), lambda x: x != F.lit(""))
        lines_of = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
        return _let(
            F.struct(words_of.alias("w"), lines_of.alias("l")),
            lambda x: F.struct(
                size(x["w"]).alias("n_words"),
                F.aggregate(x["w"], F.lit(0).cast("long"), lambda a, y: a + F.char_length(y)).alias("word_chars"),
                F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                size(x["l"]).alias("n_lines"),
                (size(x["l"]) - size(F.array_distinct(x["l"]))).alias("n_dup_lines"),
                _repeat_words(x["w"]).cast("long").alias("n_repeat_words"),
                F.char_length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
            ),
        )

    return _let(of(F.coalesce(text, F.lit(""))), lambda m: F.struct(*[m[n].alias(n) for n in MEASURES], fail_bits(m).alias("fail_bits")))


def fail_bits(m: Column) -> Column:
    bits = [F.when(c(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its measurements, ``fail_bits`` and the version of the rules that set them."""
    new = (*MEASURES, "fail_bits", "rules_version")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    measured = df.select(*keep, measurements(F.col(f"`{text}`")).alias("__ledger"))
    return measured.select(*keep, "__ledger.*", F.lit(RULES_VERSION).alias("rules_version"))


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(ledger_df: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: rows rejected, rows this rule rejects alone, rows kept without it.

    One aggregation by ``fail_bits`` (at most 2^rules groups, combined before the shuffle) and
    bitwise tests on its few rows; the texts are not measured again.
    """
    groups = ledger_df.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit"))
        for p in policies
        for r in p.rules
    ]
    x = groups.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    rest = F.col("fail_bits").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return x.groupBy("policy", "version", "rule").agg(
        total(hit.bitwiseAND(F.col("bit")) != 0).alias("rejected_by_rule"),
        total(hit == F.col("bit")).alias("rejected_by_rule_alone"),
        total(rest == 0).alias("kept_without_rule"),
        total(hit == 0).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"),
        passes(STANDARD).alias("kept"),
        "fail_bits",
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), i AS (
  SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM s WHERE len(w) >= 3
), g AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS n FROM i
), c AS (
  SELECT rid, count(DISTINCT p + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '\P{Lu}', '', 'g'))::BIGINT AS n_upper
  FROM s LEFT JOIN c USING (rid)
), b AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits
FROM b
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL = {"op1_quality_rules": ORACLE}

"""Queries over the tables, one or more to an operator, and the SQL they equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features, segment
from ..functions.stopwords import LANGUAGES, stop_words
from ..functions.unicode import fold_map
from ..operators import corpus
from ..operators.analyzer import STEMMERS, Analyzer, ascii_fold, exploded, posexploded
from ..sources import tables

#: Query texts of the scoring queries: fixed values.
SEARCHES = ("the and of", "in the ation of the", "der die das und", "de la les", "que el la de")
WHITESPACE = Analyzer(tokenizer="whitespace")


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    return tables.read(spark, sf_dir, name).select(*columns)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents", "doc_id", WHITESPACE.terms(F.col("text")).alias("d"))


def _scored(spark: SparkSession, sf_dir: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, doc_id, s): the score of every document for every search. A document's terms are made once: the searches
    are a constant array, whose scores are exploded."""
    searches = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, q.split())).alias("q")) for i, q in enumerate(SEARCHES)])
    # the terms are bound to a lambda's variable: inlined, they would be made again for every search
    scores = F.transform(F.array("d"), lambda d: F.transform(searches, lambda s: F.struct(s["id"].alias("query_id"), score(s["q"], d).alias("s"))))[0]
    return exploded(_words(spark, sf_dir).select("doc_id", scores.alias("all")), "all", "x").select("x.query_id", "doc_id", "x.s")


def whitespace_tokens(spark, sf_dir):
    d = _read(spark, sf_dir, "documents", "doc_id", Analyzer(tokenizer="whitespace", case_sensitive=True).terms(F.col("text")).alias("w"))
    return posexploded(d, "w", "token")


def token_length_filter(spark, sf_dir):
    d = _read(spark, sf_dir, "documents", "doc_id", Analyzer(tokenizer="whitespace", case_sensitive=True, max_token_length=8).terms(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("kept"))


def lowercase_tokens(spark, sf_dir):
    d = _read(spark, sf_dir, "documents", "doc_id", WHITESPACE.terms(F.col("text")).alias("w"))
    return exploded(d, "w", "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _stopwords(language: str):
    def query(spark, sf_dir):
        d = _read(spark, sf_dir, "documents", "doc_id", WHITESPACE.terms(F.col("text")).alias("w"))
        stops = sorted(stop_words(language))
        kept = F.filter("w", lambda t: ~t.isin(stops))
        return d.select("doc_id", F.size("w").cast("long").alias("n_all"), F.size(kept).cast("long").alias("n_kept"))

    return query


def ascii_fold_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents", "doc_id", ascii_fold(F.col("text")).alias("folded"))


def uax29_words_latin(spark, sf_dir):
    d = _read(spark, sf_dir, "documents", "doc_id", Analyzer(case_sensitive=True).terms(F.col("text")).alias("w"))
    return posexploded(d, "w", "text").withColumn("position", F.col("position").cast("long"))


def word_break_counts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents", "doc_id", segment.word_counts(F.col("text")).alias("s"))
    return d.select("doc_id", *[F.coalesce(f"s.{n}", F.lit(0)).alias(n) for n in segment.COUNTS])


def sentence_counts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents", "doc_id", segment.sentence_breaks(F.col("text")).alias("b"))
    return d.select("doc_id", F.greatest(F.size("b") - 1, F.lit(0)).cast("long").alias("n_sentences"))


def analyze_full(spark, sf_dir):
    full = Analyzer(ascii_folding=True, stemming=True, remove_stopwords=True, max_token_length=40)
    d = _read(spark, sf_dir, "documents", "doc_id", full.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.xxhash64("w").alias("tokens_hash"))


def _stems(language: str):
    """Counts of a language's stems in all documents, by the documents' lang."""

    def query(spark, sf_dir):
        d = tables.read(spark, sf_dir, "documents")
        terms = Analyzer(stemming=True, language=language).terms(F.col("text"))
        return exploded(d.select("lang", terms.alias("w")), "w", "stem").groupBy("lang", "stem").agg(F.count(F.lit(1)).alias("n"))

    return query


def term_stats(spark, sf_dir):
    return corpus.term_stats(_words(spark, sf_dir), "d")


def significance(spark, sf_dir):
    stats = corpus.with_document_count(term_stats(spark, sf_dir), _read(spark, sf_dir, "documents", "doc_id"))
    return stats.select("term", F.round(features.legacy_significance(F.col("document_frequency"), F.col("document_count")), 9).alias("significance"))


def completeness(spark, sf_dir):
    c = _scored(spark, sf_dir, features.element_completeness)
    return c.select("query_id", "doc_id", *[F.round(f"s.{n}", 9).alias(n) for n in ("completeness", "field_completeness", "query_completeness")])


def matches(spark, sf_dir):
    return _scored(spark, sf_dir, features.matches).withColumnRenamed("s", "matches")


def query_term_count(spark, sf_dir):
    d = _read(spark, sf_dir, "benchmark", "item_id", WHITESPACE.terms(F.col("text")).alias("w"))
    return d.select("item_id", features.query_term_count(F.col("w")).alias("query_term_count"))


def _with_positions(terms: Column) -> Column:
    return F.transform(terms, lambda t, i: F.struct(t.alias("text"), i.alias("position")))


def term_match(spark, sf_dir):
    x = _scored(spark, sf_dir, lambda q, d: features.field_term_match(_with_positions(q), _with_positions(d), 1))
    return x.select("query_id", "doc_id", "s.first_position", "s.occurrences")


def _against(spark: SparkSession, sf_dir: str, score: Callable[..., Column], names: tuple[str, ...]) -> DataFrame:
    scores = score(F.col("d"), [q.split() for q in SEARCHES])
    x = exploded(_words(spark, sf_dir).select("doc_id", scores.alias("all")), "all", "x")
    return x.select("x.query_id", "doc_id", *[F.round(f"x.{n}", 9).alias(n) for n in names])


def similarity(spark, sf_dir):
    return _against(spark, sf_dir, features.similarities, features.SIMILARITY)


def field_match(spark, sf_dir):
    return _against(spark, sf_dir, features.field_matches, features.FIELD_MATCH)


def rerank_topk(spark, sf_dir):
    """Ten best documents for each search by completeness; a window limited before the shuffle."""
    c = completeness(spark, sf_dir).select("query_id", "doc_id", "completeness")
    best = W.partitionBy("query_id").orderBy(F.desc("completeness"), "doc_id")
    return c.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 10)


def multi_input_positions(spark, sf_dir):
    """Tokens of conversations: the turns of each as one sequence of inputs, positions going on."""
    c = _read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    tokens = WHITESPACE.tokens(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), many=True)
    x = exploded(turns.select("conv_id", tokens.alias("w")), "w", "t")
    long = lambda n: F.col(f"t.{n}").cast("long").alias(n)
    return x.select("conv_id", long("position"), long("input_index"), "t.text")


def set_operations(spark, sf_dir):
    """Terms by whether the benchmark has them and the documents do: a full join of distinct terms."""
    b = exploded(_read(spark, sf_dir, "benchmark", WHITESPACE.terms(F.col("text")).alias("w")), "w", "term").distinct().withColumn("in_benchmark", F.lit(True))
    d = exploded(_words(spark, sf_dir).select("d"), "d", "term").distinct().withColumn("in_documents", F.lit(True))
    some = b.join(d, "term", "full")
    return some.groupBy(F.coalesce("in_benchmark", F.lit(False)).alias("in_benchmark"), F.coalesce("in_documents", F.lit(False)).alias("in_documents")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "whitespace_tokens": whitespace_tokens,
    "token_length_filter": token_length_filter,
    "lowercase_tokens": lowercase_tokens,
    **{f"stopwords_{x}": _stopwords(x) for x in LANGUAGES},
    "ascii_fold": ascii_fold_text,
    "uax29_words_latin": uax29_words_latin,
    "word_break_counts": word_break_counts,
    "sentence_counts": sentence_counts,
    "analyze_full": analyze_full,
    **{f"stem_{x}": _stems(x) for x in STEMMERS},
    "set_operations": set_operations,
    "term_stats": term_stats,
    "significance": significance,
    "completeness": completeness,
    "matches": matches,
    "query_term_count": query_term_count,
    "term_match": term_match,
    "similarity": similarity,
    "field_match": field_match,
    "rerank_topk": rerank_topk,
    "multi_input_positions": multi_input_positions,
}

# -- SQL ------------------------------------------------------------------------------------------

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOK = f"list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '')"
_LOW = f"list_transform({_TOK}, lambda x: lower(replace(x, 'İ', 'i̇')))"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_quote, words)) + "]"


_S = " UNION ALL ".join(f"SELECT {i} AS query_id, {_list(q.split())} AS q" for i, q in enumerate(SEARCHES))
_BASE = f"WITH s AS ({_S}), d AS (SELECT doc_id, {_LOW} AS d FROM documents), x AS (SELECT * FROM d, s)"
_COMPLETE = (
    _BASE
    + """, m AS (SELECT query_id, doc_id, len(q) AS nq, len(d) AS nd, len(list_filter(q, lambda t: list_contains(d, t))) AS k FROM x),
r AS (SELECT query_id, doc_id, CASE WHEN nq > 0 AND nd > 0 THEN least(k, nd)::DOUBLE / nd ELSE 0.0 END AS f, CASE WHEN nq > 0 AND nd > 0 THEN k::DOUBLE / nq ELSE 0.0 END AS q FROM m),
c AS (SELECT query_id, doc_id, round(0.5::DOUBLE * f + 0.5::DOUBLE * q, 9) AS completeness, round(f, 9) AS field_completeness, round(q, 9) AS query_completeness FROM r)"""
)
_TERMS = f"SELECT term, count(DISTINCT doc_id)::BIGINT AS document_frequency, count(*)::BIGINT AS term_frequency FROM (SELECT doc_id, unnest({_LOW}) AS term FROM documents) GROUP BY term"


def _stop_sql(language: str) -> str:
    return f"SELECT doc_id, len(w)::BIGINT AS n_all, len(list_filter(w, lambda t: NOT list_contains({_list(sorted(stop_words(language)))}, t)))::BIGINT AS n_kept FROM (SELECT doc_id, {_LOW} AS w FROM documents)"


def _fold_sql() -> str:
    single = {chr(c): s for c, s in fold_map().items() if len(s) == 1}
    out = f"translate(text, {_quote(''.join(single))}, {_quote(''.join(single.values()))})"
    for c, s in fold_map().items():
        if len(s) > 1:
            out = f"replace({out}, {_quote(chr(c))}, {_quote(s)})"
    return f"SELECT doc_id, {out} AS folded FROM documents"


_A, _ANE = r"[\p{L}\p{M}]", r"[\p{L}\p{M}\p{Nd}_]"
_MA, _MN = r"[:.''\x{00B7}\x{2018}\x{2019}\x{2024}\x{2027}]", r"[,;.''\x{2018}\x{2019}\x{2024}]"
_WORD = rf"(?:{_ANE}*(?:{_A}(?:{_MA}{_A})+|\p{{Nd}}(?:{_MN}\p{{Nd}})+))*{_ANE}*"

_SQL = {
    "whitespace_tokens": f"SELECT doc_id, (unnest(range(1, len(w) + 1)) - 1)::INT AS position, unnest(w) AS token FROM (SELECT doc_id, {_TOK} AS w FROM documents)",
    "token_length_filter": f"SELECT doc_id, len(w)::BIGINT AS n_tokens, array_to_string(w, ' ') AS kept FROM (SELECT doc_id, list_filter({_TOK}, lambda x: length(x) <= 8) AS w FROM documents)",
    "lowercase_tokens": f"SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest({_LOW}) AS term FROM documents) GROUP BY term",
    **{f"stopwords_{x}": partial(_stop_sql, x) for x in LANGUAGES},
    "ascii_fold": _fold_sql,
    "uax29_words_latin": f"SELECT doc_id, (unnest(range(1, len(w) + 1)) - 1)::BIGINT AS position, unnest(w) AS text FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{_WORD}'), lambda x: regexp_matches(x, '[^_]')) AS w FROM documents)",
    "set_operations": f"""
WITH b AS (SELECT DISTINCT unnest({_LOW}) AS term FROM benchmark), d AS (SELECT DISTINCT unnest({_LOW}) AS term FROM documents)
SELECT b.term IS NOT NULL AS in_benchmark, d.term IS NOT NULL AS in_documents, count(*)::BIGINT AS n FROM b FULL JOIN d ON b.term = d.term GROUP BY ALL""",
    "term_stats": _TERMS,
    "significance": f"SELECT term, round(0.5 + 0.5 * ((ln(1000000.0) - ln(greatest(1.0, least(1000000.0, document_frequency * 1000000.0 / n)))) / ln(1000000.0)), 9) AS significance FROM ({_TERMS}), (SELECT count(*)::DOUBLE AS n FROM documents)",
    "completeness": _COMPLETE + " SELECT * FROM c",
    "matches": _BASE + " SELECT query_id, doc_id, CASE WHEN list_has_any(q, d) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS matches FROM x",
    "query_term_count": f"SELECT item_id, len({_LOW})::DOUBLE AS query_term_count FROM benchmark",
    "term_match": _BASE + " SELECT query_id, doc_id, coalesce(list_position(d, q[2]) - 1, 1000000)::DOUBLE AS first_position, len(list_filter(d, lambda t: t = q[2]))::DOUBLE AS occurrences FROM x",
    "rerank_topk": _COMPLETE + ", k AS (SELECT query_id, doc_id, completeness, row_number() OVER (PARTITION BY query_id ORDER BY completeness DESC, doc_id)::INT AS rank FROM c) SELECT * FROM k WHERE rank <= 10",
    "multi_input_positions": f"""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS input_index, {_LOW} AS w FROM conversations WHERE text IS NOT NULL),
b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY conv_id ORDER BY input_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM t)
SELECT conv_id, (base + unnest(range(1, len(w) + 1)) - 1)::BIGINT AS position, input_index::BIGINT AS input_index, unnest(w) AS text FROM b""",
}


def oracle_sql() -> dict[str, str]:
    """The SQL of all queries that have one, made when it is asked for."""
    return {name: sql() if callable(sql) else sql for name, sql in _SQL.items()}

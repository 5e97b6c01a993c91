"""Query-document match features. A field is a list of (term, position), positions ascending; see ``analyzer``.

What built-in functions can say is a Column expression (completeness, matches, term match, counts,
significance); the greedy and the segment-searching features run in Arrow-batched UDFs.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Field = Sequence[tuple[str, int]]
ABSENT_POSITION = 1_000_000.0
REFERENCE_CORPUS = 1_000_000.0

# -- native expressions over array<string> of terms ---------------------------------------------


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def element_completeness(query: Column, document: Column) -> Column:
    """struct<completeness, field_completeness, query_completeness>; zeros if either side is empty."""
    nq, nd = F.size(query), F.size(document)
    matched = F.size(F.filter(query, lambda t: F.array_contains(document, t)))
    some = (nq > 0) & (nd > 0)
    of_query = F.when(some, _div(matched, nq)).otherwise(F.lit(0.0))
    of_field = F.when(some, _div(F.least(matched, nd), nd)).otherwise(F.lit(0.0))
    return F.struct((0.5 * of_field + 0.5 * of_query).alias("completeness"), of_field.alias("field_completeness"), of_query.alias("query_completeness"))


def matches(query: Column, document: Column) -> Column:
    return F.coalesce(F.arrays_overlap(query, document), F.lit(False)).cast("double")


def query_term_count(query: Column) -> Column:
    return F.size(query).cast("double")


def field_term_match(query: Column, document: Column, index: int) -> Column:
    """struct<first_position, occurrences> of the query's term at a position, over token structs."""
    term = F.get(F.filter(query, lambda t: t["position"] == index), F.lit(0))["text"]
    same = F.filter(document, lambda t: t["text"] == term)
    return F.struct(
        F.coalesce(F.array_min(F.transform(same, lambda t: t["position"])).cast("double"), F.lit(ABSENT_POSITION)).alias("first_position"),
        F.coalesce(F.size(same), F.lit(0)).cast("double").alias("occurrences"),
    )


def proximity_score(distance: Column) -> Column:
    return F.when(distance >= 9, F.lit(0.0)).otherwise(1.0 - F.pow((distance - 1) / F.lit(8.0), 2))


def legacy_significance(document_frequency: Column, document_count: Column) -> Column:
    """Inverse document frequency of a term's share, on a corpus of REFERENCE_CORPUS documents, in [0.5, 1]."""
    projected = F.greatest(F.lit(1.0), F.least(F.lit(REFERENCE_CORPUS), document_frequency.cast("double") * REFERENCE_CORPUS / document_count))
    top = F.lit(math.log(REFERENCE_CORPUS))
    return F.when(document_count > 0, 0.5 + 0.5 * ((top - F.log(projected)) / top)).otherwise(F.lit(0.5))


# -- plain Python ---------------------------------------------------------------------------------


def significance(df: int, n: int) -> float:
    if n <= 0:
        return 0.5
    top = math.log(REFERENCE_CORPUS)
    return 0.5 + 0.5 * ((top - math.log(min(max(df * REFERENCE_CORPUS / n, 1.0), REFERENCE_CORPUS))) / top)


def _near(distance: int) -> float:
    return 0.0 if distance >= 9 else 1.0 - ((distance - 1) / 8.0) ** 2


SIMILARITY = ("similarity", "proximity", "order", "query_coverage", "field_coverage")


def _where(document: Field) -> dict[str, list[int]]:
    where: dict[str, list[int]] = defaultdict(list)
    for term, p in document:
        where[term].append(p)
    return where


def similarity(query: Field, document: Field) -> tuple[float, ...]:
    """SIMILARITY of a query and a document."""
    return similarity_at(query, _where(document), len(document))


def similarity_at(query: Field, where: Mapping[str, list[int]], n: int) -> tuple[float, ...]:
    """SIMILARITY with a document of n tokens, of which ``where`` has the positions of the query's terms: each query
    occurrence, in order of document position, takes its term's first position after the last one taken."""
    waiting = [(where[t], i) for t, i in query if t in where]
    if not waiting:
        return (0.0,) * 5
    last, last_i = min((ps[0], i) for ps, i in waiting)
    waiting = [w for w in waiting if w[1] != last_i]
    taken, near, in_order = 1, 0.0, 0
    while True:
        # an occurrence that has no position left after the last one is out; a later position is its next chance
        ahead = [(ps[k], i) for ps, i in waiting if (k := bisect_right(ps, last)) < len(ps)]
        if not ahead:
            break
        p, i = min(ahead)
        near += _near(p - last)
        in_order += i > last_i
        last, last_i, taken = p, i, taken + 1
        waiting = [w for w in waiting if w[1] != i]
    found = min(taken, n)
    proximity, order = (_near(n), float(found)) if taken < 2 else (near / (taken - 1), in_order / (taken - 1))
    qc, fc = taken / len(query), found / n
    return 0.35 * proximity + 0.15 * order + 0.30 * qc + 0.20 * fc, proximity, order, qc, fc


#: Closeness of two matched terms by signed distance, -10 to 10.
PAIR = (0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.12, 0.17, 0.24, 0.33, 1.0, 0.71, 0.50, 0.35, 0.25, 0.18, 0.13, 0.09, 0.06, 0.04, 0.03)
REACH = 10
MAX_TRIES = 1000
MAX_OCCURRENCES = 100
CONNECTEDNESS = 0.1

FIELD_MATCH = (
    "score", "proximity", "absolute_proximity", "unweighted_proximity", "completeness", "query_completeness", "field_completeness",
    "orderness", "relatedness", "earliness", "longest_sequence", "longest_sequence_ratio", "segments", "segment_distance",
    "segment_proximity", "gaps", "gap_length", "head", "tail", "out_of_order", "matches", "occurrence", "absolute_occurrence",
    "significance", "weight", "importance", "weighted_occurrence", "weighted_absolute_occurrence", "significant_occurrence",
)

#: A segmentation: its segments, each the (query index, field index) of its matches in query order.
Segments = tuple[tuple[tuple[int, int], ...], ...]


def _pair(a: tuple[int, int], b: tuple[int, int]) -> float | None:
    """Closeness of neighbouring matches of a segment; None if they are too far apart to count."""
    d = b[1] - a[1] - 1
    d += d < 0
    return PAIR[d + REACH] if abs(d) <= REACH else None


def _pairs(segments: Segments) -> list[float]:
    return [x for s in segments for a, b in zip(s, s[1:], strict=False) if (x := _pair(a, b)) is not None]


def _absolute(pairs: list[float]) -> float:
    total = 0.0
    for x in pairs:
        total += x * CONNECTEDNESS
    return total / len(pairs) if pairs else 0.1


def _rating(segments: Segments) -> float:
    return _absolute(_pairs(segments)) / len(segments) ** 2 if segments else 0.0


def _rank(j: int, origin: int, n: int) -> int:
    """Order in which field indices are looked at from an origin: REACH ahead, REACH behind, rest ahead, rest behind."""
    ahead, behind = min(REACH, n - origin), min(REACH, origin)
    if j >= origin:
        return j - origin + (behind if j - origin >= ahead else 0)
    back = origin - 1 - j
    return back + (ahead if back < behind else n - origin)


class _Start:
    """Where a segment may start in the query: the best segmentation that ends before it, and how far it was looked from."""

    __slots__ = ("best", "origin", "looked", "skipped", "open")

    def __init__(self, best: Segments, origin: int):
        self.best, self.origin, self.looked, self.skipped, self.open = best, origin, 0, 0, True


class _Field:
    """Where terms are, in the order in which they are looked at from an origin."""

    def __init__(self, where: dict[str, list[int]], n: int):
        self.where, self.n = where, n
        self._ranked: dict[tuple[str, int], list[tuple[int, int]]] = {}

    def next(self, term: str, origin: int, least: int) -> tuple[int, int] | None:
        """(rank, index) of the term's first occurrence at a rank of ``least`` or more."""
        if (ranked := self._ranked.get((term, origin))) is None:
            ranked = self._ranked[term, origin] = sorted((_rank(j, origin, self.n), j) for j in self.where.get(term, ()))
        k = bisect_left(ranked, (least,))
        return ranked[k] if k < len(ranked) else None


def _grow(query: list[str], field: _Field, at: int, start: _Start) -> tuple[int, tuple[tuple[int, int], ...]] | None:
    """The next segment from a start and the query index after it, or None if there is none left."""
    segment: list[tuple[int, int]] = []
    origin, looked = start.origin, start.looked
    for i in range(at + start.skipped, len(query)):
        ranked = field.next(query[i], origin, looked)
        j = -1 if ranked is None else ranked[1]
        if not segment:
            if j < 0:
                if looked:
                    return None
                start.skipped += 1
            else:
                start.looked = ranked[0] + 1
        elif abs(j - origin) >= REACH:  # an unmatched term counts as index -1 here
            return i, tuple(segment)
        looked = int(j >= 0)
        if j >= 0:
            segment.append((i, j))
            origin = j
    return (len(query), tuple(segment)) if segment else None


def segmentation(query: list[str], where: dict[str, list[int]], n: int) -> Segments:
    """The segmentation the search ends with: per start the best-rated one, the earlier of equals."""
    starts: dict[int, _Start] = {0: _Start((), 0)}
    field = _Field(where, n)
    at, tries = 0, 0
    while True:
        start = starts[at]
        grown = _grow(query, field, at, start)
        if grown is None:
            start.open = False
        else:
            end, segment = grown
            new = (*start.best, segment)
            if end not in starts:
                starts[end] = _Start(new, segment[-1][1])
            elif _rating(new) > _rating(starts[end].best):
                starts[end].best, starts[end].origin = new, segment[-1][1]
        for k in sorted(k for k, s in starts.items() if k >= at and s.open):
            if starts[k].looked == 0:
                at = k
                break
            if tries < MAX_TRIES:
                tries += 1
                at = k
                break
        else:
            return starts[max(starts)].best


def field_match(query: Field, document: Field, stats: Callable[[str], tuple[int, int, int]] = lambda _: (0, 0, 100)) -> tuple[float, ...]:
    """FIELD_MATCH. stats: term -> (document frequency, document count, weight)."""
    where: dict[str, list[int]] = defaultdict(list)
    for j, (t, _) in enumerate(sorted(document, key=lambda x: x[1])):
        where[t].append(j)
    return field_match_at(query, where, len(document), stats)


def field_match_at(query: Field, where: Mapping[str, list[int]], n: int, stats: Callable[[str], tuple[int, int, int]] = lambda _: (0, 0, 100)) -> tuple[float, ...]:
    """FIELD_MATCH with a document of n tokens, of which ``where`` has the places of the query's terms in order."""
    q = [t for t, _ in sorted(query, key=lambda x: x[1])]
    if not q or not n:
        return (0.0,) * len(FIELD_MATCH)
    known = {t: stats(t) for t in dict.fromkeys(q)}
    weights = [known[t][2] for t in q]
    rarity = [significance(*known[t][:2]) for t in q]
    segments = segmentation(q, where, n)
    hits = [m for s in segments for m in s]
    counted = hits[:n]
    total_w, total_s = float(sum(weights)), 0.0
    for x in rarity:
        total_s += x
    weight = sig = 0.0
    for i, _ in counted:
        weight += weights[i] / total_w if total_w > 0 else 0.0
        sig += rarity[i] / total_s if total_s > 0 else 0.0
    steps = [(a, b) for s in segments for a, b in zip(s, s[1:], strict=False)]
    # runs: matches next to each other in query and field
    runs: list[tuple[int, int]] = []
    for s in segments:
        first = 0
        for k in range(1, len(s) + 1):
            if k == len(s) or s[k] != (s[k - 1][0] + 1, s[k - 1][1] + 1):
                runs.append((s[first][1], s[k - 1][1]))
                first = k
    jumps = [(a[1], b[1]) for a, b in steps if b != (a[0] + 1, a[1] + 1)]
    back = sum(b <= a for a, b in jumps)
    gap_length = sum(b - a - 1 if b > a else a - b for a, b in jumps)
    pairs = _pairs(segments)
    absolute = _absolute(pairs)
    unweighted = sum(pairs) / len(pairs) if pairs else 1.0
    proximity = absolute / CONNECTEDNESS
    m = len(counted)
    qc, fc = m / len(q), m / n
    completeness = qc * 0.95 + 0.05 * fc
    orderness = 1.0 - back / len(pairs) if pairs else 1.0
    related = 0.0 if m == 0 else 1.0 if m == 1 else 1.0 - (len(segments) - 1) / (m - 1)
    longest = max([1, *(b - a + 1 for a, b in runs)])
    head = min((a for a, _ in runs), default=0)
    tail = min((n - b - 1 for _, b in runs), default=0)
    firsts = sorted(s[0][1] for s in segments)
    distance = float(sum(b - a + 1 for a, b in zip(firsts, firsts[1:], strict=False)))
    closeness = 1.0 - distance / n if m else 0.0
    early = 0.0 if m == 0 else 1.0 if n == 1 else 1.0 - head / (max(6, n) - 1)
    occurrence = absolute_occ = weighted_abs = weighted = significant = 0.0
    present = sorted(t for t in known if t in where)
    if present:
        share = min(n, MAX_OCCURRENCES * len(present))
        most = float(min(n, MAX_OCCURRENCES))
        w_total = s_total = 0.0
        times = {t: float(min(len(where[t]), MAX_OCCURRENCES)) for t in present}
        rare = {t: significance(*known[t][:2]) for t in present}
        for t in present:
            occurrence += times[t] / share
            absolute_occ += times[t] / (MAX_OCCURRENCES * len(present))
            weighted_abs += times[t] * known[t][2] / MAX_OCCURRENCES
            w_total += most * known[t][2] / share
            s_total += most * rare[t] / share
        all_w = sum(known[t][2] for t in present)
        weighted_abs /= all_w if all_w > 0 else 1.0
        for t in present:
            weighted += times[t] * known[t][2] / share / w_total if w_total > 0 else 0.0
            significant += times[t] * rare[t] / share / s_total if s_total > 0 else 0.0
    exact = 1.0 if m else 0.0
    parts = 0.9 * (0.1 + 0.9 * related) * proximity * exact * completeness * completeness
    score = (parts + 0.05 * early + 0.05 * closeness + 0.05 * occurrence) / (0.9 + 0.05 + 0.05 + 0.05)
    return (
        score, proximity, absolute, unweighted, completeness, qc, fc, orderness, related, early, float(longest), longest / m if m else 0.0,
        float(len(segments)), distance, closeness, float(len(jumps)), float(gap_length), float(head), float(tail), float(back), float(m),
        occurrence, absolute_occ, sig, weight, (sig + weight) / 2.0, weighted, weighted_abs, significant,
    )


# -- a document against a fixed set of searches: one call per document, and only matching tokens cross to Python ------


def hits(terms: Column, vocabulary: Sequence[str]) -> Column:
    """struct<n, found array<struct<at, term>>>: size of an array of terms, and of those in ``vocabulary`` place and number."""
    number = F.create_map(*[F.lit(x) for i, t in enumerate(vocabulary) for x in (t, i)]) if vocabulary else F.expr("map('', 0)")
    one = lambda t, i: F.when(t.isin(list(vocabulary)), F.struct(i.cast("int").alias("at"), F.element_at(number, t).alias("term")))
    # bound to a lambda's variable, the terms are made once
    return F.transform(F.array(terms), lambda w: F.struct(F.size(w).alias("n"), F.filter(F.transform(w, one), lambda x: x.isNotNull()).alias("found")))[0]


def _against(searches: Sequence[Sequence[str]], names: tuple[str, ...], score) -> Callable[[Column], Column]:
    vocabulary = sorted({t for q in searches for t in q})
    queries = [[(t, i) for i, t in enumerate(q)] for q in searches]

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("query_id", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])))
    def run(found: pa.Array) -> pa.Array:
        # flatten() and value_lengths() skip what a null or a slice hides
        n, lists = found.field("n").to_pylist(), found.field("found")
        lengths, inner = lists.value_lengths().fill_null(0).to_pylist(), lists.flatten()
        at, number = inner.field("at").to_pylist(), inner.field("term").to_pylist()
        rows, first = [], 0
        for size, k in zip(n, lengths, strict=True):
            where: dict[str, list[int]] = defaultdict(list)
            for p, t in zip(at[first : first + k], number[first : first + k], strict=True):
                where[vocabulary[t]].append(p)
            first += k
            rows += [score(q, where, max(0, size or 0)) for q in queries]
        ids = pa.array(np.tile(np.arange(len(queries), dtype=np.int32), len(n)))
        columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.float64())] * len(names)
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(queries))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([ids, *columns], ["query_id", *names]))

    return lambda terms: run(hits(terms, vocabulary))


def similarities(terms: Column, searches: Sequence[Sequence[str]]) -> Column:
    """array<struct<query_id, SIMILARITY...>> of an array of terms against each of a fixed set of searches."""
    return _against(searches, SIMILARITY, similarity_at)(terms)


def field_matches(terms: Column, searches: Sequence[Sequence[str]], stats: Callable[[str], tuple[int, int, int]] = lambda _: (0, 0, 100)) -> Column:
    """array<struct<query_id, FIELD_MATCH...>> of an array of terms against each of a fixed set of searches."""
    return _against(searches, FIELD_MATCH, lambda q, where, n: field_match_at(q, where, n, stats))(terms)


# -- Arrow-batched UDFs over token structs (text, position, ...) ------------------------------------


def _fields(tokens: pa.Array) -> list[list[tuple[str, int]]]:
    """(term, position) of each row's token structs, read from the Arrow columns of the structs."""
    inner = tokens.values
    terms, positions = inner.field("text").to_pylist(), inner.field("position").to_pylist()
    offsets = tokens.offsets.to_pylist()
    return [list(zip(terms[a:b], positions[a:b], strict=True)) if ok else [] for a, b, ok in zip(offsets[:-1], offsets[1:], tokens.is_valid().to_pylist(), strict=True)]


def _struct(rows: list[tuple[float, ...]], names: tuple[str, ...]) -> pa.Array:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], list(names))


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SIMILARITY]))
def _similarity_udf(query: pa.Array, document: pa.Array) -> pa.Array:
    return _struct([similarity(q, d) for q, d in zip(_fields(query), _fields(document), strict=True)], SIMILARITY)


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in FIELD_MATCH]))
def _field_match_udf(query: pa.Array, document: pa.Array, stats: pa.Array) -> pa.Array:
    rows = []
    for q, d, s in zip(_fields(query), _fields(document), stats.to_pylist(), strict=True):
        known = {x["term"]: (x["document_frequency"], x["document_count"], x["weight"]) for x in s or ()}
        rows.append(field_match(q, d, lambda t, k=known: k.get(t, (0, 0, 100))))
    return _struct(rows, FIELD_MATCH)


def element_similarity(query: Column, document: Column) -> Column:
    """struct of SIMILARITY, over token structs."""
    return _similarity_udf(query, document)


def text_similarity(query: Column, document: Column) -> Column:
    """The same numbers, the first called score."""
    s = _similarity_udf(query, document)
    return F.struct(s["similarity"].alias("score"), *[s[n].alias(n) for n in SIMILARITY[1:]])


NO_STATS = "cast(null as array<struct<term:string,document_frequency:bigint,document_count:bigint,weight:int>>)"


def field_match_features(query: Column, document: Column, stats: Column | None = None) -> Column:
    """struct of FIELD_MATCH. stats: array<struct<term, document_frequency, document_count, weight>>, or none."""
    return _field_match_udf(query, document, F.expr(NO_STATS) if stats is None else stats)

"""N-gram Jaccard join by PartEnum signatures: near-duplicate documents and their components.

A document's set holds the hashes of its 5-word shingles (64 bits; all shorter texts have one shingle,
their words). Two sets link when 100 |A and B| >= 80 |A or B|. Then they differ in at most
(|A| + |B|) / 9 elements. Sizes are cut into bands; the instance of a band serves pairs whose larger set
is in it, so a set also signs in the bands above that hold possible partners. An instance with sizes up
to r has k = floor(2 r / 9), the most elements in which its pairs differ. The hash domain is cut into first-level
parts, each of these into second-level parts. In a band of large sets (k >= DEEP) there are n1 > k / 2 first-level
parts, so at least n1 - floor(k / 2) of them differ in one element or none; each is cut in three, and the three
subsets of two are enumerated: one difference spoils one part, so the two others, as a subset, are equal. A signature
is the hash of the elements in a subset, with its band, part and number; two thirds of 2 / k of a set have to agree by
chance to make a needless candidate. For small sets (k < DEEP) a first-level part is not cut: there are more than k of
them, and a signature each. Subsets without an element give no signature; n1 exceeds what is needed by more than
the parts with such a subset that a set has, which is checked set by set, and a set that fails signs its
empty subsets too.

Exact copies fold into one node (the fingerprint of its set) before anything is compared. Nodes that share
a signature are candidates. No list of all pairs is made:

* each signature's nodes pair with its center only, the node with most shared signatures (a copied text
  rather than a copy); distinct pairs pass two exact filters (size,
  and the parity of a bitmap, whose difference bounds the sets' difference from below), then rounds
  verify some pairs of each node, SHARES times as many in each, link them, and drop what is connected by then;
* signatures of three nodes or more whose nodes are still in different components give their other
  pairs, across components only and filtered in tiles of TILE nodes, so none is lost, and rounds go on.

Only ids, signatures and the compressed texts of candidates are shuffled. Components come from
label propagation with pointer jumping over written tables; nothing but counts comes to the driver.

Defined results: a null text or one without words has an empty set, size 0, and links with nothing; a null
doc_id keeps its row, with a null component, and links with nothing; repeated rows each get a row; rows with one doc_id
and different texts are linked each by its own text; an empty table gives an empty result; extra columns are ignored.
Nodes are told apart by 64 bits of the fingerprint of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize, table, temporary

N = 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
BAND_RATIO = 1.4
#: First-level parts beyond those needed, as a share of them.
SLACK = 0.15
#: Least k of a band whose first-level parts are cut in three. Subsets are half as many again as parts, but agree by chance
#: more seldom; that pays for long texts, which share passages with texts that they don't link with.
DEEP = 256
#: Low bytes of a signature that are sent to its range.
SIGNATURE_BYTES = 4
CHUNK = 1 << 18
BLOB = 4 << 20
TILE = 256
#: Least groups that a node is known by in all of its groups, so that a pair comes out of one of those it shares.
FIRSTS = 8
#: Shares that a node's pairs are dealt to by the other node's hash. The first round verifies a pair of each share, each
#: further round SHARES times as many.
SHARES = 16
#: Words of the bitmap that lets through the ids of candidates: a fixed size.
SIEVE = 1 << 17

_rng = np.random.default_rng(20240608)
_T64 = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_P = 0xD6E8FEB86659FD93
_INV = pow(_P, -1, 1 << 64)
_A = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


def sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, ascending and distinct in each, and the sets' bounds in them."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    buffer = b"\n".join(texts).lower() + b"\n"
    b = np.frombuffer(buffer, np.uint8)
    word = ~_SPACES[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    room = 1 << max(16, int(len(b)).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_T64[b] * _powers(_P, room)[: len(b)], dtype=np.uint64)])
    w = _mix((sums[ends] - sums[starts]) * _powers(_INV, room)[starts] + (ends - starts).astype(np.uint64) * _A)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    doc = np.searchsorted(bounds, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    m = max(0, len(w) - N + 1)
    h = w[:m].copy()
    for i in range(1, N):
        h = h * _A + w[i : m + i]
    whole = doc[:m] == doc[N - 1 :] if m else np.zeros(0, bool)
    h, d = _mix(h[whole]), doc[:m][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < N))
    if len(short):
        first = np.cumsum(n_words) - n_words
        more = []
        for i in short.tolist():
            x = int(n_words[i]) * _P % (1 << 64)
            for v in w[first[i] : first[i] + n_words[i]].tolist():
                x = (x * int(_A) + v) % (1 << 64)
            more.append(x)
        h, d = np.concatenate([h, _mix(np.array(more, np.uint64))]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    h, d = h[new], d[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Do two sets (ascending hashes) link?"""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(fp: bytes) -> int:
    """A node's id: 64 bits of its set's fingerprint."""
    return int.from_bytes(fp[:8], "big", signed=True)


def max_difference(total: int) -> int:
    """The most elements in which linked sets of that total size differ."""
    return total * (100 - PERCENT) // (100 + PERCENT)


@lru_cache(maxsize=1)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greatest size, k, number of first-level parts and of second-level ones to each (1 or 3), of each band."""
    top, out = 0, []
    while top < 1 << 40:
        top = max(top + 1, int((top + 1) * BAND_RATIO))
        k = max_difference(2 * top)
        cuts = 3 if k >= DEEP else 1
        needed = k // 2 + 1 if cuts == 3 else k + 1
        out.append((top, k, needed + (int(np.ceil(SLACK * needed)) + 1 if k else 0), cuts))
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and whose each is."""
    tops, ks, parts, cuts = bands()
    sizes = np.diff(bounds)
    low = np.concatenate([[0], tops[:-1]]) + 1
    own = np.searchsorted(tops, sizes)
    mixed = _mix(h ^ _A)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while True:
        band = own + step
        # partners in this band: the smallest set of the band is not too large for this one
        mine = np.flatnonzero((sizes > 0) & (100 * sizes >= PERCENT * low[band]))
        if not len(mine):
            return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        mine = mine[ks[band[mine]] > 0]  # with k = 0 only equal sets link, and those are one node
        for cut in (1, 3):
            some = mine[cuts[band[mine]] == cut]
            if len(some):
                out.append(_enumerated(h, mixed, bounds, sizes, some, band[some], parts[band[some]], ks[band[some]], cut))
        step += 1


def _enumerated(h, mixed, bounds, sizes, some, band, n1, k, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets ``some``, each in its band: of each first-level part the subsets of all but one of its
    ``cut`` second-level parts (of the one there is, if it is not cut)."""
    # cells: second-level parts, numbered through a set; sums of their elements' hashes tell their contents
    n = n1 * cut
    base = np.concatenate([[0], np.cumsum(n)])
    length = sizes[some]
    elements = np.repeat(bounds[:-1][some] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    who = np.repeat(np.arange(len(some)), length)
    cell = ((h[elements] >> np.uint64(32)) * n[who].astype(np.uint64)) >> np.uint64(32)
    at = base[:-1][who] + cell.astype(np.int64)  # ascending: hashes ascend in a set
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), at[1:] != at[:-1]]))
    sums = np.zeros(int(base[-1]), np.uint64)
    filled = np.zeros(len(sums), bool)
    if len(new):
        sums[at[new]] = np.add.reduceat(mixed[elements], new)
        filled[at[new]] = True
    owner = np.repeat(np.arange(len(some)), n1)
    part = np.arange(len(owner)) - np.repeat(base[:-1] // cut, n1)
    sums, filled = sums.reshape(-1, cut), filled.reshape(-1, cut)
    if cut == 1:
        inside, any_ = sums, filled
    else:  # without each of the three in turn; an empty cell adds nothing
        inside = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        any_ = filled.sum(axis=1)[:, None] - filled > 0
    weak = np.bincount(owner, weights=~any_.all(axis=1), minlength=len(some))
    sign_empty = weak >= n1 - (k // 2 if cut == 3 else k)
    row, which = np.nonzero(any_ | sign_empty[owner][:, None])
    tag = part[row].astype(np.uint64) * np.uint64(4) + which.astype(np.uint64) + (band[owner[row]].astype(np.uint64) << np.uint64(40))
    return _mix(_mix(inside[row, which] + _A) ^ (tag * _C)), some[owner[row]]


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the elements that fall on each bit; 64 bits to about twice as many as elements."""
    n = 1 << max(6, int(len(s)).bit_length())
    bits = np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """At most the number of elements in which the sets of two bitmaps differ."""
    x, y = int.from_bytes(a, "big"), int.from_bytes(b, "big")
    for m, n in ((len(a), len(b)), (len(b), len(a))):
        while m > n:  # halves fold by exclusive or: the lower bits of an element stay
            m //= 2
            if len(a) > len(b):
                x = (x >> (8 * m)) ^ (x & ((1 << (8 * m)) - 1))
            else:
                y = (y >> (8 * m)) ^ (y & ((1 << (8 * m)) - 1))
    return (x ^ y).bit_count()


def possible(na: int, nb: int, a: bytes, b: bytes) -> bool:
    return 100 * min(na, nb) >= PERCENT * max(na, nb) and parity_distance(a, b) <= max_difference(na + nb)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, about ``limit`` bytes at a time."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = (t.as_py() or "").encode()
            ids.append(i)
            texts.append(raw)
            size += len(raw)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _sizes(batches) -> Iterator[pa.RecordBatch]:
    for ids, texts in _chunks(batches):
        h, bounds = sets_of(texts)
        fps = [fingerprint(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array([node_of(f) for f in fps], pa.int64()), pa.array(fps, pa.binary())], names=["doc_id", "n", "node", "fp"]
        )


def range_of(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n < 2^32 ranges of about equal length each 64-bit number is in; no list of the ranges is needed."""
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _signed(batches, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, signatures and nodes) of about BLOB bytes of text at a time."""
    sigs: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    size = 0

    def flush():
        s, n = np.concatenate(sigs), np.concatenate(nodes)
        order = np.argsort(s, kind="stable")
        s, n = s[order], n[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])  # copies near each other
        s, n = s[new], n[new]
        bucket = range_of(s, n_buckets)
        cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(s)]
        rows = [(int(bucket[a]), np.ascontiguousarray(s[a:b].view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES]).tobytes() + n[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    for _, texts in _chunks(batches):
        h, bounds = sets_of(texts)
        s, whose = signatures(h, bounds)
        if len(s):
            ids = np.array([node_of(fingerprint(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
            sigs.append(s)
            nodes.append(ids[whose])
        size += sum(map(len, texts))
        if size >= BLOB and sigs:
            yield flush()
            sigs, nodes, size = [], [], 0
    if sigs:
        yield flush()


_GROUPS_SQL = "gid long, node long, first long, m long"


def _shared(rows: pa.Table) -> pa.Table:
    """Of one range of signatures, the nodes of those that two nodes or more have. Signatures keep their low bytes
    beside their range's number: a chance agreement is one more candidate."""
    low, nodes = [], []
    for blob in rows.column("blob").to_pylist():
        n = len(blob) // (SIGNATURE_BYTES + 8)
        low.append(np.frombuffer(blob, np.uint32, n).astype(np.uint64))
        nodes.append(np.frombuffer(blob, np.int64, n, SIGNATURE_BYTES * n))
    s, n = np.concatenate(low), np.concatenate(nodes)
    del low, nodes
    # most signatures are alone; only the others are sorted with their nodes
    order = np.argsort(s)
    same = s[order][1:] == s[order][:-1]
    keep = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    s, n = s[keep], n[keep]
    by = np.lexsort((n, s))
    s, n = s[by], n[by]
    new = np.concatenate([np.ones(min(1, len(s)), bool), (s[1:] != s[:-1]) | (n[1:] != n[:-1])])
    s, n = s[new], n[new]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
    m = np.diff(np.append(at, len(s)))
    first, count = np.repeat(n[at], m), np.repeat(m, m)
    some = count > 1
    gid = s.astype(np.int64) | (rows.column("bucket")[0].as_py() << 8 * SIGNATURE_BYTES)
    # one row for each (first, node) of pairs; of larger groups all rows, for what is left to compare
    s_gid, s_n, s_f, s_m = gid[some], n[some], first[some], count[some]
    two = s_m == 2
    _, once = np.unique(np.stack([s_f[two], s_n[two]], 1), axis=0, return_index=True) if two.any() else (None, np.zeros(0, np.int64))
    take = np.concatenate([np.flatnonzero(two)[once], np.flatnonzero(~two)])
    return pa.table([pa.array(x[take]) for x in (s_gid, s_n, s_f, s_m)], names=["gid", "node", "first", "m"])


_ABOUT_SQL, _TEXT_SQL = "doc_id long, fp binary, node long, n long, bits binary", "doc_id long, fp binary, node long, ztext binary"


def _chosen(batches, sieve_b, texts_too: bool) -> Iterator[pa.RecordBatch]:
    """Of documents whose id passes the sieve: node, and size and bitmap or the compressed text."""
    sieve = sieve_b.value
    for batch in batches:
        x = np.asarray(batch.column("h"), np.int64)
        hit = (sieve[x >> 6] >> (x & 63)) & 1 == 1
        for ids, texts in _chunks(iter([batch.filter(pa.array(hit))])):
            h, bounds = sets_of(texts)
            parts = [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            fps = [fingerprint(p) for p in parts]
            columns = [pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array([node_of(f) for f in fps], pa.int64())]
            if texts_too:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([zstandard.compress(t, 3) for t in texts], pa.binary())], names=["doc_id", "fp", "node", "ztext"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array([bitmap(p) for p in parts], pa.binary())], names=["doc_id", "fp", "node", "n", "bits"])


def _load(docs: DataFrame, wanted: DataFrame, texts_too: bool) -> DataFrame:
    """Rows of _chosen for wanted(node, fp, rep), one a node.

    A sieve of fixed size lets the wanted ids through and few others, so that what is not wanted is
    neither worked on nor shuffled; the join makes it exact.
    """
    spark = docs.sparkSession
    words = wanted.select(_slot("rep").alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v")).toArrow()
    sieve = np.zeros(SIEVE, np.int64)
    sieve[np.asarray(words.column("w"))] = np.asarray(words.column("v"))
    sieve_b = spark.sparkContext.broadcast(sieve)
    rows = docs.where("doc_id IS NOT NULL").withColumn("h", _slot("doc_id")).mapInArrow(lambda b: _chosen(b, sieve_b, texts_too), _TEXT_SQL if texts_too else _ABOUT_SQL)
    found = rows.join(wanted.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi")
    return found.dropDuplicates(["doc_id", "fp"]).drop("doc_id", "fp")


def _sift(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = [batch.column(n).to_pylist() for n in ("na", "nb", "bits_a", "bits_b")]
        keep = [possible(*x) for x in zip(*c, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches) -> Iterator[pa.RecordBatch]:
    last, kept = None, None
    for batch in batches:
        a, b, ok = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for i in range(batch.num_rows):
            if a[i] != last:
                last, kept = a[i], sets_of([zstandard.decompress(batch.column("text_a")[i].as_py())])[0]
            ok.append(linked(kept, sets_of([zstandard.decompress(batch.column("text_b")[i].as_py())])[0]))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the least of their widths, as rows of 64-bit words."""
    least = min(map(len, bits))
    out = np.empty((len(bits), least // 8), np.uint64)
    for i, b in enumerate(bits):
        x = np.frombuffer(b, np.uint64)
        while len(x) > out.shape[1]:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _tile(rows: pa.Table) -> tuple[list[int], list[int]]:
    """Possible pairs of different components between two tiles of one group (or in one).

    Of a pair whose nodes both have a group among their FIRSTS, only the least such group makes it.
    """
    node, comp, n, side = (np.asarray(rows.column(c), np.int64) for c in ("node", "comp", "n", "side"))
    left, right = np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero((side == 1) | (side == 2))
    a: list[int] = []
    b: list[int] = []
    if not len(right) or not len(left) or comp.min() == comp.max():
        return a, b
    bits, firsts, gid = rows.column("bits").to_pylist(), list(map(frozenset, rows.column("firsts").to_pylist())), rows.column("gid")[0].as_py()
    words = folded(bits)
    for i in left.tolist():
        near = (comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))
        if side[i] == 2:
            near &= node[right] > node[i]
        r = right[near]
        r = r[np.bitwise_count(words[r] ^ words[i]).sum(axis=1) <= max_difference(n[r] + n[i])]
        for j in r.tolist():
            if min(firsts[i] & firsts[j], default=gid) == gid and possible(int(n[i]), int(n[j]), bits[i], bits[j]):
                a.append(int(min(node[i], node[j])))
                b.append(int(max(node[i], node[j])))
    return a, b


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_tile of each (gid, x, y), whose rows follow each other."""
    parts: list[pa.RecordBatch] = []
    key = None

    def flush() -> pa.RecordBatch | None:
        a, b = _tile(pa.Table.from_batches(parts))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

    for batch in batches:
        k = np.stack([np.asarray(batch.column(c), np.int64) for c in ("gid", "x", "y")])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi == lo:
                continue
            this = tuple(k[:, lo].tolist())
            if this != key and parts:
                if (out := flush()) is not None:
                    yield out
                parts = []
            key = this
            parts.append(batch.slice(lo, hi - lo))
    if parts and (out := flush()) is not None:
        yield out


def _roots(edges: DataFrame) -> DataFrame:
    """edges(a, b), distinct -> (node, root): the smallest node reachable, by least neighbours and jumps."""
    both = materialize(edges.union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # jump: to the label of one's label
        to = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = materialize(step.join(to, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        labels = new.select("node", "root")
        if new.where("was <> root").isEmpty():
            return labels


def _endpoints(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs(a, b) with the components ca and cb of both ends, a node without one being its own."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))


def components(fresh: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, comp) after links fresh(a, b) join the components of labels: only components that they touch are
    looked at, each as one node. comp is the smallest node of a component."""
    if labels is None:
        return _roots(fresh).select("node", F.col("root").alias("comp"))
    ends = materialize(_endpoints(fresh, labels), "ends")
    edges = ends.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    if edges.isEmpty():
        return labels
    roots = _roots(edges).withColumnRenamed("node", "comp")
    nodes = labels.union(ends.select("a", "ca")).union(ends.select("b", "cb")).distinct()
    return materialize(nodes.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")


def _rounds(pairs: DataFrame, docs: DataFrame, wanted: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """Verify pairs(a, b) of candidates until each is verified or connected; the components. b is the end that has few
    pairs, where one of them has: its pairs are ranked, share by share."""
    take, text = 1, None
    while not pairs.isEmpty():
        if text is None:
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            text = materialize(_load(docs, wanted.join(ends, "node", "left_semi"), True), "texts", "none")
        if labels is not None:
            pairs = _endpoints(pairs, labels).where("ca <> cb").select("a", "b")
        ranked = materialize(pairs.withColumn("r", F.row_number().over(W.partitionBy("b", F.pmod(F.xxhash64("a"), F.lit(SHARES))).orderBy("a"))), "ranked")
        now = ranked.where(F.col("r") <= take).select("a", "b")
        full = now.join(text.withColumnRenamed("node", "b").withColumnRenamed("ztext", "text_b"), "b").join(text.withColumnRenamed("node", "a").withColumnRenamed("ztext", "text_a"), "a")
        fresh = materialize(full.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long, linked boolean"), "verified").where("linked").select("a", "b")
        if not fresh.isEmpty():
            labels = components(fresh, labels)
        pairs = ranked.where(F.col("r") > take).select("a", "b")
        take *= SHARES
    return labels


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SIEVE * 64)).cast("long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id. The tables made on the way are deleted."""
    with temporary(docs.sparkSession):
        return materialize(_near_duplicates(docs), "near-duplicates", result=True)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = materialize(docs.mapInArrow(_sizes, "doc_id long, n long, node long, fp binary"), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    reps = sizes.where("n > 0 AND doc_id IS NOT NULL").groupBy("node", "fp").agg(F.min("doc_id").alias("rep"))
    n_buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total * 8 // (16 << 20))
    signed = docs.where("doc_id IS NOT NULL").mapInArrow(lambda b: _signed(b, n_buckets), "bucket int, blob binary")
    groups = materialize(signed.groupBy("bucket").applyInArrow(_shared, _GROUPS_SQL), "groups")
    # the center of a larger group is its node with most shared signatures: of copies, what they are copies of
    two, many = groups.where("m = 2 AND node <> first").select("first", "node"), groups.where("m > 2").select("gid", "node", "m")
    degree = two.select("node").union(two.select("first")).union(many.select("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    center = many.join(degree, "node").groupBy("gid").agg(F.max(F.struct("degree", "node"))["node"].alias("first"))
    spokes = many.join(center, "gid").where("node <> first").select("first", "node")
    # a: a center, b: one around it, which has no more pairs than signatures
    pair = [F.least("first", "node").alias("x"), F.greatest("first", "node").alias("y")]
    star = two.union(spokes).groupBy(*pair).agg(F.min("node").alias("b")).select((F.col("x").bitwiseXOR(F.col("y")).bitwiseXOR(F.col("b"))).alias("a"), "b")
    star = materialize(star, "star")
    nodes = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    wanted = materialize(reps.join(nodes, "node"), "wanted")
    about = materialize(_load(docs, wanted, False), "candidates")
    rename = lambda x: about.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    near = star.join(rename("a"), "a").join(rename("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_sift, "a long, b long")
    labels = _rounds(materialize(near, "near"), docs, wanted, None)

    # what the stars leave: larger groups whose nodes are not all connected
    named = many.join(labels, "node", "left") if labels is not None else many.withColumn("comp", F.lit(None).cast("long"))
    named = named.select("gid", "node", "m", F.coalesce("comp", "node").alias("comp"))
    apart = named.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid")
    rest = materialize(named.join(apart, "gid"), "apart")
    # a node has no more groups than signatures
    firsts = rest.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("gid")), 1, FIRSTS).alias("firsts"))
    rest = rest.join(firsts, "node").join(about, "node")
    # tiles of a group meet in pairs; a node goes to as many tasks as its group has tiles
    tiles = F.ceil(F.col("m") / TILE).cast("long")
    rest = rest.withColumn("t", F.pmod(F.xxhash64("node"), tiles)).withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    rest = rest.select(
        "gid", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), "node", "comp", "n", "bits", "firsts",
        F.when(F.col("t") == F.col("u"), 2).when(F.col("t") < F.col("u"), 0).otherwise(1).cast("long").alias("side"),
    )
    more = rest.repartition("gid", "x", "y").sortWithinPartitions("gid", "x", "y").mapInArrow(_tiles, "a long, b long").distinct()
    more = more.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    labels = _rounds(materialize(more, "more"), docs, wanted, labels)

    if labels is None:
        named = reps.select("node", "fp", "rep").withColumn("component_id", F.col("rep"))
    else:
        own = reps.join(labels, "node", "left").select("node", "fp", "rep", F.coalesce("comp", "node").alias("comp"))
        least = own.join(labels.select("comp").distinct(), "comp").groupBy("comp").agg(F.min("rep").alias("least"))
        named = own.join(least, "comp", "left").select("node", "fp", F.coalesce("least", "rep").alias("component_id"))
    s = sizes.alias("s")
    found = s.join(named.alias("c"), (F.col("s.node") == F.col("c.node")) & (F.col("s.fp") == F.col("c.fp")) & (F.col("s.n") > 0), "left")
    return found.select("s.doc_id", F.col("s.n").alias("n_shingles"), F.when(F.col("s.doc_id").isNotNull(), F.coalesce("c.component_id", "s.doc_id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE_SQL: dict[str, str] = {}

"""Suffix-array dedup: remove bytes covered by a 50-byte string that also starts in an earlier document.

The suffixes sorted are those at anchors. An anchor is a position whose K-byte prefix has the smallest
hash of some window of W = LENGTH - K + 1 positions (winnowing), so every LENGTH-byte string holds
an anchor, and equal strings hold it at the same offset: looking at anchors alone loses no match.

1. Documents are written, concatenated, as blocks of about BLOCK bytes (texts are never cut; a longer
   text is a block), with a few sampled suffixes each.
2. Per block, the distinct hashes of anchor prefixes go to hash ranges; a range answers each block with
   a bit per hash: seen in two documents or not. Nothing else is looked at again, and a prefix that
   every document has costs one entry per block.
3. Anchors that pass are suffixes with LENGTH bytes to the right and W - 1 to the left, one per block and
   distinct content with the smallest doc_id. Splitters sampled in step 1 range-partition them by their
   leading LEAD bytes. As LEAD <= K, a boundary never parts two suffixes that share an anchor, so every
   comparison that a match needs is inside a bucket. A bucket sorts its right contexts, and its left
   contexts read backwards, by multikey quicksort over 8-byte symbols, which yields common prefix
   lengths of neighbours; for each offset o of an anchor in a LENGTH-byte string, strings are equal where
   right contexts share LENGTH - o bytes and left ones o. The least doc_id of each such class decides.
4. Blocks get their suffixes' answers back, mark the covered bytes and cut them out.

Strings are compared byte by byte in step 3; hashes only choose anchors and pass candidates on.

Defined results: a null text is empty; a row with a null doc_id takes no part and is returned whole;
rows with one doc_id are one document's: neither removes from the other; an empty table gives an empty
result; extra columns are ignored. The input table can't be changed by a retry: blocks are a
written table, so lost executors recompute the same blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table, temporary

LENGTH = 50
K = 20
W = LENGTH - K + 1
LEAD = 16
BLOCK = 4 << 20
CHUNK = 1 << 17
#: Bytes of text to a hash range and to a range of suffixes; both bound what one group of rows holds.
RANGE_BYTES = 8 << 20
SAMPLES = 64
#: Low bytes of a prefix's hash that are sent to its range.
HASH_BYTES = 5
SAMPLED_BLOCKS = 2000

_rng = np.random.default_rng(20240607)
_T32 = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_ODD32 = np.uint32(0x9E3779B1)
_ODD64 = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def _order_hash(b: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each position, by doubling; K = 16 + 4."""
    h, n, powers = _T32[b], 1, _ODD32
    four = None
    while n < 16:
        h = h[:-n] * powers + h[n:]
        powers = np.uint32(int(powers) ** 2 & 0xFFFFFFFF)
        n *= 2
        if n == 4:
            four, p4 = h, powers
    m = len(b) - K + 1
    h = h[:m] * p4 + four[16 : 16 + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(b: np.ndarray) -> np.ndarray:
    """Positions p with p + K <= len(b) that hold the least hash of a full window."""
    out = []
    for s in range(0, len(b), CHUNK):
        lo, hi = max(0, s - W + 1), min(len(b), s + CHUNK + W - 1 + K - 1)
        if hi - lo < LENGTH:
            continue
        h = _order_hash(b[lo:hi])
        least = np.zeros(len(h) + W - 1, np.uint32)
        least[W - 1 : len(h)] = _slide(h, W, np.minimum)
        p = np.flatnonzero(h == _slide(least, W, np.maximum)) + lo
        out.append(p[(p >= s) & (p < s + CHUNK)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD64[1]
    return x ^ (x >> np.uint64(29))


def row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.full(len(rows), 0x2545F4914F6CDD1D, np.uint64)
    for i, c in enumerate(wide.view(np.uint64).T):
        h = _mix(h * _ODD64[0] ^ (c + np.uint64(int(_ODD64[2]) * (i + 1) % (1 << 64))))
    return _mix(h)


class Block:
    """Texts of one block: bytes, document starts and ends, ids."""

    def __init__(self, text: bytes, ids: np.ndarray, lengths: np.ndarray):
        self.b = np.frombuffer(text, np.uint8)
        self.ids, self.ends = ids, np.cumsum(lengths)
        self.starts = self.ends - lengths

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(zstandard.decompress(row["text"]), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors inside one document, their documents' places, hashes of their prefixes."""
        p = anchors(self.b)
        d = np.searchsorted(self.ends, p, side="right")
        inside = p + K <= self.ends[d] if len(p) else np.zeros(0, bool)
        p, d = p[inside], d[inside]
        h = row_hash(np.lib.stride_tricks.sliding_window_view(self.b, K)[p]) if len(p) else np.zeros(0, np.uint64)
        return p, d, h


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_BLOCKS = pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("text", pa.binary()), ("sample", pa.binary())])
_BLOCKS_SQL = "block long, bytes long, ids binary, lengths binary, text binary, sample binary"


def _pack(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, seq = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def flush():
        nonlocal ids, texts, size, seq
        text = b"".join(texts)
        at = np.linspace(0, max(0, len(text) - LEAD), SAMPLES, dtype=np.int64) if len(text) >= LEAD else np.zeros(0, np.int64)
        sample = b"".join(text[i : i + LEAD] for i in at.tolist())
        lengths = np.array([len(t) for t in texts], np.int64)
        row = (first | seq, len(text), np.array(ids, np.int64).tobytes(), lengths.tobytes(), zstandard.compress(text, 3), sample)
        ids, texts, size, seq = [], [], 0, seq + 1
        return _batch(_BLOCKS, [row])

    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = (t.as_py() or "").encode()
            ids.append(i)
            texts.append(raw)
            size += len(raw)
            if size >= block_bytes:
                yield flush()
    if ids:
        yield flush()


_HASHES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("multi", pa.binary())])
_HASHES_SQL = "bucket int, block long, hashes binary, multi binary"


def _hash_rows(batches, n_buckets: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        block = Block.of(row)
        _, d, h = block.suffixes()
        distinct, multi = _distinct(h, block.ids[d])
        if not len(distinct):
            continue
        bucket = range_of(distinct, n_buckets)
        cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(distinct)]
        low = np.ascontiguousarray(distinct.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
        out = [(int(bucket[a]), row["block"], low[a:b].tobytes(), np.packbits(multi[a:b]).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if out:
            yield _batch(_HASHES, out)


def _distinct(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and whether two ids have each."""
    if not len(h):
        return h, np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)


def range_of(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n < 2^32 ranges of about equal length each 64-bit number is in; no list of the ranges is needed."""
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _wide(blob: bytes) -> np.ndarray:
    """Hashes of HASH_BYTES bytes each as numbers."""
    low = np.frombuffer(blob, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :HASH_BYTES] = low
    return out.view(np.uint64).ravel()


_BITS_SQL = "block long, bucket int, bits binary"


def _answer(rows: pa.Table) -> pa.Table:
    """Of one hash range: for each block that has some, a bit per hash that two documents share. Hashes keep their low
    bytes beside their range's number: a chance agreement lets through one more candidate."""
    blocks, hashes = rows.column("block").to_pylist(), [_wide(x) for x in rows.column("hashes").to_pylist()]
    multi = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool) for m, h in zip(rows.column("multi").to_pylist(), hashes, strict=True)]
    every = np.concatenate(hashes)
    every.sort()
    repeated = every[1:][every[1:] == every[:-1]]
    repeated = np.unique(np.concatenate([repeated, *(h[m] for h, m in zip(hashes, multi, strict=True))]))
    bucket = rows.column("bucket")[0].as_py()
    out: list[tuple] = []
    for b, h in zip(blocks, hashes, strict=True):
        at = np.searchsorted(repeated, h)
        at[at == len(repeated)] = 0
        hit = repeated[at] == h if len(repeated) else np.zeros(len(h), bool)
        if hit.any():
            out.append((b, bucket, np.packbits(hit).tobytes()))
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["block", "bucket", "bits"])


_SUFFIXES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
_SUFFIXES_SQL = "bucket int, block long, n long, blob binary"
#: In a blob of suffixes: right context, left context backwards, their lengths, then the least doc_id.
_WIDTH = LENGTH + (W - 1) + 2


def _suffix_rows(batches, n_buckets: int, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct repeated suffixes by range; and with bucket -1, where the block has them."""
    for row in _rows(batches):
        block = Block.of(row)
        p, d, h = block.suffixes()
        distinct, _ = _distinct(h, block.ids[d])
        bucket = range_of(distinct, n_buckets)
        chosen = np.zeros(len(distinct), bool)
        for answer in row["answers"]:
            a, b = np.searchsorted(bucket, [answer["bucket"], answer["bucket"] + 1])
            chosen[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
        keep = chosen[np.searchsorted(distinct, h)]
        p, d = p[keep], d[keep]
        if not len(p):
            continue
        right_n = np.minimum(LENGTH, block.ends[d] - p)
        left_n = np.minimum(W - 1, p - block.starts[d])
        padded = np.concatenate([np.zeros(W - 1, np.uint8), block.b, np.zeros(LENGTH, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, W - 1 + LENGTH)[p]
        x = np.empty((len(p), _WIDTH), np.uint8)
        x[:, :LENGTH] = view[:, W - 1 :] * (np.arange(LENGTH) < right_n[:, None])
        x[:, LENGTH:-2] = view[:, W - 2 :: -1][:, : W - 1] * (np.arange(W - 1) < left_n[:, None])
        x[:, -2], x[:, -1] = right_n, left_n
        first, inverse = distinct_rows(x)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, block.ids[d])
        x = x[first]
        lead = np.ascontiguousarray(x[:, :LEAD]).view(">u8").astype(np.uint64)
        to = _range_of(lead, splitters)
        order = np.lexsort((lead[:, 1], lead[:, 0]))  # by range, as these are of leads; neighbours share bytes, for compression
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out = []
        cut = np.flatnonzero(np.diff(to[order], prepend=-1, append=-2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            take = order[a:b]
            blob = zstandard.compress(x[take].tobytes() + least[take].tobytes(), 1)
            out.append((int(to[take[0]]), row["block"], int(b - a), blob))
        where = np.stack([p, place[inverse]]).astype(np.int64)
        out.append((-1, row["block"], len(p), zstandard.compress(where.tobytes(), 1)))
        yield _batch(_SUFFIXES, out)


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one row of each content, and for each row which of these it equals."""
    h = row_hash(x)
    order = np.argsort(h, kind="stable")
    s, y = h[order], x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if (y[1:][~new[1:]] != y[:-1][~new[1:]]).any():  # two contents with one hash
        _, first, inverse = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return first, inverse
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _range_of(lead: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of splitters not above each (high, low) pair."""
    pair = np.dtype([("a", ">u8"), ("b", ">u8")])
    keys = np.empty(len(lead), pair)
    keys["a"], keys["b"] = lead[:, 0], lead[:, 1]
    return np.searchsorted(splitters.view("S16"), keys.view("S16"), side="right").astype(np.int32)


def multikey_sort(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, and common prefix lengths of neighbours in it (0 first).

    Multikey quicksort with 8-byte symbols: ranges that are still equal are parted by their next symbol;
    rows alone in their range are done.
    """
    n, width = x.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = x
    symbols = wide.view(">u8").astype(np.uint64)
    order = np.argsort(symbols[:, 0], kind="stable")
    s = symbols[order, 0]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    for j in range(1, symbols.shape[1]):
        open_ = ~new | np.append(~new[1:], False)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        group, s = np.cumsum(new)[at], symbols[order[at], j]
        by = np.lexsort((s, group))
        order[at] = order[at][by]
        s, group = s[by], group[by]
        more = np.concatenate([[True], (s[1:] != s[:-1]) | (group[1:] != group[:-1])])
        new[at] |= more
    y = x[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = y[1:] != y[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


_DONE_SQL = "block long, bucket int, blob binary"


def cover(right, left, right_n, left_n, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix: the least id of its whole content, and how far left and right of the anchor a string
    that also is in a smaller id reaches, for its own id (0, 0: none)."""
    n = len(ids)
    ro, rl = multikey_sort(right)
    lo, ll = multikey_sort(left)
    # what equals what in whole; few of these are left to compare further
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_r[ro] = np.cumsum(rl < LENGTH)
    rank_l[lo] = np.cumsum(ll < W - 1)
    same = (rank_r * (n + 1) + rank_l) * 2048 + (right_n - K) * 32 + left_n
    _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, ids)
    rn, ln = right_n[first], left_n[first]
    far_left, far_right = np.full(len(first), -1), np.zeros(len(first), np.int64)
    for o in range(W):
        ok = np.flatnonzero((o <= ln) & (LENGTH - o <= rn))
        if len(ok) < 2:
            continue
        cr, cl = np.empty(n, np.int64), np.empty(n, np.int64)
        cr[ro], cl[lo] = np.cumsum(rl < LENGTH - o), np.cumsum(ll < o) if o else 0
        key = cr[first[ok]] * (n + 1) + cl[first[ok]]
        by = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[by], prepend=-1))
        smallest = np.repeat(np.minimum.reduceat(least[ok][by], at), np.diff(np.append(at, len(by))))
        hit = ok[by][least[ok][by] > smallest]
        far_right[hit] = np.where(far_left[hit] < 0, LENGTH - o, far_right[hit])
        far_left[hit] = o
    far_left = np.maximum(far_left, 0)
    return least[inverse], far_left[inverse], far_right[inverse]


def _bucket(rows: pa.Table) -> pa.Table:
    """Sort one range of suffixes and answer each block."""
    ns = rows.column("n").to_pylist()
    parts, ids = [], []
    for n, blob in zip(ns, rows.column("blob").to_pylist(), strict=True):
        raw = zstandard.decompress(blob)
        parts.append(np.frombuffer(raw, np.uint8, n * _WIDTH).reshape(n, _WIDTH))
        ids.append(np.frombuffer(raw[n * _WIDTH :], np.int64))
    x, ids = np.concatenate(parts), np.concatenate(ids)
    least, a, b = cover(x[:, :LENGTH], x[:, LENGTH:-2], x[:, -2].astype(np.int64), x[:, -1].astype(np.int64), ids)
    out, at = [], 0
    for n in ns:
        out.append(zstandard.compress(np.stack([least[at : at + n], a[at : at + n], b[at : at + n]]).tobytes(), 1))
        at += n
    return pa.table([rows.column("block"), rows.column("bucket"), pa.chunked_array([pa.array(out, pa.binary())])], names=["block", "bucket", "blob"])


def _finish(batches, length: int = LENGTH) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks with the mask of their covered bytes."""
    for row in _rows(batches):
        block = Block.of(row)
        edge = np.zeros(len(block.b) + 1, np.int64)
        if row["place"] is not None:
            p, which = np.frombuffer(zstandard.decompress(row["place"]), np.int64).reshape(2, -1)
            answers = [np.frombuffer(zstandard.decompress(x["blob"]), np.int64).reshape(3, -1) for x in sorted(row["answers"], key=lambda x: x["bucket"])]
            least, a, b = np.concatenate(answers, axis=1)[:, which]
            d = np.searchsorted(block.ends, p, side="right")
            # with a smaller id for the whole content, all strings of it that fit in the text are covered
            most_left = np.minimum(W - 1, p - block.starts[d])
            least_left = np.maximum(0, length - np.minimum(length, block.ends[d] - p))
            later = block.ids[d] > least
            fits = most_left >= least_left
            a = np.where(later, np.where(fits, most_left, 0), a)
            b = np.where(later, np.where(fits, length - least_left, 0), b)
            edge += np.bincount(p - a, minlength=len(edge)) - np.bincount(p + b, minlength=len(edge))
        yield block, np.cumsum(edge[:-1]) > 0


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batches) -> Iterator[pa.RecordBatch]:
    for block, mask in _finish(batches):
        rise = mask & ~np.concatenate([[False], mask[:-1]])
        out = []
        for i, a, b in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
            m = mask[a:b]
            removed = int(m.sum())
            spans = int(rise[a:b].sum()) + int(removed > 0 and m[0] and not rise[a])
            kept = block.b[a:b][~m] if removed else block.b[a:b]
            out.append((i, b - a, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        if out:
            yield _batch(_RESULT, out)


_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())])


def _cut(batches) -> Iterator[pa.RecordBatch]:
    for block, mask in _finish(batches):
        out = [(i, block.b[a:b][~mask[a:b]].tobytes()) for i, a, b in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True)]
        if out:
            yield _batch(_KEPT, out)


def _masked(docs: DataFrame, block_bytes: int, range_bytes: int) -> DataFrame:
    """Blocks with where their repeated suffixes are and what was found out about them."""
    spark = docs.sparkSession
    d = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = materialize(d.mapInArrow(lambda b: _pack(b, block_bytes), _BLOCKS_SQL), "blocks", "none")
    total, n_blocks = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-total // range_bytes))
    every = max(1, n_blocks // SAMPLED_BLOCKS)
    samples = blocks.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).select("sample").limit(4 * SAMPLED_BLOCKS).toArrow()
    keys = np.sort(np.frombuffer(b"".join(samples.column("sample").to_pylist()), np.uint8).reshape(-1, LEAD).copy().view(f"S{LEAD}").ravel())
    splitters = np.unique(keys[np.linspace(0, len(keys) - 1, n + 1, dtype=np.int64)[1:-1]]) if len(keys) and n > 1 else np.zeros(0, f"S{LEAD}")

    hashes = blocks.select("block", "ids", "lengths", "text").mapInArrow(lambda b: _hash_rows(b, n), _HASHES_SQL)
    with temporary(spark):
        bits = materialize(hashes.groupBy("bucket").applyInArrow(_answer, _BITS_SQL), "bits")
        answers = bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
        found = blocks.select("block", "ids", "lengths", "text").join(answers, "block").mapInArrow(lambda b: _suffix_rows(b, n, splitters), _SUFFIXES_SQL)
        found = materialize(found, "suffixes", "none", result=True)
    done = materialize(found.where("bucket >= 0").groupBy("bucket").applyInArrow(_bucket, _DONE_SQL), "covered", "none")
    done = done.groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
    place = found.where("bucket = -1").select("block", F.col("blob").alias("place"))
    known = place.join(done, "block")
    return blocks.select("block", "ids", "lengths", "text").join(known, "block", "left")


def dedup_digest(docs: DataFrame, block_bytes: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs(doc_id, text) -> sizes, counts of removed bytes and runs, digest of what is left."""
    with temporary(docs.sparkSession):
        out = materialize(_masked(docs, block_bytes, range_bytes).mapInArrow(_digest, _RESULT_SQL), "digests", result=True)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    zero = F.lit(0).cast("long")
    alone = docs.where(F.col("doc_id").isNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256")
    )
    return out.unionByName(alone)


def dedup(docs: DataFrame, block_bytes: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the bytes that are left (they may cut a character)."""
    with temporary(docs.sparkSession):
        out = materialize(_masked(docs, block_bytes, range_bytes).mapInArrow(_cut, "doc_id long, kept binary"), "kept", result=True)
    alone = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    return out.unionByName(alone)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}

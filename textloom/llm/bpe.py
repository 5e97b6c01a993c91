"""BPE encoding by a backtracking encoder, decoding by an offset table.

A pretoken's bytes are cut into vocabulary tokens as the merges would cut them, in linear time and
without merging. An Aho-Corasick automaton over the reversed tokens, run over the reversed bytes,
gives the longest token that starts at each byte. The encoder walks forward with these, and keeps a
token only if the pair (last token, token) is compatible: re-splitting both along their merges never
meets a merge that would have joined across their border earlier. If it isn't compatible, it tries the
next shorter prefix token, and if there is none, drops the last token and never returns to that border.
Compatibility answers are kept in a table. Decoding reads token bytes from one buffer by an offset
table, for all ids of a text at once.

Pretokens are encoded once per worker and held in a table of bounded size (MAX_WORDS, cleared when
full: a bound on memory, with no effect on results). Strings of special tokens in a text become these
tokens, as the tokenizers library does by default.

Defined results: a null text encodes as empty; repeated rows each get their row; extra columns pass
through ``encode`` (columns with the names of its outputs are replaced); an empty table gives an empty
result. Lone surrogates can't occur in Spark strings. Whole texts are encoded, one Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import table

MAX_WORDS = 400_000
#: White space as the vocabulary's own splitter has it, spelled out so that no library's \s matters.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: itself if printable, else 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for b, i in ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        # rank orders merges; a token that no merge makes is a byte, and never splits
        self.rank = {i: -1 for i in ids.values()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = ids[raw(a)], ids[raw(b)]
            z = ids[raw(a) + raw(b)]
            self.merged[x, y] = r
            if z not in self.split:
                self.split[z], self.rank[z] = (x, y), r
        self.compatible: dict[tuple[int, int], bool] = {}
        self.ids = ids
        self.prefix: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.single = [ids[bytes([b])] for b in range(256)]
        for b, i in ids.items():
            self.automaton.add_word(b[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        for b, i in ids.items():
            for n in range(len(b) - 1, 0, -1):
                if (p := ids.get(b[:n])) is not None:
                    self.prefix[i] = p
                    break
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = [len(b) for b in self.bytes]
        self.odd = {i for i in self.split if not self.whole(i)}  # tokens that merges of their own bytes never reach
        self.words: dict[str, tuple[bytes, str]] = {}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def pair(self, left: int, right: int) -> bool:
        """Would the merges leave the border between these two tokens in place?"""
        key = (left, right)
        if (known := self.compatible.get(key)) is not None:
            return known
        limit, x, y = 1 << 60, left, right
        while True:
            # the merge that would join x and y across the border comes before what made the larger pieces
            if self.merged.get((x, y), 1 << 60) < limit:
                out = False
                break
            rx, ry = self.rank[x], self.rank[y]
            # undo the later of the two merges; of two equal ones the left was made first, so undo the right
            if rx > ry:
                limit, x = rx, self.split[x][1]
            elif ry >= 0:
                limit, y = ry + 1, self.split[y][0]
            else:
                out = True
                break
        if len(self.compatible) > 4_000_000:
            self.compatible.clear()
        self.compatible[key] = out
        return out

    def tokens(self, b: bytes) -> list[int]:
        """Ids of one pretoken's bytes."""
        n = len(b)
        if n == 1:
            return [self.single[b[0]]]
        if (whole := self.ids.get(b)) is not None and whole not in self.odd:
            return [whole]
        longest = [-1] * n
        # matches with one end come longest first
        for end, i in self.automaton.iter(b[::-1].decode("latin-1")):
            if longest[end] < 0:
                longest[end] = i
        longest.reverse()
        length, prefix, known, odd = self.length, self.prefix, self.compatible, self.odd
        dead = bytearray(n + 1)  # borders from which the rest can't be reached
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            if token is not None:
                to = at + length[token]
                if dead[to] or (odd and token in odd):
                    token = prefix.get(token)
                elif not out or (self.pair(out[-1], token) if (ok := known.get((out[-1], token))) is None else ok):
                    out.append(token)
                    at = to
                    token = longest[at] if at < n else None
                else:
                    token = prefix.get(token)
            else:
                if not out:
                    raise ValueError("the vocabulary can't encode these bytes")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = prefix.get(token)
        return out

    def whole(self, token: int) -> bool:
        """Does a token survive its own bytes' merges? (Its halves must leave each other alone until its merge.)"""
        return token not in self.split or self._whole(token)

    @lru_cache(maxsize=None)  # noqa: B019  one codec per worker, at most the vocabulary's size
    def _whole(self, token: int) -> bool:
        x, y = self.split[token]
        limit = self.rank[token]
        if not (self.whole(x) and self.whole(y)):
            return False
        while True:
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                bound, x = rx, self.split[x][1]
            else:
                bound, y = ry + 1, self.split[y][0]
            if self.merged.get((x, y), 1 << 60) < min(bound, limit):
                return False

    def word(self, w: str) -> tuple[bytes, str]:
        ids = self.tokens(w.encode())
        if len(self.words) >= MAX_WORDS:
            self.words.clear()
        out = np.array(ids, np.uint32).tobytes(), ",".join(map(str, ids))
        if len(w) <= 64:
            self.words[w] = out
        return out

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids, and the same as decimal numbers joined by commas."""
        get, word = self.words.get, self.word
        if self.cut is None or not any(s in text for s in self.special):
            parts = [get(w) or word(w) for w in self.find(text)]
        else:
            parts = []
            for i, piece in enumerate(self.cut(text)):
                if i % 2:
                    parts.append((np.array([self.special[piece]], np.uint32).tobytes(), str(self.special[piece])))
                else:
                    parts += [get(w) or word(w) for w in self.find(piece)]
        return np.frombuffer(b"".join([p[0] for p in parts]), np.uint32), ",".join([p[1] for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        starts = self.offsets[ids]
        lengths = self.offsets[ids + np.uint32(1)] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
        return self.buffer[take].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(batches: Iterator[pa.RecordBatch], text: str, names: list[str], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        ids, counts = [], []
        for value in batch.column(text):
            got, _ = c.encode(value.as_py() or "")
            ids.append(got)
            counts.append(len(got))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts, pa.int64()), lists], names=[*names, "n_tokens", "ids"])


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The ``keep`` columns with n_tokens and ids (array<int>)."""
    path = path or vocabulary()
    names = [c for c in keep if c not in ("n_tokens", "ids")]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(lambda b: _encode(b, text, names, path), schema)


def _digest(batches: Iterator[pa.RecordBatch], text: str, names: list[str], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        counts, shas, decoded = [], [], []
        for value in batch.column(text):
            ids, joined = c.encode(value.as_py() or "")
            counts.append(len(ids))
            shas.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        new = [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, *DIGESTS])


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def digest(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Encode and decode each text in one pass; digests of the ids and of the decoded text, no ids leave the worker."""
    path = path or vocabulary()
    names = [c for c in keep if c not in DIGESTS]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(n, T.LongType() if n == "n_tokens" else T.StringType()) for n in DIGESTS])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(lambda b: _digest(b, text, names, path), schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}

"""Unicode text segmentation: word and sentence boundaries, as UTF-8 byte offsets."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unicode import class_map, pictographs

#: Latin texts are those of these code points only (no combining or formatting character, nothing that lower case moves
#: out of them). Their classes are few, so that one pattern finds words in the text itself, in Python and in the JVM.
LATIN = r"\u0000-¬®-įı-ȹȻ-Ƚȿ-ʯ‐-‧"
_LETTER = r"A-Za-zªµ¸ºÀ-ÖØ-öø-ʯ"
_JOIN = rf"(?:(?<=[{_LETTER}])[:.'·‘’․‧](?=[{_LETTER}])|(?<=[0-9])[,;.'‘’․](?=[0-9]))"
_RUN = rf"[{_LETTER}0-9_]*+(?:{_JOIN}[{_LETTER}0-9_]++)*+"
#: Word-like segments: runs with a letter or digit, and the pictographs and numbers among the rest.
LATIN_WORD = rf"(?<!_)_*+[{_LETTER}0-9]{_RUN}|[©®²³¹¼-¾]"
#: All segments.
LATIN_SEGMENT = rf"\r\n|[{_LETTER}0-9_]{_RUN}| ++|[\s\S]"
_LATIN_WORD, LATIN_SPLIT = re.compile(LATIN_WORD), re.compile(f"({LATIN_WORD})")
_NOT_LATIN = re.compile(f"[^{LATIN}]")
#: A segment is word-like with a character of these; Katakana's and others' class says so by script.
_WORD_LIKE = regex.compile(r"[\p{WB=ALetter}\p{WB=Hebrew_Letter}\p{WB=Numeric}\p{Extended_Pictographic}\p{Ideographic}\p{No}[^\p{Script=Common}\p{Script=Inherited}\p{Script=Unknown}]]", regex.V1)

_SB = (
    ("CR", "C"), ("LF", "L"), ("Sep", "S"), ("Extend", "E"), ("Format", "E"), ("Sp", "P"), ("Lower", "l"), ("Upper", "U"),
    ("OLetter", "O"), ("Numeric", "N"), ("ATerm", "A"), ("SContinue", "K"), ("STerm", "T"), ("Close", "Q"),
)
#: Where a sentence may end, on the string of class letters: a separator, or a terminator with what it keeps.
_END = re.compile(r"CL|[CLS]|(?P<term>[AT])(?P<close>Q*)(?P<space>P*)(?P<sep>CL|[CLS])?")
_LOWER_AHEAD = re.compile(r"[^OUlCLSAT]*l")


_SEGMENT = T.StructType(
    [T.StructField("byte_start", T.IntegerType()), T.StructField("byte_end", T.IntegerType())]
    + [T.StructField(n, T.BooleanType()) for n in ("word_like", "is_ascii", "has_ascii_upper")]
)


class _Classes(dict):
    def __missing__(self, c: int) -> str:
        return "o"


#: Word_Break classes and their letters; p and P are letters and others that are pictographs.
_WB = (
    ("CR", "C"), ("LF", "L"), ("Newline", "N"), ("Extend", "E"), ("Format", "F"), ("ZWJ", "Z"), ("Katakana", "K"), ("Hebrew_Letter", "H"), ("ALetter", "A"),
    ("Single_Quote", "q"), ("Double_Quote", "Q"), ("MidNumLet", "B"), ("MidLetter", "M"), ("MidNum", "m"), ("Numeric", "D"), ("ExtendNumLet", "X"),
    ("Regional_Indicator", "R"), ("WSegSpace", "S"),
)


def _word_pattern() -> re.Pattern[str]:
    """One segment on the string of class letters. In the rules below a blank stands for what extends a character."""
    letters = "(?:H Q (?=H)|[AHp] (?:[MBq] (?=[AHp]))?|D (?:[mBq] (?=D))?)"
    kana = "(?:K )"
    run = f"(?:X )*(?:{letters}+|{kana}+)?(?:(?:X )+(?:{letters}+|{kana}+)?)*"
    # a Hebrew letter keeps a single quote after it, which then ends the run unless a letter follows
    run = f"(?:{run}H q (?![AHp])|(?=[XAHpDK]){run})"
    base = f"(?:{run}|R (?:R )?|S+ |[^CLN] )"
    # a joiner holds the pictograph after it
    return re.compile(f"CL|[CLN]|{base}(?:(?<=Z)(?=[Pp]){base})*".replace(" ", "[EFZ]*+"))


_SEGMENT_OF = _word_pattern()


@lru_cache(maxsize=1)
def _word_classes() -> _Classes:
    table = _Classes(class_map("WB", _WB))
    for c in pictographs():
        table[c] = {"A": "p", "o": "P"}.get(table.get(c, "o"), table.get(c, "o"))
    return table


def word_boundaries(text: str) -> list[int]:
    """Character offsets of word boundaries, 0 and the end included; none for an empty text."""
    return [0, *(m.end() for m in _SEGMENT_OF.finditer(text.translate(_word_classes())))] if text else []


def is_word_like(segment: str) -> bool:
    return _WORD_LIKE.search(segment) is not None


def is_latin_text(text: str) -> bool:
    return text.isascii() or _NOT_LATIN.search(text) is None


def words(text: str) -> Iterator[tuple[int, int]]:
    """Character spans of word-like segments."""
    if is_latin_text(text):
        for m in _LATIN_WORD.finditer(text):
            yield m.span()
        return
    cuts = word_boundaries(text)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if is_word_like(text[a:b]):
            yield a, b


def byte_offsets(text: str) -> np.ndarray:
    """UTF-8 offset of each character of a text, and its end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=out[1:])
    return out


@lru_cache(maxsize=1)
def _sentence_classes() -> dict[int, str]:
    return class_map("SB", _SB)


@lru_cache(maxsize=1)
def _table() -> _Classes:
    return _Classes(_sentence_classes())


def sentence_boundaries(text: str) -> list[int]:
    """Character offsets of sentence boundaries, 0 and the end included; none for an empty text."""
    if not text:
        return []
    raw = text.translate(_table())
    # extending characters belong to what they follow, unless that is nothing or a separator
    kept = [i for i, c in enumerate(raw) if c != "E" or i == 0 or raw[i - 1] in "CLS"]
    s = "".join("o" if raw[i] == "E" else raw[i] for i in kept) if len(kept) < len(raw) or "E" in raw else raw
    at = [*kept, len(text)]
    out = [0]
    for m in _END.finditer(s):
        end = m.end()
        if m["term"] and not m["sep"]:
            after = s[end : end + 1]
            if after in ("K", "A", "T") and after:
                continue
            if m["term"] == "A":
                bare = not m["close"] and not m["space"]
                before = s[m.start() - 1 : m.start()] if m.start() else ""
                if bare and (after == "N" or (after == "U" and before and before in "Ul")):
                    continue
                if _LOWER_AHEAD.match(s, end):
                    continue
        if end < len(s):
            out.append(at[end])
    out.append(len(text))
    return out


def to_bytes(text: str, offsets: list[int]) -> list[int]:
    """UTF-8 offsets of ascending character offsets."""
    if text.isascii():
        return offsets
    out, last, total = [], 0, 0
    for o in offsets:
        total += len(text[last:o].encode())
        last = o
        out.append(total)
    return out


def lists(counts, values: pa.Array, null: pa.Array) -> pa.Array:
    """One Arrow list per count, of consecutive values; null where ``null`` is true."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=null if null.true_count else None)


def _breaks(texts: pa.Array, boundaries) -> pa.Array:
    rows = [[] if t is None else to_bytes(t, boundaries(t)) for t in texts.to_pylist()]
    return lists([len(r) for r in rows], pa.array([x for r in rows for x in r], pa.int32()), texts.is_null())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _word_breaks(texts: pa.Array) -> pa.Array:
    return _breaks(texts, word_boundaries)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _sentence_breaks(texts: pa.Array) -> pa.Array:
    return _breaks(texts, sentence_boundaries)


_UPPER = re.compile("[A-Z]")


@F.arrow_udf(T.ArrayType(_SEGMENT))
def _word_segments(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts.to_pylist():
        parts = segments(t or "")
        b = to_bytes(t or "", [0, *itertools.accumulate(map(len, parts))])
        rows.append([(b[i], b[i + 1], is_word_like(s), s.isascii(), _UPPER.search(s) is not None) for i, s in enumerate(parts)])
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
    fields = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return lists([len(r) for r in rows], pa.StructArray.from_arrays(fields, _SEGMENT.names), texts.is_null())


COUNTS = ("n_segments", "n_word_like", "n_non_ascii", "n_upper")


_LATIN_SEGMENT, _LATIN_LIKE = re.compile(LATIN_SEGMENT), re.compile(f"[{_LETTER}0-9©®²³¹¼-¾]")


def segments(text: str) -> list[str]:
    """What stands between word boundaries."""
    if is_latin_text(text):
        return _LATIN_SEGMENT.findall(text)
    cuts = word_boundaries(text)
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _counts(text: str) -> tuple[int, int, int, int]:
    parts = segments(text)
    like = _LATIN_LIKE.search if is_latin_text(text) else is_word_like
    wide = 0 if text.isascii() else sum(not s.isascii() for s in parts)
    return len(parts), sum(1 for s in parts if like(s)), wide, sum(1 for s in parts if not s.islower() and _UPPER.search(s))


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in COUNTS]))
def _word_counts(texts: pa.Array) -> pa.Array:
    columns = list(zip(*(_counts(t or "") for t in texts.to_pylist()), strict=True)) or [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS, mask=texts.is_null() if texts.null_count else None)


def is_latin(text: Column) -> Column:
    """Is the text one that LATIN_WORD applies to? (Java is slow to look for a character outside of many ranges.)"""
    return (F.octet_length(text) == F.char_length(text)) | text.rlike(rf"\A[{LATIN}]*+\z")


def latin_words(text: Column) -> Column:
    """array<string> of the word-like segments of a Latin text, in the JVM."""
    return F.regexp_extract_all(text, F.lit(LATIN_WORD), F.lit(0))


def word_counts(text: Column) -> Column:
    """struct of COUNTS: segments, word-like ones, ones with a non-ASCII character, ones with an ASCII capital (null: null).

    Counted where they are found, so that four numbers a text leave the worker. (Three filters over an array of segments
    in the JVM take twice as long.)
    """
    return _word_counts(text)


def word_breaks(text: Column) -> Column:
    """Byte offsets of word boundaries (null: null)."""
    return _word_breaks(text)


def sentence_breaks(text: Column) -> Column:
    """Byte offsets of sentence boundaries (null: null)."""
    return _sentence_breaks(text)


def word_segments(text: Column) -> Column:
    """Every segment between word boundaries with its properties."""
    return _word_segments(text)

"""Chinese character types and normalization, which need no dictionary."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first range that holds a code point names its type.
RANGES = (
    ("surrogate", 0xD800, 0xDFFF), ("surrogate", 0x10000, 0x10FFFF), ("hanzi", 0x4E00, 0x9FA5), ("letter", 0x41, 0x5A), ("letter", 0x61, 0x7A), ("digit", 0x30, 0x39),
    ("space", 0x20, 0x20), ("space", 0x09, 0x0A), ("space", 0x0D, 0x0D), ("space", 0x3000, 0x3000), ("delimiter", 0x21, 0xBB), ("delimiter", 0x2010, 0x2642),
    ("delimiter", 0x3001, 0x301E), ("fullwidth_letter", 0xFF21, 0xFF3A), ("fullwidth_letter", 0xFF41, 0xFF5A), ("fullwidth_digit", 0xFF10, 0xFF19), ("delimiter", 0xFE30, 0xFF63),
)


def char_type(code_point: int) -> str:
    return next((name for name, lo, hi in RANGES if lo <= code_point <= hi), "other")


_WIDE = "".join(chr(c) for lo, hi in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(lo, hi + 1))


def normalize(token: Column) -> Column:
    """Text of a letter or digit run: full width to ASCII, A to Z lower."""
    upper = "".join(map(chr, range(0x41, 0x5B)))
    return F.translate(F.translate(token, _WIDE, "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)), upper, upper.lower())


def normalize_token(text: Column, kind: Column) -> Column:
    """Text of a token by its type: letters and digits as normalize() has them, a delimiter is a comma, others stay."""
    plain = kind.isin("letter", "digit", "fullwidth_letter", "fullwidth_digit")
    return F.when(kind == "delimiter", F.lit(",")).when(plain, normalize(text)).otherwise(text)


#: UTF-16 units of a chunk.
CHUNK = 1024
_LINE_ENDS = "\r\n\u0085\u2028\u2029"


def chunks(text: str) -> Iterator[str]:
    """A text in pieces of CHUNK UTF-16 units at most, each up to the last end of a line in it; where it has none, it is
    as long as can be without parting a character."""
    at = 0
    while at < len(text):
        end, units = at, 0
        while end < len(text) and (wide := 1 + (ord(text[end]) > 0xFFFF)) + units <= CHUNK:
            units += wide
            end += 1
        if end < len(text):
            line = max(text.rfind(c, at, end) for c in _LINE_ENDS)
            end = line + 1 if line >= at else end
        yield text[at:end]
        at = end

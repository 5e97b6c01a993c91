"""Japanese user dictionaries (CSV of surface, segments, readings, part of speech) and character classes."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

_BLANK = "".join(map(chr, range(33)))
_SPACE = r"[ \t\n\x0B\f\r]"


class UserDictionaryError(ValueError):
    """A rule that can't be used; ``kind`` is duplicate, fields, surface or readings."""

    def __init__(self, kind: str, rule: str, line: int):
        super().__init__(f"{kind} in line {line}: {rule}")
        self.kind, self.rule, self.line = kind, rule, line


@dataclass(frozen=True)
class Entry:
    """surface: as typed; segments: how many UTF-16 units each has; readings: one to a segment."""

    surface: str
    lengths: tuple[int, ...]
    readings: tuple[str, ...]
    part_of_speech: str


def _fields(line: str) -> list[str]:
    """Fields of a CSV line: commas inside quotes are text; none if a quote is left open. Quotes around a field without
    others fall away, and a doubled quote is one."""
    if line.count('"') % 2:
        return []
    raw = re.findall(r'(?:^|,)((?:[^",]|"[^"]*")*)', line)
    plain = (m[1] if (m := re.fullmatch(r'"([^"]+)"', f)) else f for f in raw)
    return [f.replace('""', '"') for f in plain]


def _units(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


def _entry(text: str, line: int) -> Entry:
    fields = _fields(text)
    if len(fields) < 4:
        raise UserDictionaryError("fields", text, line)
    surface, segments, readings = fields[0], *([x for x in re.split(" +", f)] for f in fields[1:3])
    if re.sub(_SPACE, "", surface) != re.sub(_SPACE, "", fields[1]):
        raise UserDictionaryError("surface", text, line)
    if len(segments) != len(readings):
        raise UserDictionaryError("readings", text, line)
    return Entry(surface, tuple(len(_units(s)) // 2 for s in segments), tuple(readings), fields[3])


def _lines(rules: str) -> Iterator[tuple[int, str]]:
    """Rules with their numbers: comment lines count, blank ones do not."""
    texts = (t.strip(_BLANK) for t in re.split(r"\r\n|\r|\n", rules))
    for line, text in enumerate((t for t in texts if t), 1):
        if not text.startswith("#"):
            yield line, text


def user_dictionary(rules: str, lenient: bool = False) -> list[Entry]:
    """Entries in order of their UTF-16 units. Of rules with one surface the first counts, if ``lenient``."""
    found: dict[str, Entry] = {}
    for surface, same in itertools.groupby(sorted(((_fields(t) or [""])[0], n, t) for n, t in _lines(rules)), key=lambda x: x[0]):
        (_, line, text), *again = same
        if again and not lenient:
            raise UserDictionaryError("duplicate", surface, again[0][1])
        found[surface] = _entry(text, line)
    return sorted(found.values(), key=lambda e: _units(e.surface))


#: Classes, and whether an unknown word may start at one and runs of one are one word.
CLASSES = {
    "NGRAM": (False, False), "DEFAULT": (False, True), "SPACE": (False, True), "SYMBOL": (True, True), "NUMERIC": (True, True), "ALPHA": (True, True),
    "CYRILLIC": (True, True), "GREEK": (True, True), "HIRAGANA": (False, True), "KATAKANA": (True, True), "KANJI": (False, False), "KANJINUMERIC": (True, True),
}
#: First code points of classes, up to the next.
_STARTS = """
0 DEFAULT 9 SPACE C DEFAULT 20 SPACE 21 SYMBOL 30 NUMERIC 3A SYMBOL 41 ALPHA 5B SYMBOL 61 ALPHA 7B SYMBOL 7F DEFAULT A1 SYMBOL C0 ALPHA 237 DEFAULT 374 GREEK 3FC DEFAULT
400 CYRILLIC 4FA DEFAULT 500 CYRILLIC 510 DEFAULT 1E00 ALPHA 1EFA DEFAULT 2000 SYMBOL 2070 NUMERIC 20A0 SYMBOL 2150 NUMERIC 2190 SYMBOL 2400 DEFAULT 2460 SYMBOL 2500 DEFAULT
2501 SYMBOL 26FF DEFAULT 2700 SYMBOL 2980 DEFAULT 2A00 SYMBOL 2C00 DEFAULT 2E80 KANJI 2EF4 DEFAULT 2F00 KANJI 2FD6 DEFAULT 3000 SYMBOL 3040 DEFAULT 3041 HIRAGANA 30A0 DEFAULT
30A1 KATAKANA 30FB SYMBOL 30FC KATAKANA 3100 DEFAULT 31F0 KATAKANA 3200 SYMBOL 32FF DEFAULT 3300 SYMBOL 3400 KANJI 4DB6 DEFAULT 4E00 KANJI 9FA6 DEFAULT F900 KANJI FA2E DEFAULT
FA30 KANJI FA6B DEFAULT FE30 SYMBOL FE6C DEFAULT FF01 SYMBOL FF10 NUMERIC FF1A SYMBOL FF20 DEFAULT FF21 ALPHA FF3B SYMBOL FF41 ALPHA FF5B SYMBOL FF66 KATAKANA FFA0 DEFAULT
FFE0 SYMBOL FFF0 DEFAULT
""".split()
KANJI_NUMERALS = "一七万三九二五億兆八六十千四百"
_AT, _NAMES = [int(x, 16) for x in _STARTS[::2]], _STARTS[1::2]


def char_class(c: str) -> str:
    """Class of a character; of one beyond the basic plane, that of its surrogates."""
    return "KANJINUMERIC" if c in KANJI_NUMERALS else _NAMES[bisect_right(_AT, min(ord(c), 0xD800)) - 1] if ord(c) > 0xFFFF else _NAMES[bisect_right(_AT, ord(c)) - 1]


#: Where Korean classes differ from the Japanese ones; the others of KANJI are HANJA.
KOREAN = ((0xC, 0xC, "DEFAULT"), (0xE, 0x1F, "DEFAULT"), (0xD, 0xD, "SPACE"), (0x1100, 0x11FF, "HANGUL"), (0x3130, 0x318F, "HANGUL"), (0xAC00, 0xD7A3, "HANGUL"), (0x2F00, 0x2FD5, "KANJI"))
KOREAN_CLASSES = {**CLASSES, "HIRAGANA": (True, True), "HANGUL": (False, True), "HANJA": (False, False), "HANJANUMERIC": (True, True)}


def korean_char_class(c: str) -> str:
    name = next((name for lo, hi, name in KOREAN if lo <= ord(c) <= hi), None)
    return name or {"KANJI": "HANJA", "KANJINUMERIC": "HANJANUMERIC"}.get(char_class(c), char_class(c))

"""Korean filters and user dictionary rules, none of which needs a system dictionary."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .japanese import KOREAN, dropping, number, simple_lower

#: The tags that are dropped unless others are given.
DEFAULT_STOP_TAGS = frozenset("EP EF EC ETN ETM IC JKS JKC JKG JKO JKB JKV JKQ JX JC MAG MAJ MM SP SSC SSO SC SE XPN XSA XSN XSV UNA NA VSV".split())
#: All tags.
TAGS = DEFAULT_STOP_TAGS | frozenset("NNB NNBC NNG NNP NP NR SF SH SL SN SY VA VCN VCP VV VX XR UNKNOWN".split())
#: Right connection ids of a user's noun by how its rule ends.
RIGHT_PLAIN, RIGHT_OPEN, RIGHT_CODA = 3533, 3534, 3535


def parse_tags(spec: str) -> frozenset[str]:
    """Tags of a list separated by commas or white space, in either case."""
    names = [s.upper() for s in re.split(r"[, \t\n]+", spec) if s]
    for n in names:
        if n not in TAGS:
            raise ValueError(f"unknown part-of-speech tag {n!r}")
    return frozenset(names)


def part_of_speech_stop(tokens: list[dict], tags: frozenset[str] = DEFAULT_STOP_TAGS) -> list[dict]:
    """Drop tokens by their left tag; what follows takes over their increments."""
    return dropping(tokens, lambda t: t["left_pos"] in tags)


def reading_form(token: Column) -> Column:
    """Text of a token struct with a reading: the reading, if there is one."""
    return F.coalesce(token["reading"], token["text"])


def numbers(tokens: list[dict]) -> list[dict]:
    return number(tokens, KOREAN)


def analyze_tail(tokens: list[dict], tags: frozenset[str] = DEFAULT_STOP_TAGS) -> list[dict]:
    """What the analyzer does after tokenizing: stop tags, readings, lower case."""
    kept = part_of_speech_stop(tokens, tags)
    return [{**t, "text": simple_lower(t["reading"] if t.get("reading") is not None else t["text"])} for t in kept]


@dataclass(frozen=True)
class Noun:
    """A user dictionary's entry; lengths: of the parts it decomposes into, in UTF-16 units."""

    surface: str
    right_id: int
    lengths: tuple[int, ...]


class UserDictionaryError(ValueError):
    """A rule that can't be used; ``kind`` is duplicate, too_long or splits_character."""

    def __init__(self, kind: str, rule: str, line: int):
        super().__init__(f"{kind} in line {line}: {rule}")
        self.kind, self.rule, self.line = kind, rule, line


def _units(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


#: Code points of the class of Korean letters.
HANGUL = ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3))


def _right_id(rule: str) -> int:
    last = ord(rule[-1])
    if not any(lo <= last <= hi for lo, hi in HANGUL):
        return RIGHT_PLAIN
    # a syllable without a final consonant is a multiple of 28 from the first; letters alone never are
    return RIGHT_OPEN if last >= 0xAC00 and (last - 0xAC00) % 28 == 0 else RIGHT_CODA


@dataclass(frozen=True)
class _Rule:
    """A line of a user dictionary by itself."""

    line: int
    text: str
    surface: str
    parts: tuple[str, ...]

    @property
    def key(self) -> bytes:
        return _units(self.surface)

    @property
    def lengths(self) -> tuple[int, ...]:
        return tuple(len(_units(p)) // 2 for p in self.parts)

    def check(self) -> None:
        """Parts fit into the surface, and none ends inside a character."""
        if sum(self.lengths) > len(self.key) // 2:
            raise UserDictionaryError("too_long", self.text.strip(), self.line)
        ends = {len(_units(self.surface[:i])) // 2 for i in range(len(self.surface) + 1)}
        if not ends.issuperset(itertools.accumulate(self.lengths)):
            raise UserDictionaryError("splits_character", self.text.strip(), self.line)


def _rules(rules: str) -> Iterator[_Rule]:
    for line, text in enumerate(re.split(r"\r\n|\r|\n", rules), 1):
        said = text.partition("#")[0]
        if said.strip("".join(map(chr, range(33)))):
            surface, *parts = re.split(r"[ \t\n\x0B\f\r]+", said.rstrip(" \t\n\x0B\f\r"))
            yield _Rule(line, said, surface, tuple(parts))


def user_dictionary(rules: str, lenient: bool = False) -> list[Noun]:
    """Entries of rules ``surface [part ...]``, in order of their UTF-16 units; # starts a comment. Of rules with one surface
    the first counts, if ``lenient``."""
    out: list[Noun] = []
    for _, same in itertools.groupby(sorted(_rules(rules), key=lambda r: r.key), key=lambda r: r.key):
        first, *again = same
        first.check()
        if again and not lenient:
            raise UserDictionaryError("duplicate", first.surface, again[0].line)
        out.append(Noun(first.surface, _right_id(first.text), first.lengths))
    return out

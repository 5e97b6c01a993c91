"""What stemmers share: the longest ending of a word among some, and regions.

Stemmers follow the definitions published by the Snowball project (https://snowballstem.org/, BSD licence; the
notice is in textloom/functions/stopwords.py); their lists of endings are fixed values of these.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words a stemmer remembers.
CACHE = 200_000


@lru_cache(maxsize=None)
def _by_length(endings: str) -> tuple[tuple[int, frozenset[str]], ...]:
    every = endings.split()
    return tuple((n, frozenset(s for s in every if len(s) == n)) for n in sorted({len(s) for s in every}, reverse=True))


def longest(w: str, endings: str, start: int = 0) -> str | None:
    """The longest of the endings (a list separated by blanks) that w ends with, in the region from ``start``."""
    room = len(w) - start
    for n, some in _by_length(endings):
        if n <= room and w[-n:] in some:
            return w[-n:]
    return None


@lru_cache(maxsize=None)
def _pattern(p: str) -> re.Pattern[str]:
    return re.compile(p)


def after(w: str, pattern: str, at: int = 0) -> int:
    """Where the first match of a pattern from ``at`` on ends, or the word's end."""
    m = _pattern(pattern).search(w, at)
    return m.end() if m else len(w)


def regions(w: str, vowels: str, at: int = 0) -> tuple[int, int]:
    """R1 and R2: after the first non-vowel after a vowel, and the same again from there."""
    vc = f"[{vowels}][^{vowels}]"
    r1 = after(w, vc, at)
    return r1, after(w, vc, r1)


def romance_rv(w: str, vowels: str) -> int:
    """RV of Italian, Portuguese, Romanian and Spanish."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return after(w, f"[{vowels}]", 2)
    return after(w, f"[^{vowels}]", 2) if w[0] in vowels else 3


def cut(w: str, ending: str | None) -> str:
    return w[: -len(ending)] if ending else w

"""The English (Porter2) stemmer, from its published definition."""

from __future__ import annotations

import re
from functools import lru_cache

from .stemming import CACHE, longest

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
#: Fixed values of the definition.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"
_ENDS2, _ENDS3 = " ".join(_STEP2), " ".join(_STEP3)


_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if head is None:
        m = _REGION.search(w)
        head = m.end() if m else len(w)
    m = _REGION.search(w, head)
    return head, m.end() if m else len(w)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V + "wxY"


def _has_vowel(w: str) -> bool:
    return any(c in _V for c in w)


@lru_cache(maxsize=CACHE)
def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) < 3:
        return word
    w = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if w[0] == "'":
        w = w[1:]
    if w in _WHOLE:
        return _WHOLE[w]
    if len(w) < 3:
        return w
    # a y that is a consonant is written Y
    if "y" in w:
        w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    in_r1, in_r2 = lambda s: len(w) - len(s) >= r1, lambda s: len(w) - len(s) >= r2
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    s = longest(w, "eed eedly ed edly ing ingly")
    if s in ("eed", "eedly"):
        if in_r1(s):
            w = w[: -len(s)] + "ee"
    elif s and _has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _short_syllable(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    s = longest(w, _ENDS2)
    if s and in_r1(s) and not (s == "ogi" and not w.endswith("logi")) and not (s == "li" and w[-3:-2] not in tuple(_LI)):
        w = w[: -len(s)] + _STEP2[s]
    # 3
    s = longest(w, _ENDS3)
    if s and in_r1(s) and not (s == "ative" and not in_r2(s)):
        w = w[: -len(s)] + _STEP3[s]
    # 4
    s = longest(w, _STEP4)
    if s and in_r2(s) and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e"):
        if in_r2("e") or (in_r1("e") and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and in_r2("l"):
        w = w[:-1]
    return w.replace("Y", "y")

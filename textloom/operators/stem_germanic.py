"""German, Dutch, Swedish, Norwegian and Danish stemmers, from the published Snowball definitions."""

from __future__ import annotations

import re
from functools import lru_cache

from .stemming import CACHE, after, cut, longest, regions


_DE = "aeiouyäöü"


@lru_cache(maxsize=CACHE)
def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_DE}])u(?=[{_DE}])", "U", w)
    w = re.sub(f"(?<=[{_DE}])y(?=[{_DE}])", "Y", w)
    r1, r2 = regions(w, _DE)
    r1 = max(r1, min(3, len(w)))
    s = longest(w, "em ern er e en es s", 0)
    if s and len(w) - len(s) >= r1:
        if s == "s":
            if w[-2:-1] in tuple("bdfghklmnrt"):
                w = w[:-1]
        else:
            w = w[: -len(s)]
            if s in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    s = longest(w, "en er est st", 0)
    if s and len(w) - len(s) >= r1 and (s != "st" or (w[-3:-2] in tuple("bdfghklmnt") and len(w) >= 6)):
        w = w[: -len(s)]
    s = longest(w, "end ung ig ik isch lich heit keit", 0)
    if s and len(w) - len(s) >= r2:
        if s in ("end", "ung"):
            w = w[: -len(s)]
            if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            if w[-len(s) - 1 : -len(s)] != "e":
                w = w[: -len(s)]
        elif s in ("lich", "heit"):
            w = w[: -len(s)]
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = w[: -len(s)]
            t = next((t for t in ("lich", "ig") if w.endswith(t)), None)
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
    return w.translate(str.maketrans("UYäöü", "uyaou"))


def _north(w: str, vowels: str, main: str, s_after: str) -> tuple[str, int]:
    r1 = max(regions(w, vowels)[0], min(3, len(w)))
    s = longest(w, main + " s", r1)
    if s == "s":
        if len(w) > 1 and w[-2] in s_after:
            w = w[:-1]
    elif s:
        w = w[: -len(s)]
    return w, r1


#: Fixed values of the definitions.
_SV_MAIN = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"
_NO_MAIN = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast"
_DA_MAIN = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"


@lru_cache(maxsize=CACHE)
def swedish(word: str) -> str:
    w, r1 = _north(word, "aeiouyäåö", _SV_MAIN, "bcdfghjklmnoprtvy")
    if longest(w, "dd gd nn dt gt kt tt", r1):
        w = w[:-1]
    s = longest(w, "lig ig els fullt löst", r1)
    if s in ("lig", "ig", "els"):
        w = w[: -len(s)]
    elif s:
        w = w[:-1]
    return w


@lru_cache(maxsize=CACHE)
def norwegian(word: str) -> str:
    v = "aeiouyæåø"
    r1 = max(regions(word, v)[0], min(3, len(word)))
    w = word
    s = longest(w, _NO_MAIN + " s erte ert", r1)
    if s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s == "s":
        if w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or (w[-2:-1] == "k" and w[-3:-2] not in ("", *v)):
            w = w[:-1]
    elif s:
        w = w[: -len(s)]
    if longest(w, "dt vt", r1):
        w = w[:-1]
    s = longest(w, "leg eleg ig eig lig elig els lov elov slov hetslov", r1)
    return w[: -len(s)] if s else w


@lru_cache(maxsize=CACHE)
def danish(word: str) -> str:
    w, r1 = _north(word, "aeiouyæåø", _DA_MAIN, "abcdfghjklmnoprtvyzå")
    if longest(w, "gd dt gt kt", r1):
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    s = longest(w, "ig lig elig els løst", r1)
    if s == "løst":
        w = w[:-1]
    elif s:
        w = w[: -len(s)]
        if longest(w, "gd dt gt kt", r1):
            w = w[:-1]
    if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø":
        w = w[:-1]
    return w


_NL = "aeiouyè"


def _undouble(w: str) -> str:
    return w[:-1] if w.endswith(("kk", "dd", "tt")) else w


def _dutch_en(w: str, s: str, r1: int) -> str:
    head = cut(w, s)
    return _undouble(head) if len(head) >= r1 and head[-1:] and head[-1] not in _NL and not head.endswith("gem") else w


def _dutch_e(w: str, r1: int) -> tuple[str, bool]:
    if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _NL:
        return _undouble(w[:-1]), True
    return w, False


@lru_cache(maxsize=CACHE)
def dutch(word: str) -> str:
    w = word.translate(str.maketrans("äáëéïíöóüú", "aaeeiioouu"))
    w = re.sub(f"^y|(?<=[{_NL}])y", "Y", w)
    w = re.sub(f"(?<=[{_NL}])i(?=[{_NL}])", "I", w)
    r1, r2 = regions(w, _NL)
    if r1 < 3:
        r1 = min(3, len(w))
    s = longest(w, "heden en ene s se")
    if s == "heden":
        w = cut(w, s) + "heid" if len(w) - 5 >= r1 else w
    elif s in ("en", "ene"):
        w = _dutch_en(w, s, r1)
    elif s and len(w) - len(s) >= r1 and cut(w, s)[-1:] not in ("", *_NL, "j"):
        w = cut(w, s)
    w, e_found = _dutch_e(w, r1)
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        if w.endswith("en"):
            w = _dutch_en(w, "en", r1)
    s = longest(w, "end ing ig lijk baar bar")
    if s and len(w) - len(s) >= r2:
        head = cut(w, s)
        if s in ("end", "ing"):
            w = head[:-2] if head.endswith("ig") and len(head) - 2 >= r2 and head[-3:-2] != "e" else _undouble(head)
        elif s == "ig":
            w = head if not head.endswith("e") else w
        elif s == "lijk":
            w = _dutch_e(head, r1)[0]
        elif s == "baar" or e_found:
            w = head
    if re.search(f"[^{_NL}](?:aa|ee|oo|uu)[^{_NL}I]$", w):
        w = w[:-2] + w[-1]
    return w.lower()

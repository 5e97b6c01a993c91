"""Finnish and Hungarian stemmers, from the published Snowball definitions."""

from __future__ import annotations

import re
from functools import lru_cache

from .stemming import CACHE, cut, longest, regions

_F = "aeiouyäö"
_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
#: Fixed values of the definition.
_F_PARTICLES = "kin kaan kään ko kö han hän pa pä sti"
_F_POSSESSIVE = {"an": "ta ssa sta lla lta na", "än": "tä ssä stä llä ltä nä", "en": "lle ine"}
_F_CASE = "han hen hin hon hän hön siin den tten seen a ä tta ttä ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine n"
_F_OTHER = "mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä"


def _finnish_possessive(w: str, r1: int) -> str:
    s = longest(w, "si ni nsa nsä mme nne an än en", r1)
    if s is None:
        return w
    head = cut(w, s)
    if s == "si":
        return w if head.endswith("k") else head
    if s == "ni":
        return head[:-3] + "ksi" if head.endswith("kse") else head
    if s in _F_POSSESSIVE:
        return head if longest(head, _F_POSSESSIVE[s]) else w
    return head


def _finnish_case(w: str, r1: int) -> str | None:
    s = longest(w, _F_CASE, r1)
    if s is None:
        return None
    head = cut(w, s)
    if s in ("han", "hen", "hin", "hon", "hän", "hön"):
        return head if head.endswith(s[1]) else None
    if s in ("siin", "den", "tten"):
        return head if len(head) > 1 and head[-1] == "i" and head[-2] in "aeiouäö" else None
    if s == "seen":
        return head if head.endswith(_LONG) else None
    if s in ("a", "ä"):
        return head if len(head) > 1 and head[-1] in _F and head[-2] not in _F else None
    if s in ("tta", "ttä"):
        return head if head.endswith("e") else None
    return head[:-1] if s == "n" and head.endswith((*_LONG, "ie")) else head


@lru_cache(maxsize=CACHE)
def finnish(word: str) -> str:
    w = word
    r1, r2 = regions(w, _F)
    s = longest(w, _F_PARTICLES, r1)
    if s and (len(w) - len(s) >= r2 if s == "sti" else cut(w, s)[-1:] in tuple(_F + "nt")):
        w = cut(w, s)
    w = _finnish_possessive(w, r1)
    case = _finnish_case(w, r1)
    if case is not None:
        w = case
    s = longest(w, _F_OTHER, r2)
    if s and not (s in ("mpi", "mpa", "mpä", "mmi", "mma", "mmä") and cut(w, s).endswith("po")):
        w = cut(w, s)
    if case is not None:
        w = w[:-1] if w[-1:] in ("i", "j") and len(w) > r1 else w
    elif w.endswith("t") and len(w) > r1 and w[-2:-1] in tuple(_F):
        w = w[:-1]
        s = longest(w, "mma imma", r2)
        if s and not (s == "mma" and cut(w, s).endswith("po")):
            w = cut(w, s)
    if w.endswith(_LONG) and len(w) - 2 >= r1:
        w = w[:-1]
    if len(w) - 2 >= r1 and w[-1:] in ("a", "ä", "e", "i") and w[-2] not in _F:
        w = w[:-1]
    if len(w) - 2 >= r1 and w.endswith(("oj", "uj")):
        w = w[:-1]
    if len(w) - 2 >= r1 and w.endswith("jo"):
        w = w[:-1]
    # a double consonant, the last of the word, becomes one
    return re.sub(f"([^{_F}])\\1(?=[{_F}]*$)", r"\1", w, count=1) if re.search(f"([^{_F}])\\1[{_F}]*$", w) else w


_H = "aeiouöüáéíóőúű"
_DOUBLES = "bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs"
#: Fixed values of the definition.
_H_CASE = "ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként anként ként en on an ön n t"
_H_OWNED = {"oké": "", "öké": "", "aké": "", "eké": "", "éké": "e", "áké": "a", "ké": "", "ééi": "e", "áéi": "a", "éi": "", "éé": "e", "é": ""}
_H_SINGULAR = {
    "ünk": "", "unk": "", "ánk": "a", "énk": "e", "nk": "", "ájuk": "a", "éjük": "e", "juk": "", "jük": "", "uk": "", "ük": "", "em": "", "om": "", "am": "",
    "ám": "a", "ém": "e", "m": "", "od": "", "ed": "", "ad": "", "öd": "", "ád": "a", "éd": "e", "d": "", "ja": "", "je": "", "a": "", "e": "", "o": "", "á": "a", "é": "e",
}
_H_PLURAL_OWNER = (
    {s: "" for s in "jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik".split()}
    | {s: "a" for s in "áim áid ái áink áitok áik".split()}
    | {s: "e" for s in "éim éid éi éink éitek éik".split()}
)
_H_PLURAL = {"ák": "a", "ék": "e", "ök": "", "ak": "", "ok": "", "ek": "", "k": ""}


def _hungarian_r1(w: str) -> int:
    if not w:
        return 0
    if w[0] in _H:
        m = re.compile(f"[^{_H}]").search(w)
        if not m:
            return len(w)
        digraph = re.compile("dzs|cs|gy|ly|ny|sz|ty|zs").match(w, m.start())
        return digraph.end() if digraph else m.end()
    m = re.compile(f"[{_H}]").search(w)
    return m.end() if m else len(w)


def _replaced(w: str, to: dict[str, str], r1: int) -> str:
    s = longest(w, " ".join(to))
    return cut(w, s) + to[s] if s and len(w) - len(s) >= r1 else w


def _undoubled(w: str, endings: str, r1: int) -> str:
    """w without an ending that stands after a double consonant, and that made single."""
    s = longest(w, endings)
    if s and len(w) - len(s) >= r1 and longest(cut(w, s), _DOUBLES):
        w = cut(w, s)
        return w[:-2] + w[-1]
    return w


@lru_cache(maxsize=CACHE)
def hungarian(word: str) -> str:
    r1 = _hungarian_r1(word)
    w = _undoubled(word, "al el", r1)
    s = longest(w, _H_CASE)
    if s and len(w) - len(s) >= r1:
        w = _replaced(cut(w, s), {"á": "a", "é": "e"}, r1)
    w = _replaced(w, {"án": "a", "én": "e", "ánként": "a"}, r1)
    w = _replaced(w, {"astul": "", "estül": "", "stul": "", "stül": "", "ástul": "a", "éstül": "e"}, r1)
    w = _undoubled(w, "á é", r1)
    for to in (_H_OWNED, _H_SINGULAR, _H_PLURAL_OWNER, _H_PLURAL):
        w = _replaced(w, to, r1)
    return w

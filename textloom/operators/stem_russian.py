"""The Russian stemmer, from the published Snowball definition."""

from __future__ import annotations

from functools import lru_cache

from .stemming import CACHE, after, cut, longest

_V = "аеиоуыэюя"
#: Fixed values of the definition; the first of each pair stand after а or я.
_GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
_PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"


def _pair(w: str, endings: tuple[str, str], rv: int) -> str | None:
    s = longest(w, " ".join(endings), rv)
    if s is None:
        return None
    head = cut(w, s)
    if s in endings[0].split() and not (len(head) > rv and head[-1] in "ая"):
        return None
    return head


@lru_cache(maxsize=CACHE)
def russian(word: str) -> str:
    w = word
    rv = after(w, f"[{_V}]")
    r2 = after(w, f"[^{_V}]", rv)
    r2 = after(w, f"[{_V}]", r2) if r2 < len(w) else r2
    r2 = after(w, f"[^{_V}]", r2) if r2 < len(w) else r2
    head = _pair(w, _GERUND, rv)
    if head is None:
        w = cut(w, longest(w, "ся сь", rv))
        if s := longest(w, _ADJECTIVE, rv):
            head = cut(w, s)
            shorter = _pair(head, _PARTICIPLE, rv)
            head = head if shorter is None else shorter
        else:
            head = _pair(w, _VERB, rv)
            if head is None:
                head = cut(w, longest(w, _NOUN, rv))
    w = head
    if w.endswith("и") and len(w) > rv:
        w = w[:-1]
    s = longest(w, "ост ость", rv)
    if s and len(w) - len(s) >= r2:
        w = cut(w, s)
    s = longest(w, "ейше ейш н ь", rv)
    if s == "ь":
        return w[:-1]
    if s in ("ейше", "ейш"):
        w = cut(w, s)
    if s and w.endswith("нн") and len(w) - 1 > rv:
        w = w[:-1]
    return w

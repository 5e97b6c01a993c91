"""Character classes of segmentation, built from the installed property tables when a worker first needs them, and the
maps of lower case and folding, which are fixed."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import regex

#: The 25 code points of White_Space, as ranges of a character class.
WHITE_SPACE = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

_EVERY = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))


@lru_cache(maxsize=None)
def class_map(prop: str, codes: tuple[tuple[str, str], ...]) -> dict[int, str]:
    """Code point -> letter, for a property's values; a str.translate table, others absent."""
    out: dict[int, str] = {}
    for value, letter in codes:
        for m in regex.finditer(rf"\p{{{prop}={value}}}", _EVERY):
            out[ord(m[0])] = letter
    return out


@lru_cache(maxsize=1)
def pictographs() -> frozenset[int]:
    return frozenset(ord(m[0]) for m in regex.finditer(r"\p{Extended_Pictographic}", _EVERY))


#: Lower case of Unicode 17, as runs first-last, /2 where only every second code point has one, and what
#: is added to a code point. The one that becomes two, U+0130, is apart.
LOWER = """
41-5A+32 C0-D6+32 D8-DE+32 100-12E/2+1 132-136/2+1 139-147/2+1 14A-176/2+1 178-121 179-17D/2+1 181+210 182-184/2+1
186+206 187+1 189-18A+205 18B+1 18E+79 18F+202 190+203 191+1 193+205 194+207 196+211 197+209 198+1 19C+211 19D+213
19F+214 1A0-1A4/2+1 1A6+218 1A7+1 1A9+218 1AC+1 1AE+218 1AF+1 1B1-1B2+217 1B3-1B5/2+1 1B7+219 1B8+1 1BC+1 1C4+2 1C5+1
1C7+2 1C8+1 1CA+2 1CB-1DB/2+1 1DE-1EE/2+1 1F1+2 1F2-1F4/2+1 1F6-97 1F7-56 1F8-21E/2+1 220-130 222-232/2+1 23A+10795
23B+1 23D-163 23E+10792 241+1 243-195 244+69 245+71 246-24E/2+1 370-372/2+1 376+1 37F+116 386+38 388-38A+37 38C+64
38E-38F+63 391-3A1+32 3A3-3AB+32 3CF+8 3D8-3EE/2+1 3F4-60 3F7+1 3F9-7 3FA+1 3FD-3FF-130 400-40F+80 410-42F+32
460-480/2+1 48A-4BE/2+1 4C0+15 4C1-4CD/2+1 4D0-52E/2+1 531-556+48 10A0-10C5+7264 10C7+7264 10CD+7264 13A0-13EF+38864
13F0-13F5+8 1C89+1 1C90-1CBA-3008 1CBD-1CBF-3008 1E00-1E94/2+1 1E9E-7615 1EA0-1EFE/2+1 1F08-1F0F-8 1F18-1F1D-8
1F28-1F2F-8 1F38-1F3F-8 1F48-1F4D-8 1F59-1F5F/2-8 1F68-1F6F-8 1F88-1F8F-8 1F98-1F9F-8 1FA8-1FAF-8 1FB8-1FB9-8
1FBA-1FBB-74 1FBC-9 1FC8-1FCB-86 1FCC-9 1FD8-1FD9-8 1FDA-1FDB-100 1FE8-1FE9-8 1FEA-1FEB-112 1FEC-7 1FF8-1FF9-128
1FFA-1FFB-126 1FFC-9 2126-7517 212A-8383 212B-8262 2132+28 2160-216F+16 2183+1 24B6-24CF+26 2C00-2C2F+48 2C60+1
2C62-10743 2C63-3814 2C64-10727 2C67-2C6B/2+1 2C6D-10780 2C6E-10749 2C6F-10783 2C70-10782 2C72+1 2C75+1
2C7E-2C7F-10815 2C80-2CE2/2+1 2CEB-2CED/2+1 2CF2+1 A640-A66C/2+1 A680-A69A/2+1 A722-A72E/2+1 A732-A76E/2+1
A779-A77B/2+1 A77D-35332 A77E-A786/2+1 A78B+1 A78D-42280 A790-A792/2+1 A796-A7A8/2+1 A7AA-42308 A7AB-42319 A7AC-42315
A7AD-42305 A7AE-42308 A7B0-42258 A7B1-42282 A7B2-42261 A7B3+928 A7B4-A7C2/2+1 A7C4-48 A7C5-42307 A7C6-35384
A7C7-A7C9/2+1 A7CB-42343 A7CC-A7DA/2+1 A7DC-42561 A7F5+1 FF21-FF3A+32 10400-10427+40 104B0-104D3+40 10570-1057A+39
1057C-1058A+39 1058C-10592+39 10594-10595+39 10C80-10CB2+64 10D50-10D65+32 118A0-118BF+32 16E40-16E5F+32
16EA0-16EB8+27 1E900-1E921+34
"""
LOWER_OF_0130 = "i\u0307"


@lru_cache(maxsize=1)
def simple_lower_map() -> dict[int, int]:
    """Code point -> code point, the same at any version of the installed Unicode tables; U+0130 becomes i."""
    out = {0x130: ord("i")}
    for run in LOWER.split():
        first, last, step, add = re.match(r"(\w+)(?:-(\w+))?(/2)?([+-]\d+)$", run, re.ASCII).groups()
        for c in range(int(first, 16), int(last or first, 16) + 1, 2 if step else 1):
            out[c] = c + int(add)
    return out


@lru_cache(maxsize=1)
def lower_map() -> dict[int, str]:
    """Full lower case of each code point by itself: no rule looks at neighbours, so sigma is never final."""
    return {c: chr(x) for c, x in simple_lower_map().items()} | {0x130: LOWER_OF_0130}


@lru_cache(maxsize=1)
def lower_strings() -> tuple[str, str]:
    """simple_lower_map() but U+0130, as the two strings of a translate()."""
    m = {c: x for c, x in sorted(simple_lower_map().items()) if c != 0x130}
    return "".join(map(chr, m)), "".join(map(chr, m.values()))


#: Where letters, digits and full-width forms are that fold by rule.
FOLD_RANGES = (
    (0xB2, 0xB3), (0xB9, 0xB9), (0xC0, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1D2B), (0x1D62, 0x1D9A), (0x1E00, 0x1EFF), (0x2070, 0x2094), (0x2184, 0x2184),
    (0x2460, 0x2500), (0x2776, 0x2793), (0x2C60, 0x2C7C), (0xA728, 0xA786), (0xFB00, 0xFB06), (0xFF01, 0xFF5E),
)
#: What stays in these ranges.
FOLD_NOT = "ƢƣɹɺɻᴑᴒᴓᴝᴟỽⱹꝪꝫꝬꝭꝸﬅ｀｜"
#: Foldings that the rule does not give.
FOLD = {
    '"': "«»“”„″‶❝❞❮❯", "'": "‘’‚‛′‵‹›❛❜", "-": "‐‑‒–—⁻₋", "(": "❨❪", ")": "❩❫", "((": "⸨", "))": "⸩", "[": "⁅❲", "]": "⁆❳", "<": "❬❰", ">": "❭❱", "{": "❴", "}": "❵",
    "!!": "‼", "!?": "⁉", "??": "⁇", "?!": "⁈", "%": "⁒", "*": "⁎", "/": "⁄", ";": "⁏", "^": "‸", "~": "⁓",
    "A": "Ə", "a": "əɚᶕₔⱯ", "C": "ʗ", "c": "Ꜿ", "D": "ÐƉᴆ", "d": "ð", "dz": "ʥ", "F": "ꟻ", "f": "ẛ", "G": "ǥǧ", "HV": "Ƕ", "I": "Ɩᵻꟾ", "i": "ᵼ", "M": "ꟽꟿ", "N": "Ŋ", "n": "ŉŋ",
    "OE": "Œ", "oe": "œ", "p": "ꟼ", "Q": "Ɋ", "q": "ĸ", "S": "ꞅ", "s": "Ꞅ", "SS": "ẞ", "ss": "ß", "TH": "ÞꝦ", "th": "þꝧ", "tc": "ʨ", "U": "Ʉᵾ", "u": "ʉ", "V": "Ꝩ", "W": "Ƿ", "w": "ƿ",
    "Z": "Ȝ", "z": "ȝ",
}
#: The letter that a letter's name says: of plain, turned, reversed and other forms alike.
_LETTER = re.compile(
    r"LATIN (CAPITAL LETTER SMALL CAPITAL|LETTER SMALL CAPITAL|CAPITAL LETTER|(?:SUBSCRIPT )?SMALL LETTER)"
    r"(?: (?:TURNED|REVERSED|SIDEWAYS|OPEN|CLOSED|DOTLESS|LONG|INSULAR|BROKEN|VISIGOTHIC|INVERTED|STRETCHED|SCRIPT|LONG-LEGGED|HALF|EPIGRAPHIC"
    r"|MIDDLE-WELSH|BOTTOM HALF|TOP HALF|CLOSED REVERSED OPEN|REVERSED FISHHOOK|TAILLESS|BARRED))*? ([A-Z]{1,2})(?: (?:WITH .*|INSULAR|DIGRAPH|ROTUNDA))?$"
)
_NUMBER = re.compile(r"CIRCLED (?:SANS-SERIF )?(?:DIGIT|NUMBER) (\w+)$")
_NUMBERS = "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN TWENTY".split()


def _folded(c: str) -> str | None:
    """By rule: a circled number; else the compatibility decomposition without marks; else the letter named.

    Names and decompositions of assigned characters never change, so any installed version gives the same.
    """
    if m := _NUMBER.search(unicodedata.name(c, "")):
        return str(_NUMBERS.index(m[1]))
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    if plain.isascii():
        return plain
    m = _LETTER.match(unicodedata.name(c, "")) or _LETTER.match(unicodedata.name(plain[0], ""))
    return (m[2] if "SMALL LETTER" not in m[1] else m[2].lower()) if m else None


@lru_cache(maxsize=1)
def fold_map() -> dict[int, str]:
    """Code point -> ASCII, 1,242 of them."""
    out: dict[int, str] = {}
    for lo, hi in FOLD_RANGES:
        for c in range(lo, hi + 1):
            if chr(c) not in FOLD_NOT and unicodedata.name(chr(c), "") and (to := _folded(chr(c))):
                out[c] = to
    return out | {ord(c): to for to, chars in FOLD.items() for c in chars}

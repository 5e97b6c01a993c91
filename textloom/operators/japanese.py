"""Japanese filters that need no dictionary: on texts (with a byte map back), and on arrays of token structs.

Text maps without context are Column expressions in the JVM; the rest are plain Python functions and
Arrow-batched UDFs over them. A token is a struct with at least text, position_increment, byte_start,
byte_end; filters that read part of speech, base form or reading take structs that have them.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal, localcontext

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.unicode import lower_map, lower_strings

# -- text maps ------------------------------------------------------------------------------------

#: Small kana and the large ones they stand for.
HIRAGANA_SMALL, HIRAGANA_LARGE = "ぁぃぅぇぉっゃゅょゎゕゖ", "あいうえおつやゆよわかけ"
KATAKANA_SMALL, KATAKANA_LARGE = "ァィゥェォヵㇰヶㇱㇲッㇳㇴㇵㇶㇷㇸㇹㇺャュョㇻㇼㇽㇾㇿヮ", "アイウエオカクケシスツトヌハヒフヘホムヤユヨラリルレロワ"
FULL_ASCII = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_KANA = "".join(map(chr, range(0xFF65, 0xFFA0)))


def _wide(c: str) -> str:
    """Full width of a half-width kana or mark; the voiced marks become combining ones, as NFKC has it."""
    return unicodedata.normalize("NFKC", c)


WIDTH = {ord(c): chr(ord(c) - 0xFEE0) for c in FULL_ASCII} | {ord(c): _wide(c) for c in HALF_KANA}


def _voiced(kana: str, mark: str) -> str | None:
    """The kana composed with a half-width voicing mark, if there is such a letter."""
    if not "ウ" <= kana <= "ヽ":
        return None
    one = unicodedata.normalize("NFC", kana + _wide(mark))
    return one if len(one) == 1 else None


def cjk_width(text: str) -> tuple[str, list[int]]:
    """Full-width ASCII to ASCII, half-width kana to kana with their marks; and for each output character
    and the end, the input character it starts at. A mark joins a kana once."""
    out, at = [], []
    free = False
    for i, c in enumerate(text):
        if c in "ﾞﾟ" and free and (one := _voiced(out[-1], c)):
            out[-1], free = one, False
            continue
        out.append(c.translate(WIDTH))
        at.append(i)
        free = True
    return "".join(out), [*at, len(text)]


def cjk_width_token(text: str) -> str:
    """The token form: a second mark may join what a first one made."""
    out: list[str] = []
    for c in text:
        if c in "ﾞﾟ" and out and (one := _voiced(out[-1], c)):
            out[-1] = one
        else:
            out.append(c.translate(WIDTH))
    return "".join(out)


_MARKS = {"々": "kanji", "ゝ": "kana", "ゞ": "kana", "ヽ": "kana", "ヾ": "kana"}


def _in_row(c: str) -> bool:
    return "か" <= c <= "ぼ" or "カ" <= c <= "ボ"


def _with_voice(c: str) -> str:
    one = unicodedata.normalize("NFC", c + "゙")
    return one if _in_row(c) and len(one) == 1 else c


def _without_voice(c: str) -> str:
    two = unicodedata.normalize("NFD", c)
    return two[0] if _in_row(c) and len(two) == 2 and two[1] == "゙" else c


def iteration_marks(text: str, kanji: bool = True, kana: bool = True) -> str:
    """Marks replaced by what they repeat: a run of n marks repeats the n characters before it.

    A run can't reach back over an earlier run, a full stop or a supplementary character, and one that
    touches these stays a mark, as do the marks that follow it directly.
    """
    on = {m for m, k in _MARKS.items() if (kanji if k == "kanji" else kana)}
    out: list[str] = []
    closed = 0  # characters before this can't be repeated by a new run
    run, until = 0, 0
    for i, c in enumerate(text):
        if c == "。" or ord(c) > 0xFFFF:
            closed = until = i + 1
        if c not in on:
            out.append(c)
            continue
        if i >= until:
            if i == closed:
                closed = until = i + 1
                out.append(c)
                continue
            n = 1
            while text[i + n : i + n + 1] in on and i + n < len(text):
                n += 1
            run = min(n, i - closed)
            closed = until = i + run
        source = text[i - run]
        kana_of = "ぁ" <= source <= "ん" if c in "ゝゞ" else "ァ" <= source <= "ン"
        if c in "ゝヽ":
            out.append(_without_voice(source) if kana_of else source)
        elif c in "ゞヾ":
            out.append(_with_voice(source) if kana_of else source)
        else:
            out.append(source)
    return "".join(out)


# -- numbers --------------------------------------------------------------------------------------

#: Digits and powers of ten.
JAPANESE_DIGITS, JAPANESE_POWERS = "〇一二三四五六七八九", {"十": 1, "百": 2, "千": 3, "万": 4, "億": 8, "兆": 12, "京": 16, "垓": 20}
KOREAN_DIGITS, KOREAN_POWERS = "영일이삼사오육칠팔구", {"십": 1, "백": 2, "천": 3, "만": 4, "억": 8, "조": 12, "경": 16, "해": 20}


class Numerals:
    """Reads numbers of one script: basic [small power], summed, times [large power], summed."""

    def __init__(self, digits: str, powers: dict[str, int]):
        self.value = {c: i % 10 for s in ("0123456789", "０１２３４５６７８９", digits) for i, c in enumerate(s)}
        self.powers = powers
        basic = "[" + "".join(self.value) + ".．,，]+"
        small, large = ("[" + "".join(c for c, p in powers.items() if lo <= p <= hi) + "]" for lo, hi in ((1, 3), (4, 99)))
        self._medium = re.compile(f"(?P<b>{basic})(?P<p>{small})?|(?P<q>{small})")
        self._large = re.compile(large)

    def is_numeral(self, s: str) -> bool:
        return all(c in self.value or c in self.powers for c in s)

    @staticmethod
    def is_punctuation(s: str) -> bool:
        return all(c in ".．,，" for c in s)

    def _basic(self, s: str) -> Decimal | None:
        plain = "".join("" if c in ",，" else "." if c in ".．" else str(self.value[c]) for c in s)
        if not plain:
            return None
        if plain.count(".") > 1 or plain == ".":
            raise ValueError(s)
        return Decimal(plain)

    def normalize(self, s: str) -> str:
        """The plain decimal value of the number that s starts with, or s if there is none."""
        with localcontext() as ctx:
            ctx.prec = 40 + 25 * (len(s) + 1)
            total, at, some = Decimal(0), 0, False
            try:
                while True:
                    medium, found = Decimal(0), False
                    while m := self._medium.match(s, at):
                        if m["q"]:
                            part = Decimal(10) ** self.powers[m["q"]]
                        else:
                            basic = self._basic(m["b"])
                            power = Decimal(10) ** self.powers[m["p"]] if m["p"] else None
                            if basic is None and power is None:
                                at = m.end()
                                break
                            part = (Decimal(1) if basic is None else basic) * (Decimal(1) if power is None else power)
                        medium, found, at = medium + part, True, m.end()
                    if m := self._large.match(s, at):
                        total += (medium if found else Decimal(1)) * Decimal(10) ** self.powers[m[0]]
                        at = m.end()
                    elif found:
                        total += medium
                    else:
                        break
                    some = True
            except ValueError:
                return s
            if not some:
                return s
            plain = format(total, "f")
        return (plain.rstrip("0").rstrip(".") if "." in plain else plain) or "0"


JAPANESE, KOREAN = Numerals(JAPANESE_DIGITS, JAPANESE_POWERS), Numerals(KOREAN_DIGITS, KOREAN_POWERS)

# -- token filters --------------------------------------------------------------------------------


def dropping(tokens: list[dict], drop) -> list[dict]:
    """Tokens that stay; the increments of those dropped go to the next that stays."""
    out, owed = [], 0
    for t in tokens:
        if drop(t):
            owed += t["position_increment"]
        else:
            out.append({**t, "position_increment": t["position_increment"] + owed})
            owed = 0
    return out


#: The tags and words that are dropped unless others are given.
STOP_TAGS = frozenset(
    """
接続詞 助詞 助詞-格助詞 助詞-格助詞-一般 助詞-格助詞-引用 助詞-格助詞-連語 助詞-接続助詞 助詞-係助詞 助詞-副助詞 助詞-間投助詞 助詞-並立助詞 助詞-終助詞
助詞-副助詞／並立助詞／終助詞 助詞-連体化 助詞-副詞化 助詞-特殊 助動詞 記号 記号-一般 記号-読点 記号-句点 記号-空白 記号-括弧開 記号-括弧閉 その他-間投 フィラー 非言語音
""".split()
)
STOP_WORDS = frozenset(
    """
の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ
これ によって により おり より による ず なり られる において ば なかっ なく しかし について せ だっ その後 できる それ う ので なお のみ でき き つ における および いう
さらに でも ら たり その他 に関する たち ます ん なら に対して 特に せる 及び これら とき では にて ほか ながら うち そして とともに ただし かつて それぞれ または お ほど
ものの に対する ほとんど と共に といった です とも ところ ここ
""".split()
)


def part_of_speech_stop(tokens: list[dict], tags: frozenset[str] = STOP_TAGS) -> list[dict]:
    return dropping(tokens, lambda t: bool(t.get("part_of_speech")) and t["part_of_speech"] in tags)


def simple_lower(text: str) -> str:
    return text.replace("İ", "i").translate(lower_map())


def stop(tokens: list[dict], words: frozenset[str] = STOP_WORDS, ignore_case: bool = True) -> list[dict]:
    known = {simple_lower(w) for w in words} if ignore_case else words
    return dropping(tokens, lambda t: (simple_lower(t["text"]) if ignore_case else t["text"]) in known)


def reading_form(tokens: list[dict], romaji: bool = False) -> list[dict]:
    """Text becomes the reading; without one, a text with hiragana becomes katakana. With ``romaji``, in Latin letters."""
    shift = {c: c + 0x60 for c in range(0x3041, 0x3097)}
    read = [t["reading"] if t.get("reading") is not None else t["text"].translate(shift) for t in tokens]
    return [{**t, "text": hepburn(r) if romaji else r} for t, r in zip(tokens, read, strict=True)]


#: Pieces of a list of tokens, written as a letter each (n numeral, p separator, s stacked, o other): a run of numerals with
#: what may stop it, or one token.
_PIECES = re.compile("(?P<run>n[np]*)(?P<stop>s?)|.")


def number(tokens: list[dict], numerals: Numerals = JAPANESE) -> list[dict]:
    """A run of numeral tokens (separators within) becomes one with the value; its other attributes are those of the token
    after the run, or of its last. A stacked token stops a run unmerged: the run's first token and the stacked one, with the
    tokens it spans, come out, and what the run's other tokens but the last said is put before the next run's text."""
    kind = lambda t: "s" if t["position_increment"] == 0 else "n" if numerals.is_numeral(t["text"]) else "p" if numerals.is_punctuation(t["text"]) else "o"
    kinds = "".join(map(kind, tokens))
    out: list[dict] = []
    before, at = "", 0
    while at < len(tokens):
        piece = _PIECES.match(kinds, at)
        run = tokens[at : at + len(piece["run"] or "")]
        at = piece.end()
        if kinds[at - 1] == "s":
            spanned = tokens[at - 1].get("position_length", 1) or 1
            out += run[:1] + tokens[at - 1 : at - 1 + spanned]
            before += "".join(t["text"] for t in run[:-1])
            at += spanned - 1
        elif run:
            value = numerals.normalize(before + "".join(t["text"] for t in run))
            out.append({**tokens[min(at, len(tokens) - 1)], "text": value, "byte_start": run[0]["byte_start"], "byte_end": run[-1]["byte_end"]})
            before = ""
        else:
            out.append(tokens[at - 1])
    return out


# -- columns --------------------------------------------------------------------------------------


def lowercase(text: Column) -> Column:
    """Lower case of each code point; a capital dotted I becomes i."""
    return F.translate(F.replace(text, F.lit("\u0130"), F.lit("i")), *lower_strings())


def hiragana_uppercase(text: Column) -> Column:
    return F.translate(text, HIRAGANA_SMALL, HIRAGANA_LARGE)


def katakana_uppercase(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("ㇷ゚"), F.lit("プ")), KATAKANA_SMALL, KATAKANA_LARGE)


def katakana_stem(text: Column, minimum_length: int = 4) -> Column:
    """Drop a last prolonged sound mark of a katakana text of that many characters or more."""
    if minimum_length < 1:
        raise ValueError("minimum_length is 1 or more")
    return F.when((F.char_length(text) >= minimum_length) & text.rlike("^[\\u30A0-\\u30FF]+$"), F.regexp_replace(text, "ー$", "")).otherwise(text)


def base_form(token: Column) -> Column:
    """Text of a token struct with base_form."""
    return F.coalesce(token["base_form"], token["text"])


def _text_udf(f):
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return run


_width = _text_udf(lambda t: cjk_width(t)[0])
_hepburn = _text_udf(lambda t: hepburn(t))
_marks = {(kanji, kana): _text_udf(lambda t, kanji=kanji, kana=kana: iteration_marks(t, kanji, kana)) for kanji in (False, True) for kana in (False, True)}
_numbers = {id(n): _text_udf(n.normalize) for n in (JAPANESE, KOREAN)}


def width(text: Column) -> Column:
    return _width(text)


def expand_iteration_marks(text: Column, kanji: bool = True, kana: bool = True) -> Column:
    return _marks[kanji, kana](text)


def normalize_number(text: Column, numerals: Numerals = JAPANESE) -> Column:
    return (_numbers.get(id(numerals)) or _text_udf(numerals.normalize))(text)


def romanize(text: Column) -> Column:
    """Hepburn romanization of katakana."""
    return _hepburn(text)


def filtered(tokens: Column, kind: T.ArrayType, *steps) -> Column:
    """A column array<struct> of type ``kind`` through token filters (functions of a list of dicts), in one call."""

    @F.arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            for step in steps if row is not None else ():
                row = step(row)
            out.append(row)
        return pa.array(out, rows.type)

    return run(tokens)


def positions(tokens: Column) -> Column:
    """array<int> of positions: the sum of a token's and all earlier increments, less one."""
    steps = F.transform(tokens, lambda t: t["position_increment"])
    return F.transform(steps, lambda _, i: F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(-1), lambda a, x: a + x))


def next_base(tokens: Column, base: Column) -> Column:
    """Position that the next text of a row starts at: past the last position that a token of this one reaches."""
    ends = F.zip_with(positions(tokens), tokens, lambda p, t: p + t["position_length"])
    return base + F.coalesce(F.array_max(ends), F.lit(0))


def correct_offset(offset: Column, map_: Column) -> Column:
    """Byte of the original text for a byte of a filtered one; map: array<struct<filtered, original>>, ascending: the last
    entry at or before the byte, and what the byte is past it."""
    entry = F.element_at(F.filter(map_, lambda m: m["filtered"] <= offset), -1)
    return F.coalesce(entry["original"] + (offset - entry["filtered"]), offset)


# -- Hepburn romanization ---------------------------------------------------------------------------

#: Rows of kana by consonant, vowels a i u e o, a dot where there is none; and the irregular syllables.
_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "y": "ヤ.ユ.ヨ", "r": "ラリルレロ", "w": "ワ....",
    "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ", "v": "ヷヸ.ヹヺ", "l": "",
}
_IRREGULAR = {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu", "ヰ": "i", "ヱ": "e", "ヲ": "o", "ヴ": "v", "ッ": "", "ー": "", "ヮ": "wa"}
_FORMS = {
    "ウ": ("w", "ァィゥェォ"), "ヴ": ("v", "ァィェォ"), "ク": ("kw", "ァィェォヮ"), "グ": ("gw", "ァィェォヮ"), "ツ": ("ts", "ァィェォ"), "フ": ("f", "ァィェォ"), "ス": ("s", "ィ"), "ズ": ("z", "ィ"),
    "テ": ("t", "ィ"), "デ": ("d", "ィ"), "ト": ("t", "ゥ"), "ド": ("d", "ゥ"), "ホ": ("h", "ゥ"), "イ": ("y", "ィェ"),
}
_GLIDES = {"ウ": ("wy", "ュ"), "ヴ": ("vy", "ャュョ"), "ツ": ("tsy", "ュ"), "テ": ("ty", "ュ"), "デ": ("dy", "ュ"), "フ": ("fy", "ャュョ")}
_SMALL = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "ya", "ュ": "yu", "ョ": "yo", "ヮ": "wa"}


def _syllables() -> dict[str, str]:
    out = {kana: c + v for c, row in _ROWS.items() for kana, v in zip(row, "aiueo", strict=False) if kana != "."} | _SMALL | _IRREGULAR
    out |= {kana + "゜": "l" + v for kana, v in zip("ラリルレロ", "aiueo", strict=True)}
    for kana, (head, small) in _FORMS.items():
        out |= {kana + x: ("yi" if kana + x == "イィ" else head + _SMALL[x][-1]) for x in small}
    for kana, (head, small) in _GLIDES.items():
        out |= {kana + x: head + _SMALL[x][-1] for x in small}
    out |= {"ヴィェ": "vye", "フィェ": "fye"}
    for kana in "キシチニヒミリギジヂビピ":  # with a small y-kana or e
        head = out[kana][:-1] + ("" if kana in "シチジヂ" else "y")
        out |= {kana + x: head + _SMALL[x][-1] for x in ("ャュョェ" if kana != "ヂ" else "ャュョ")}
        out |= {kana + "ョウ": head + "ō", kana + "ュウ": head + "ū"}
    out |= {kana + "ウ": c + "ō" for c, row in _ROWS.items() for kana in row[4:5] if kana != "." and c != "v"}
    return out


_SYLLABLES = _syllables()
_SYLLABLE = re.compile("|".join(sorted(map(re.escape, _SYLLABLES), key=len, reverse=True)))
_DOUBLING = {c: kana for c, kana in (("k", "カキクケコ"), ("s", "サシスセソ"), ("t", "タチツテト"), ("p", "パピプペポ"))}
_DOUBLED = {kana: c for c, row in _DOUBLING.items() for kana in row}
_N = {**dict.fromkeys("アイウエオヤユヨ", "n'"), **dict.fromkeys("バビブベボパピプペポマミムメモ", "m")}


def hepburn(text: str) -> str:
    """Katakana in Latin letters, long o and u with a macron where they are spelled with ウ; other characters stay."""
    out, at = [], 0
    while at < len(text):
        c, after = text[at], text[at + 1 : at + 2]
        if c == "ン":
            out.append(_N.get(after, "n"))
        elif c == "ッ":
            out.append(_DOUBLED.get(after, ""))
        elif m := _SYLLABLE.match(text, at):
            out.append(_SYLLABLES[m[0]])
            at = m.end()
            continue
        else:
            out.append(c)
        at += 1
    return "".join(out)


# -- romanization by keystrokes ---------------------------------------------------------------------


def keystroke_table(lines) -> dict[str, list[str]]:
    """Katakana unit -> its spellings, of lines ``unit,spelling,...`` (# starts a comment; a later line replaces an earlier)."""
    out: dict[str, list[str]] = {}
    for line in lines:
        unit, *spellings = line.strip().rstrip(",").split(",")
        if spellings and not line.startswith("#"):
            out[unit] = spellings
    return out


def keystrokes(katakana: str, table: dict[str, list[str]]) -> list[str]:
    """All spellings that type a text, units matched longest first; from the first character that no unit
    starts with, the rest stays as it is. Nothing, if that is the first."""
    units = sorted(table, key=len, reverse=True)
    unit = re.compile("|".join(map(re.escape, units)) or "(?!)")
    out: list[str] = []
    at = 0
    while m := unit.match(katakana, at):
        more = table[m[0]]
        out = [p + c for c in more for p in out] if out else list(more)
        at = m.end()
    return [p + katakana[at:] for p in out]


_KANA = re.compile("[ぁ-ゖ゛-ゟ゠-ヿ]*")
_LETTERS = re.compile("[a-zａ-ｚ]*")
_KATAKANA_OR_LETTERS = re.compile("[゠-ヿa-zａ-ｚ]*")


def _typed_reading(t: dict) -> str:
    """What is typed for a token: its reading; without one, kana read as themselves, others as the word null."""
    if t.get("reading") is not None:
        return t["reading"]
    return t["text"].translate({c: c + 0x60 for c in range(0x3041, 0x3097)}) if _KANA.fullmatch(t["text"]) else "null"


def completion(tokens: list[dict], table: dict[str, list[str]], query: bool = False) -> list[dict]:
    """Each surface with, stacked on it, the keystrokes that type its reading; for queries, neighbouring kana
    tokens are one, and letters after another token belong to it (a half-typed syllable)."""
    kinds = "".join("k" if _KANA.fullmatch(t["text"]) else "l" if _LETTERS.fullmatch(t["text"]) else "o" for t in tokens)
    out: list[dict] = []
    for group in re.finditer("(?:k+|o)l?|l" if query else ".", kinds):
        part = tokens[group.start() : group.end()]
        typed = [t["text"] if i and kinds[group.start() + i] == "l" else _typed_reading(t) for i, t in enumerate(part)]
        reading = "".join(typed)
        spelled = keystrokes(reading, table) if reading and _KATAKANA_OR_LETTERS.fullmatch(reading) else []
        span = {"position_length": 1, "byte_start": part[0]["byte_start"], "byte_end": part[-1]["byte_end"]}
        surface = "".join(t["text"] for t in part)
        out += [{"text": x, "position_increment": int(i == 0), **span} for i, x in enumerate([surface, *spelled])]
    return out

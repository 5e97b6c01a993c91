"""Filters against recorded outputs (tests/golden): the tokenizer's tokens, put through a filter, are the recorded chain's."""

import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.unicode import fold_map, lower_map, simple_lower_map
from textloom.operators import chinese, japanese, japanese_dictionary, korean

HERE = os.path.join(os.path.dirname(__file__), "golden")
JA = ("part_of_speech", "base_form", "reading", "pronunciation", "inflection_type", "inflection_form")
KO = ("type", "left_pos", "right_pos", "reading", "morphemes")


def lines(path):
    with open(os.path.join(HERE, path), encoding="utf-8", newline="\n") as f:
        return f.read().split("\n")[:-1]


def unescape(s):
    one = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}
    s = re.sub(r"\\(?:u\{([0-9a-f]+)\}|(.))", lambda m: chr(int(m[1], 16)) if m[1] else one[m[2]], s)
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")


def tokens(path):
    """Cases of a file, each a list of tokens."""
    out, names, null = [], JA if path.startswith("ja") else KO, "\\N" if path.startswith("ja") else "-"
    for line in lines(path):
        if line.startswith("# "):
            out.append([])
            continue
        start, end, step, length, kind, *attributes, text = line.split("\t")
        t = {"text": unescape(text), "position_increment": int(step), "position_length": int(length), "byte_start": int(start), "byte_end": int(end), "kind": kind}
        out[-1].append(t | {n: None if a == null else unescape(a) for n, a in zip(names, attributes, strict=True)})
    return out


def texts(f):
    return lambda ts: [{**t, "text": f(t["text"])} for t in ts]


def stem(least):
    full = re.compile("[\u30a0-\u30ff]+")
    return texts(lambda s: s[:-1] if len(s) >= least and full.fullmatch(s) and s.endswith("ー") else s)


def mapped(a, b):
    return texts(lambda s: s.translate(str.maketrans(a, b)))


CHAINS = [
    ("ja/upstream.default.tokens", "ja/upstream.pos.chain", japanese.part_of_speech_stop),
    ("ja/upstream.default.tokens", "ja/upstream.reading.chain", japanese.reading_form),
    ("ja/upstream.default.tokens", "ja/upstream.romaji.chain", lambda ts: japanese.reading_form(ts, romaji=True)),
    ("ja/upstream.default.tokens", "ja/upstream.baseform.chain", lambda ts: [{**t, "text": t["base_form"] or t["text"]} for t in ts]),
    ("ja/upstream.default.tokens", "ja/upstream.stop.chain", japanese.stop),
    ("ja/upstream.default.tokens", "ja/upstream.stem.chain", stem(4)),
    ("ja/upstream.default.tokens", "ja/upstream.stem6.chain", stem(6)),
    ("ja/upstream.default.tokens", "ja/upstream.lowercase.chain", texts(japanese.simple_lower)),
    ("ja/upstream.default.tokens", "ja/upstream.hiragana_upper.chain", mapped(japanese.HIRAGANA_SMALL, japanese.HIRAGANA_LARGE)),
    ("ja/upstream.default.tokens", "ja/upstream.katakana_upper.chain", mapped(japanese.KATAKANA_SMALL, japanese.KATAKANA_LARGE)),
    ("ja/upstream.punct.tokens", "ja/upstream.number.chain", japanese.number),
    ("ko/upstream.default.tokens", "ko/upstream.reading.chain", lambda ts: [{**t, "text": t["reading"] or t["text"]} for t in ts]),
    ("ko/upstream.default.tokens", "ko/upstream.lowercase.chain", texts(japanese.simple_lower)),
    ("ko/upstream.default.tokens", "ko/upstream.number.chain", korean.numbers),
    ("ko/upstream.punct.tokens", "ko/upstream.number_punct.chain", lambda ts: korean.numbers(korean.part_of_speech_stop(ts, frozenset({"SP"})))),
    ("ko/upstream.mixed_punct.tokens", "ko/upstream.number_mixed_punct.chain", lambda ts: korean.numbers(korean.part_of_speech_stop(ts, frozenset({"SP"})))),
]


@pytest.mark.parametrize("given,want,f", CHAINS, ids=[w for _, w, _ in CHAINS])
def test_chains(given, want, f):
    whole = ("text", "position_increment", "position_length", "byte_start", "byte_end")
    cases, goldens = tokens(given), tokens(want)
    assert len(cases) == len(goldens) > 80
    for case, golden in zip(cases, goldens, strict=True):
        assert [[t[n] for n in whole] for t in f(case)] == [[t[n] for n in whole] for t in golden], case


def test_korean_analyzer():
    goldens = [[line.split("\t") for line in c.split("\n")[1:] if line] for c in ("\n".join(lines("ko/upstream.default.analyze"))).split("# ")[1:]]
    for case, golden in zip(tokens("ko/upstream.default.tokens"), goldens, strict=True):
        assert [t["text"] for t in korean.analyze_tail(case)] == [unescape(g[-1]) for g in golden]


def test_char_filters():
    cases = [unescape(x) for x in lines("ja/cases/upstream.txt")]
    kinds = {"itermark": (True, True), "itermark_kanji": (True, False), "itermark_kana": (False, True)}
    for name, (kanji, kana) in kinds.items():
        got = [x.split("\t", 1)[1] for x in lines(f"ja/charfilter.upstream.{name}.txt") if x.startswith("text\t")]
        assert [japanese.iteration_marks(c, kanji, kana) for c in cases] == [unescape(g) for g in got]
    text = [unescape(x.split("\t", 1)[1]) for x in lines("ja/charfilter.upstream.width.txt") if x.startswith("text")]
    maps = [[tuple(map(int, p.split(":"))) for p in x.split("\t")[1:] if p] for x in lines("ja/charfilter.upstream.width.txt") if x.startswith("map")]
    for c, t, m in zip(cases, text, maps, strict=True):
        out, at = japanese.cjk_width(c)
        assert out == t
        bytes_of = lambda s, i: len(s[:i].encode("utf-8", "surrogatepass"))
        assert [(bytes_of(out, i), bytes_of(c, a)) for i, a in enumerate(at)] == m, c


def test_romanization():
    cases = [unescape(x) for x in lines("ja/cases/romaji.txt")]
    got = [unescape(x.split("\t", 1)[1]) for x in lines("ja/romaji.txt") if x.startswith("hepburn")]
    assert [(c, japanese.hepburn(c)) for c in cases] == list(zip(cases, got, strict=True))


def test_numbers():
    cases = [unescape(x) for x in lines("ja/cases/numbers.txt")]
    assert [japanese.JAPANESE.normalize(c) for c in cases] == [unescape(x) for x in lines("ja/numbers.txt")]


def test_default_sets():
    want = {"tag": set(), "word": set()}
    for line in lines("ja/stoplists.txt"):
        kind, value = line.split("\t")
        want[kind].add(unescape(value))
    assert japanese.STOP_TAGS == want["tag"] and japanese.STOP_WORDS == want["word"]


def test_lower_case():
    pairs = dict(tuple(int(x, 16) for x in line.split("\t")) for line in lines("ko/lowercase.txt"))
    assert simple_lower_map() == pairs and len(pairs) == 1488
    assert {c: ord(x) for c, x in lower_map().items() if c != 0x130} == {c: x for c, x in pairs.items() if c != 0x130} and lower_map()[0x130] == "i̇"


def test_folding():
    """Folding by hand: one letter or sign of each kind of rule."""
    m = {chr(c): s for c, s in fold_map().items()}
    assert len(m) == 1242
    want = {"ƕ": "hv", "Ȣ": "OU", "ȸ": "db", "ǥ": "G", "ǧ": "G", "ß": "ss", "⑴": "(1)", "⒜": "(a)", "⒈": "1.", "Ⓐ": "A", "➓": "10", "ﬃ": "ffi", "．": ".", "⁻": "-", "₊": "+", "ᴀ": "A", "ɐ": "a", "ʀ": "R", "Ꜳ": "AA", "ꝏ": "oo"}
    assert {c: m[c] for c in want} == want
    assert not {"ª", "º", "½", "×", "ʰ", "｜", "ɹ"} & set(m)


@pytest.mark.parametrize("language,f", [("ja", japanese_dictionary.char_class), ("ko", japanese_dictionary.korean_char_class)])
def test_char_classes(language, f):
    rows = [line.split("\t") for line in lines(f"{language}/chardef.txt")]
    flags = japanese_dictionary.CLASSES if language == "ja" else japanese_dictionary.KOREAN_CLASSES
    assert all(flags[r[1]] == (r[2] == "1", r[3] == "1") for r in rows if r[0] == "class")
    for lo, hi, name in (r for r in rows if r[0] != "class"):
        for c in range(int(lo, 16), int(hi, 16) + 1):
            assert f(chr(c)) == name, hex(c)


def test_chinese_char_types():
    names = {"SPACE_LIKE": "space", "FULLWIDTH_LETTER": "fullwidth_letter", "FULLWIDTH_DIGIT": "fullwidth_digit"}
    for line in lines("zh/chartypes.txt"):
        lo, hi, name = line.split("\t")
        for c in range(int(lo, 16), int(hi, 16) + 1):
            assert chinese.char_type(c) == names.get(name, name.lower()), hex(c)


def dictionary(language, name):
    with open(os.path.join(HERE, language, "userdict", f"{name}.txt"), encoding="utf-8", newline="") as f:
        return f.read()


@pytest.mark.parametrize("name", ["dups", "edge", "empty", "es", "invalid", "lucene", "whitespace"])
def test_korean_user_dictionaries(name):
    golden = lines(f"ko/userdict.{name}.txt")
    if golden[0].startswith("error"):
        with pytest.raises(korean.UserDictionaryError):
            korean.user_dictionary(dictionary("ko", name), lenient=True)
        return
    want = [] if golden == ["empty"] else [tuple(unescape(x) for x in g.split("\t")[1:]) for g in golden]
    got = korean.user_dictionary(dictionary("ko", name), lenient=True)
    assert [(e.surface, str(i), str(e.right_id)) for i, e in enumerate(got)] == [w[:3] for w in want]


@pytest.mark.parametrize("name", ["docs", "dups", "edge", "empty", "es", "invalid_count", "invalid_surface", "lucene", "malformed_fields", "malformed_quotes", "whitespace"])
def test_japanese_user_dictionaries(name):
    golden = lines(f"ja/userdict.{name}.txt")
    if golden[0].startswith("error"):
        with pytest.raises(japanese_dictionary.UserDictionaryError):
            japanese_dictionary.user_dictionary(dictionary("ja", name), lenient=True)
        return
    want = [] if golden == ["empty"] else [[unescape(x) for x in g.split("\t")[1:]] for g in golden]
    got = japanese_dictionary.user_dictionary(dictionary("ja", name), lenient=True)
    assert [[e.surface, str(i), str(len(e.lengths)), *e.readings, e.part_of_speech] for i, e in enumerate(got)] == [[*w[:3], *w[3 + int(w[2]) :]] for w in want]
    if name == "dups":
        with pytest.raises(japanese_dictionary.UserDictionaryError, match="duplicate in line 6"):
            japanese_dictionary.user_dictionary(dictionary("ja", name))


def test_columns(spark):
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n in ("text", "kind", *JA) else T.IntegerType()) for n in ("text", "position_increment", "position_length", "byte_start", "byte_end", "kind", *JA)]))
    cases = [c for c in tokens("ja/upstream.default.tokens") if not any("\ud800" <= x <= "\udfff" for t in c for x in t["text"])][:60]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(1000, None)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("w", kind)]))
    steps = (japanese.part_of_speech_stop, japanese.stop, japanese.reading_form)
    rows = df.select("i", japanese.filtered(F.col("w"), kind, *steps).alias("out"), japanese.positions(F.col("w")).alias("p"), japanese.next_base(F.col("w"), F.lit(10)).alias("b")).collect()
    for r in rows:
        if r.i == 1000:
            assert r.out is None
            continue
        want, p, positions = cases[r.i], -1, []
        for t in want:
            p += t["position_increment"]
            positions.append(p)
        assert r.p == positions and r.b == 10 + max([x + t["position_length"] for x, t in zip(positions, want, strict=True)], default=0)
        for step in steps:
            want = step(want)
        assert [x.text for x in r.out] == [t["text"] for t in want]
    maps = spark.sql("SELECT array(struct(0 AS filtered, 0 AS original), struct(3 AS filtered, 6 AS original)) AS m")
    assert maps.select(japanese.correct_offset(F.lit(4), F.col("m"))).first()[0] == 7

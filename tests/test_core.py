"""Segmentation, analysis and match features."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import features, segment, sql
from textloom.functions.stopwords import LANGUAGES, stop_words
from textloom.operators import stem_english
from textloom.operators.analyzer import Analyzer, ascii_fold, lower
from textloom.streaming import text as streaming


def terms(text):
    return [(t, p) for t, p, *_ in Analyzer().analyze([text])]


WORDS = [
    ("can't stop 3,14 a_b x.y __", ["can't", "stop", "3,14", "a_b", "x.y"]),
    ("naïve café 日本 カナ 한국", ["naïve", "café", "日", "本", "カナ", "한국"]),
    ("", []),
    (" ,;! ", []),
    ("a.b. 1.2. x:y", ["a.b", "1.2", "x:y"]),
    ("👍🏽 ok", ["👍🏽", "ok"]),
]


@pytest.mark.parametrize("text,want", WORDS)
def test_words(text, want):
    assert [text[a:b] for a, b in segment.words(text)] == want


#: Segments by hand from the rules of UAX #29.
SEGMENTS = [
    "a", ".", "\n", "hello", "123", "abc123", "123abc", "a1b2", "\r\n", "\r\n|\r\n", "\n|\n", "a|\r\n|b", "a|   |c", "e.g|.| |hello", "example.com", "won't", "a_1", "_a",
    "can|'", "can|'| |hi", "א'", "א'א", "א'\u2060א", "א'a", "הצ'קרות", "לייף| |אנרג'י", "צה\u05f4ל", "אקספרס|\u05f4| |מהיום", "\u05f4|אקספרס|\u05f4| |מהיום",
    "👨\u200d👩", "👨|👩", "🇦", "🇦🇦", "🇦🇦|🇦", "\u200dⓂ", "カナ_カ|a", "'|a_", "א\"א", "א|\"", "1,2a.b", "1|,|a",
]


@pytest.mark.parametrize("marked", SEGMENTS)
def test_word_boundaries(marked):
    parts = marked.split("|")
    text = "".join(parts)
    cuts = segment.to_bytes(text, segment.word_boundaries(text))
    want = [0]
    for x in parts:
        want.append(want[-1] + len(x.encode()))
    assert cuts == want and segment.word_boundaries("") == []


def test_ascii_path_agrees_with_the_general_one():
    import random

    r = random.Random(3)
    for _ in range(2000):
        t = "".join(r.choice("aB1_.,:;' \n-") for _ in range(r.randint(0, 25)))
        cuts = segment.word_boundaries(t)
        assert [t[a:b] for a, b in segment.words(t)] == [t[a:b] for a, b in zip(cuts[:-1], cuts[1:]) if segment.is_word_like(t[a:b])], t


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []), ("one", [0, 3]), ("Hello there. How are you?", [0, 13, 25]), ("Mr. smith", [0, 9]), ("3.14 is", [0, 7]), ("A.B. C", [0, 5, 6]),
        ("a\r\nb\nc", [0, 3, 5, 6]), ("Yes!! (No.) Ok", [0, 6, 12, 14]), ("end.̈ Next", [0, 6, 10]), ("wait... what", [0, 12]),
    ],
)
def test_sentences(text, want):
    assert segment.sentence_boundaries(text) == want


def test_byte_offsets_recover_the_raw_text():
    text = "Straße ΣΟΦΟΣ İx — naïve"
    for token, _, _, a, b, _ in Analyzer(case_sensitive=True).analyze([text]):
        assert text.encode()[a:b].decode() == token
    assert [t for t, *_ in Analyzer().analyze([text])] == ["straße", "σοφοσ", "i̇x", "naïve"]
    assert [t for t, *_ in Analyzer(ascii_folding=True).analyze(["Straße Æon naïve ﬁt"])] == ["strasse", "aeon", "naive", "fit"]


def test_positions_go_on_over_dropped_tokens_and_inputs():
    got = list(Analyzer(remove_stopwords=True, stemming=True).analyze(["the running dogs", "of cats"]))
    assert [(t, p, i) for t, p, _, _, _, i in got] == [("run", 1, 0), ("dog", 2, 0), ("cat", 4, 1)]
    assert [t for t, *_ in Analyzer(max_token_length=3).analyze(["a abc abcd éééé"])] == ["a", "abc"]
    assert list(Analyzer(max_token_length=0).analyze(["a b"])) == []


@pytest.mark.parametrize("bad", [{"stemming": True, "case_sensitive": True}, {"remove_stopwords": True, "tokenizer": "whitespace"}, {"tokenizer": "x"}, {"max_token_length": 256}, {"stemming": True, "language": "klingon"}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        Analyzer(**bad)


def test_stop_words():
    assert len(stop_words("english")) == 33
    assert {x: len(stop_words(x)) for x in ("danish", "dutch", "german", "italian", "norwegian", "portuguese")} == {"danish": 94, "dutch": 101, "german": 231, "italian": 279, "norwegian": 172, "portuguese": 203}
    assert all(stop_words(x) for x in LANGUAGES)


@pytest.mark.parametrize("word,want", [("running", "run"), ("jumps", "jump"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("skies", "sky"), ("happily", "happili"), ("consistency", "consist"), ("manger", "manger"), ("conditional", "condit"), ("knightly", "knight"), ("by", "by")])
def test_english_stems(word, want):
    assert stem_english.stem(word) == want


def named(q, d, stats=lambda _: (0, 0, 100)):
    return dict(zip(features.FIELD_MATCH, features.field_match(terms(q), terms(d), stats), strict=True))


def test_field_match():
    m = named("quick brown fox", "the quick red fox jumps")
    want = {
        "matches": 2, "segments": 1, "gaps": 1, "gap_length": 1, "out_of_order": 0, "longest_sequence": 1, "head": 1, "tail": 1, "orderness": 1, "relatedness": 1,
        "longest_sequence_ratio": 0.5, "query_completeness": 2 / 3, "field_completeness": 0.4, "completeness": 2 / 3 * 0.95 + 0.05 * 0.4, "earliness": 0.8,
        "occurrence": 0.4, "absolute_occurrence": 0.01, "segment_distance": 0, "segment_proximity": 1, "proximity": 0.71, "absolute_proximity": 0.071,
    }
    assert {k: m[k] for k in want} == pytest.approx(want, abs=1e-9)
    assert m["score"] == pytest.approx(0.364527230941695, abs=1e-6)
    assert set(named("", "").values()) == {0.0} and named("x", "y")["matches"] == 0
    df = {"quick": (1, 10**6, 100), "brown": (1000, 10**6, 100), "fox": (500_000, 10**6, 100)}
    m = named("quick brown fox", "the quick red fox jumps", df.__getitem__)
    sig = [features.significance(*df[t][:2]) for t in ("quick", "brown", "fox")]
    assert m["significance"] == pytest.approx((sig[0] + sig[2]) / sum(sig)) and m["weight"] == pytest.approx(2 / 3)
    assert (m["weighted_occurrence"], m["weighted_absolute_occurrence"], m["significant_occurrence"]) == pytest.approx((0.2, 0.01, 0.2))
    assert features.significance(1000, 10**6) == pytest.approx(0.75) and features.significance(5, 0) == 0.5


def test_feature_columns(spark):
    rows = [("quick brown fox", "the quick red fox jumps"), ("repeat repeat term", "repeat term and repeat term again"), ("zebra", "the quick"), ("", "x"), ("alpha beta", "beta alpha beta gamma")]
    a = Analyzer()
    df = spark.createDataFrame(rows, "q string, d string").select(a.tokens(F.col("q")).alias("q"), a.tokens(F.col("d")).alias("d"))
    words = lambda c: F.transform(c, lambda t: t["text"])
    out = df.select(
        features.element_completeness(words("q"), words("d")).alias("c"), features.element_similarity(F.col("q"), F.col("d")).alias("s"), features.text_similarity(F.col("q"), F.col("d")).alias("t"),
        features.matches(words("q"), words("d")).alias("m"), features.field_term_match(F.col("q"), F.col("d"), 1).alias("f"), features.query_term_count(words("q")).alias("n"),
        features.field_match_features(F.col("q"), F.col("d")).alias("fm"),
    ).collect()
    assert out[0].c.completeness == pytest.approx(0.5 * 2 / 5 + 0.5 * 2 / 3)
    near = 1 - (1 / 8) ** 2
    assert tuple(out[0].s) == pytest.approx((0.35 * near + 0.15 + 0.3 * 2 / 3 + 0.2 * 0.4, near, 1, 2 / 3, 0.4))
    assert out[0].t.score == out[0].s.similarity
    assert (out[1].c.query_completeness, out[1].c.field_completeness) == pytest.approx((1, 0.5))
    assert [r.m for r in out] == [1, 1, 0, 0, 1] and [r.n for r in out] == [3, 3, 1, 0, 2]
    assert tuple(out[4].f) == (0, 2) and tuple(out[2].f) == (1_000_000, 0)
    assert out[0].fm.score == pytest.approx(0.364527230941695, abs=1e-6) and out[3].fm.score == 0


def test_native_forms_agree(spark):
    texts = ["ΣΟΦΟΣ İx ÀÉ", "Straße Æ ﬁ œ", "plain ASCII", "　a b c\x1cd", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    w = Analyzer(tokenizer="whitespace")
    rows = df.select("text", lower(F.col("text")).alias("low"), ascii_fold(F.col("text")).alias("fold"), w.terms(F.col("text")).alias("terms")).collect()
    assert rows[0].low == "σοφοσ i̇x àé" and rows[1].fold == "Strasse AE fi oe" and rows[2].fold == "plain ASCII"
    for r in rows:
        assert r.terms == (None if r.text is None else [t for t, *_ in w.analyze([r.text])])


def test_sql_functions(spark):
    sql.register(spark)
    one = lambda q: spark.sql(f"SELECT {q}").first()[0]
    assert one("word_breaks('a bé')") == [0, 1, 2, 5]
    assert one("sentence_breaks('A b. C')") == [0, 5, 6]
    assert [t.text for t in one("analyze_english('The Running dogs')")] == ["run", "dog"]
    assert one("legacy_significance(1000, 1000000)") == pytest.approx(0.75)
    assert one("element_completeness(array('a', 'b'), array('a', 'c', 'd', 'e'))") == pytest.approx(0.5 * 0.25 + 0.5 * 0.5)
    assert one("normalize_number('３億5千')") == "300005000"
    assert one("field_match(analyze('quick brown fox'), analyze('the quick red fox jumps'), null).score") == pytest.approx(0.3645272, abs=1e-6)


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(t, "The dogs run"), (t + datetime.timedelta(minutes=7), "run run")], "ts timestamp, text string").write.parquet(src)
    docs = streaming.read_texts(spark, src, "ts timestamp, text string")
    q = streaming.analyze_stream(docs, Analyzer(stemming=True)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(len(r.tokens) for r in spark.read.parquet(out).collect()) == [2, 3]
    counts = streaming.windowed_term_counts(docs, Analyzer(), "ts", "5 minutes", "1 minute")
    q = counts.writeStream.format("memory").queryName("term_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.window.start.minute, r.term): r.n for r in spark.table("term_counts").collect()}
    assert got == {(0, "the"): 1, (0, "dogs"): 1, (0, "run"): 1, (5, "run"): 2} and math.isfinite(1)

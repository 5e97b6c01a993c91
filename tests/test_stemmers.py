"""Stems of the published Snowball sample vocabularies."""

import pytest

from textloom.operators import stem_germanic, stem_romance
from textloom.operators.analyzer import Analyzer

PAIRS = {
    stem_germanic.german: {"aufeinander": "aufeinand", "häuser": "haus", "kategorisch": "kategor", "verständlich": "verstand", "freiheiten": "freiheit", "ergebnisse": "ergebnis", "straße": "strass"},
    stem_germanic.swedish: {"jaktkarlarne": "jaktkarl", "klostergården": "klostergård", "kraftfullt": "kraftfull", "friskt": "frisk"},
    stem_germanic.norwegian: {"havnedistriktene": "havnedistrikt", "bilens": "bil"},
    stem_germanic.danish: {"indtager": "indtag", "undersøgelserne": "undersøg", "farlig": "far"},
    stem_romance.spanish: {"chicharrones": "chicharron", "torneos": "torne", "rápidamente": "rapid", "corriendo": "corr", "biología": "biolog", "comiéndolo": "com"},
    stem_romance.french: {"manger": "mang", "continuellement": "continuel", "majestueusement": "majestu", "chevaux": "cheval", "évidemment": "évident", "quotidienne": "quotidien", "finissait": "fin", "nationalité": "national"},
}


@pytest.mark.parametrize("f,word,want", [(f, w, s) for f, p in PAIRS.items() for w, s in p.items()])
def test_stems(f, word, want):
    assert f(word) == want


@pytest.mark.parametrize("f", list(PAIRS))
def test_any_word_is_safe(f):
    for w in ("", "a", "é", "ß", "ss", "qu", "yy", "en", "ions", "ment", "löst", "igst", "guë", "x" * 200, "123"):
        assert isinstance(f(w), str)


def test_analyzer_stems_by_language():
    assert [t for t, *_ in Analyzer(stemming=True, language="german").analyze(["Die Häuser"])] == ["die", "haus"]
    assert [t for t, *_ in Analyzer(stemming=True, language="french").analyze(["Manger les chevaux"])] == ["mang", "le", "cheval"]


@pytest.mark.parametrize("language", ["english", "german", "french", "spanish"])
def test_stem_queries_read_all_documents(spark, tmp_path, language):
    from textloom.plans.queries import QUERIES

    rows = [(i, "aaa bbb", lang) for i, lang in enumerate(["en", "de", "fr", "es", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES[f"stem_{language}"](spark, str(tmp_path)).collect()
    assert {r.lang for r in out} == {"en", "de", "fr", "es", None} and sum(r.n for r in out) == 10

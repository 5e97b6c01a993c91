"""Chinese and Korean pieces without a dictionary."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import chinese, korean


def test_user_dictionary():
    got = korean.user_dictionary("# c\n세종시 세종 시\n\nC++\r\n대한민국날씨 # x\nㅋㅋ")
    assert [(n.surface, n.right_id, n.lengths) for n in got] == [("C++", 3533, ()), ("ㅋㅋ", 3535, ()), ("대한민국날씨", 3533, ()), ("세종시", 3534, (2, 1))]
    assert len(korean.user_dictionary("a\na b", lenient=True)) == 1
    for rules, kind in (("a\na", "duplicate"), ("ab abc", "too_long"), ("😀b x y", "splits_character")):
        with pytest.raises(korean.UserDictionaryError) as e:
            korean.user_dictionary(rules)
        assert e.value.kind == kind


def test_tags_and_filters():
    assert korean.parse_tags("nr, SP") == {"NR", "SP"} and korean.parse_tags(" ") == frozenset()
    with pytest.raises(ValueError):
        korean.parse_tags("XX")
    t = [{"text": x, "reading": r, "left_pos": p, "position_increment": 1} for x, r, p in (("ABC", None, "SL"), ("은", None, "JX"), ("漢", "한", "NNG"))]
    assert [(x["text"], x["position_increment"]) for x in korean.analyze_tail(t)] == [("abc", 1), ("한", 2)]


def test_chinese(spark):
    kinds = {"中": "hanzi", "a": "letter", "１": "fullwidth_digit", " ": "space", "，": "delimiter", "é": "other", "😀": "surrogate", "Ａ": "fullwidth_letter", "7": "digit"}
    assert {c: chinese.char_type(ord(c)) for c in kinds} == kinds
    assert spark.range(1).select(chinese.normalize(F.lit("ＡbC１"))).first()[0] == "abc1"

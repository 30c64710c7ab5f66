"""Hypothesis checks of the text rules against their Python definitions."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import text as T
from quire.operators import evaluate, qa

from test_qa import rules_oracle
from test_squad_eval import _f1, _norm
from test_text import pack_oracle

_words = st.sampled_from(["he", "She", "what", "HOW", "year", "2020", "city.", "city", "a", "an",
                          "the", "The", "x", "é", "Ünïcode", "!", "?", ".", "...", " ", "\n", "\t",
                          "\xa0", "word", "Where", "people", "month", "12b", "-", "'s", "😀"])
_texts = st.lists(_words, max_size=60).map(lambda ws: "".join(w if w in " \n\t\xa0" else w + " " for w in ws))


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(_texts, min_size=1, max_size=20))
def test_sentence_pack_property(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in df.select("id", T.sentence_pack("text", 60, 5).alias("c")).collect():
        assert list(r.c) == pack_oracle(texts[r.id], 60, 5)


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(_texts, min_size=1, max_size=20))
def test_rule_questions_property(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in df.select("id", qa.rule_questions("text").alias("q")).collect():
        assert list(r.q) == rules_oracle(texts[r.id])


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(st.tuples(_texts, _texts), min_size=1, max_size=20))
def test_em_f1_property(spark, pairs):
    df = spark.createDataFrame([(str(i), p, g) for i, (p, g) in enumerate(pairs)],
                               "id string, prediction_text string, answer_text string")
    for r in evaluate.score_pairs(df).collect():
        p, g = pairs[int(r.id)]
        assert r.em == float(_norm(p) == _norm(g))
        assert abs(r.f1 - _f1(p, g)) < 1e-12

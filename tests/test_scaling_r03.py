"""Steps that did not scale: sentence packing in Python workers, wrapping and question
rules that went over a text many times, contexts that went through a document's joins."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.breaks import pack_sentences
from quire.operators import embed, qa, squad
from quire.plans import dataset, rag


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_sentence_flow_holds_no_text_in_python(spark):
    plan = _plan(dataset.sentence_qa(_docs(spark, ["One. Two."])))
    assert "Python" not in plan and "Arrow" not in plan


def test_sentence_pack_equals_the_table_of_breaks(spark):
    rng = random.Random(3)
    texts = ["", " ", "...", "a", "a.", "x" * 510 + ". y", "x" * 511 + ". y", "x" * 512 + ".y.", "\U0001F600" * 511 + ". z"]
    texts += ["".join(rng.choice(["ab", "é", "12", "x" * 30]) + rng.choice([" ", ". ", "!", "\n", " ", "?! ", "\x1f"])
                      for _ in range(rng.choice([3, 40, 200]))) for _ in range(200)]
    for most, least in ((512, 50), (40, 3), (2, 0), (1, 0)):
        rows = _docs(spark, texts).select("text", T.sentence_pack("text", most, least).alias("c")).collect()
        assert all(r["c"] == pack_sentences(r["text"], most, least) for r in rows)


def test_wrap_asks_once_what_is_plain(spark):
    docs = _docs(spark, ["some words"])
    for df in (dataset.wrapped_qa(docs), rag.build_index(docs)):
        assert _plan(df).count("{501}") == 1


def test_rule_questions_split_only_texts_with_other_digits(spark):
    plan = _plan(_docs(spark, ["x"]).select(qa.rule_questions("text")))
    assert "lower(namedlambdavariable())" not in plan and "[^\\x00-\\x7F\\p{L}" in plan  # words were lower-cased one by one
    texts = ["a ² b", "a 12 b", "12x", "HE", "he.", "x City", "١٢", "1²", "\U0001D7D8", None, ""]
    got = [r[0] for r in _docs(spark, texts).select(qa.rule_questions("text")).collect()]
    when, other = [qa.WHEN_QUESTION], qa.DEFAULT_QUESTIONS
    assert got == [when, when, other, [qa.WHO_QUESTION], other, [qa.WHERE_QUESTION], when, when, when, other, other]


def test_best_sentence_by_the_rule_questions_tokens(spark):
    texts = ["Nothing here. The main topic. \U0001D7D8the is is main topic", "is_this text? In THIS text, mentioned. who is"]
    docs = _docs(spark, texts).withColumn("q", qa.rule_questions("text"))
    own = qa.questions_with_answers(docs, ("doc_id",))
    given = qa.questions_with_answers(docs, ("doc_id",), questions=F.col("q"))
    assert sorted(own.collect()) == sorted(given.collect())


def test_bucket_counts_of_many_and_of_few_buckets():
    tokens = pa.array([["a", "b", "a"], [], None, ["c"]] + [["a"] * 40] * 4, pa.list_(pa.string()))
    for dim in (4, 1 << 20):
        row, bucket, weight = embed._bucket_counts(tokens, dim)
        dense = {(r, b): w for r, b, w in zip(row.tolist(), bucket.tolist(), weight.tolist())}
        assert len(dense) == len(row) and np.all(np.diff(row) >= 0)
        assert np.allclose([sum(w * w for (r, _), w in dense.items() if r == i) for i in (0, 3, 4)], 1)


def test_questions_of_a_document_are_joined_without_contexts(spark):
    made = spark.createDataFrame([("i", 1, 0, 0, "c", "q", "a", 0)],
                                 "id string, doc_id long, chunk_no int, q_no int, context string, question string, answer string, answer_start int")
    _, rows = squad.paragraph_tables(made, "t")
    assert "Join [ck#" in _plan(rows) and "Join [context#" not in _plan(rows)

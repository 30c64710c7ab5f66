"""Findings of round 4: the SQuAD document takes little disk, and its odd rows."""

import glob
import gzip
import json
import os

import pytest

import __spark_entry__ as entry
from quire.operators import squad
from quire.session import checkpoint_dir

SCHEMA = ("id string, doc_id long, chunk_no int, q_no int, context string, question string, answer string, "
          "answer_start int")


def _written(spark) -> int:
    top = checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def _docs(spark, folder, n):
    """Documents of sentences that hardly compress beyond their letters."""
    import random
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9)))
    texts = [" ".join(" ".join(word() for _ in range(rng.randint(5, 15))).capitalize() + "." for _ in range(40)) for _ in range(n)]
    texts[-n // 10:] = texts[:n // 10]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return sum(map(len, texts))


def _text(folder) -> str:
    files = sorted(glob.glob(f"{folder}/part-*"))
    return "".join((gzip.open if f.endswith(".gz") else open)(f, "rt", encoding="utf-8").read() for f in files)


def test_query_writes_less_than_its_text_and_a_half(spark, scratch):
    # before, contexts were written twice and the document uncompressed: 3.7 times the text
    size = _docs(spark, scratch, 600)
    before = _written(spark)
    rows = entry.queries()["squad_document"](spark, scratch)
    assert _written(spark) - before < 1.5 * size
    assert rows.count() > 600


def test_reading_moves_no_paragraphs(spark, scratch):
    squad.write_document(_odd(spark), scratch, "x")
    plan = squad.read_document(spark, scratch)._jdf.queryExecution().executedPlan().toString()
    # by file, what stands ahead of a file's first paragraph and what goes on there: no other rows
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert len(exchanges) == 3 and plan.count("Exchange hashpartitioning(file#") == 2 and "SinglePartition" in plan
    assert "BroadcastExchange" not in plan


def _odd(spark):
    rows = [(f"{d}_{c}_{q}", d, c, q, t, f"q{q}?", a, s)
            for d in range(40) for c, t in enumerate(["same é \U0001F600 text. \"More\"\nof it.", f"own text {d}. \\ {{\"title\": 1"])
            for q, (a, s) in enumerate([("text.", t.find("text.")), ("not there", -1), ("", 0), (None, None), ("wrong", 2)])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize(("large", "compression"), [(1_000, None), (10, None), (10, "gzip"), (1_000, "gzip")])
def test_odd_answers_and_large_paragraphs_round_trip(spark, scratch, monkeypatch, large, compression):
    monkeypatch.setattr(squad, "LARGE_PARAGRAPH", large)
    monkeypatch.setattr(squad, "LINES_PER_FILE", 30)
    df = _odd(spark)
    squad.write_document(df, scratch, "x", compression)
    doc = json.loads(_text(scratch))
    want = sorted(df.collect(), key=lambda r: (r.doc_id, r.chunk_no, r.q_no))
    contexts = list(dict.fromkeys(r.context for r in want))
    assert [p["context"] for e in doc["data"] for p in e["paragraphs"]] == contexts
    for entry_, context in zip(doc["data"], contexts):
        got = [(q["id"], q["question"], q["answers"][0].get("text"), q["answers"][0].get("answer_start")) for q in entry_["paragraphs"][0]["qas"]]
        assert got == [(r.id, r.question, r.answer, r.answer_start) for r in want if r.context == context]
    back = squad.read_document(spark, scratch).select("context", "id", "question", "answer", "answer_start").collect()
    key = lambda r: r.id
    assert sorted(map(tuple, back), key=lambda r: r[1]) == [(r.context, r.id, r.question, r.answer, r.answer_start) for r in sorted(want, key=key)]


def test_contexts_of_one_place_stay_apart(spark, scratch):
    # places that repeat or are null: paragraphs and their questions got mixed
    rows = [(f"{i}_{j}", None, 0, 0, f"context {i}", "q?", f"text {i}", -1) for i in range(6) for j in range(3)] + \
        [("n", None, 0, 0, None, "q?", "a", 0), ("p", 1, None, None, "context 7", "q?", "7", 8)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    squad.write_document(df, scratch, "x")
    doc = json.loads(_text(scratch))
    got = {p["context"]: sorted(q["id"] for q in p["qas"]) for e in doc["data"] for p in e["paragraphs"]}
    assert got == {f"context {i}": [f"{i}_{j}" for j in range(3)] for i in range(6)} | {"context 7": ["p"]}
    back = squad.read_document(spark, scratch)
    assert sorted((r.context, r.id, r.answer) for r in back.collect()) == sorted((r[4], r[0], r[6]) for r in rows if r[4])


def test_file_read_by_many_tasks(spark, scratch):
    squad.write_document(_odd(spark), scratch, "x")
    want = sorted((r.id, r.context) for r in _odd(spark).collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert sorted((r.id, r.context) for r in squad.read_document(spark, scratch).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_normal_form_has_every_paragraph_and_question(spark):
    df = _odd(spark)
    paras, rows = squad.paragraph_tables(df, "t")
    got = {r.context: (tuple(r.first), tuple(r.last), r.title, r.n_qas) for r in paras.collect()}
    assert len(got) == 41 and got["own text 3. \\ {\"title\": 1"] == ((3, 1, 0), (3, 1, 4), "Generated_Document_t", 5)
    assert got["same é \U0001F600 text. \"More\"\nof it."] == ((0, 0, 0), (39, 0, 4), "Generated_Document_t", 200)
    asked = rows.collect()
    assert len(asked) == 400 and sum(r.is_last for r in asked) == 41
    assert {(r.id, r.answers[0].text, r.answers[0].answer_start) for r in asked} == {(r.id, r.answer, r.answer_start) for r in df.collect()}

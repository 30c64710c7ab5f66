"""SQuAD export round trips, hot-context splitting, split and EM/F1."""

import collections
import re
import string

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate, squad
from quire.plans import dataset


def _qa_rows(spark, sf_small):
    return dataset.sentence_qa(spark.read.parquet(f"{sf_small}/documents.parquet"))


def test_nested_round_trip(spark, sf_small, scratch):
    qa_rows = _qa_rows(spark, sf_small)
    paras = squad.paragraphs(qa_rows, "t1")
    squad.write_nested(paras, scratch)
    back = squad.read_nested(spark, scratch)
    want = sorted((r.id, r.context, r.question, r.answer, r.answer_start) for r in qa_rows.collect())
    got = sorted((r.id, r.context, r.question, r.answer, r.answer_start) for r in back.collect())
    assert got == want
    assert {r.title for r in back.select("title").distinct().collect()} == {"Generated_Document_t1"}
    version = spark.read.json(f"{scratch}/_version").first().version
    assert version == "2.0"


def test_paragraphs_group_by_exact_context_in_first_seen_order(spark):
    rows = [("1_chunk_0_qa_0", 1, 0, 0, "same text", "q1", "a", 0),
            ("0_chunk_2_qa_1", 0, 2, 1, "same text", "q2", "a", 0),
            ("0_chunk_2_qa_0", 0, 2, 0, "same text", "q3", "a", 0),
            ("0_chunk_1_qa_0", 0, 1, 0, "other", "q4", "a", 0)]
    df = spark.createDataFrame(rows, "id string, doc_id long, chunk_no int, q_no int, context string, "
                                     "question string, answer string, answer_start int")
    got = {r.context: r for r in squad.paragraphs(df, "x").collect()}
    assert [q.id for q in got["same text"].qas] == ["0_chunk_2_qa_0", "0_chunk_2_qa_1", "1_chunk_0_qa_0"]
    assert (got["same text"].first_doc_id, got["same text"].first_chunk_no) == (0, 2)


def _hot(spark, n):
    return spark.range(n).select(
        F.format_string("%d_chunk_0_qa_0", "id").alias("id"), F.col("id").alias("doc_id"),
        F.lit(0).alias("chunk_no"), F.lit(0).alias("q_no"),
        F.when(F.col("id") % 100 == 7, F.concat(F.lit('rare "ctx"\n, {"title": '), F.col("id").cast("string")))
        .otherwise("boilerplate").alias("context"),
        F.lit("q]}]}").alias("question"), F.lit("a").alias("answer"), F.lit(0).alias("answer_start"))


def test_hot_context_is_one_paragraph(spark):
    paras = {p.context: p for p in squad.paragraphs(_hot(spark, 25_000), "x").collect()}
    assert len(paras) == 251 and len(paras["boilerplate"].qas) == 24_750


def test_document_of_many_files_round_trip(spark, scratch, monkeypatch):
    # files of 700 lines: a hot paragraph goes on over many files
    monkeypatch.setattr(squad, "LINES_PER_FILE", 700)
    df = _hot(spark, 5_000)
    squad.write_document(df, scratch, "x")
    import glob
    import json
    files = sorted(glob.glob(f"{scratch}/part-*"))
    assert len(files) > 5
    doc = json.loads("".join(open(f, encoding="utf-8").read() for f in files))
    assert doc["version"] == "2.0" and [len(e["paragraphs"]) for e in doc["data"]] == [1] * 51
    assert doc["data"][0]["paragraphs"][0]["context"] == "boilerplate"
    ids = [q["id"] for q in doc["data"][0]["paragraphs"][0]["qas"]]
    assert ids == [f"{i}_chunk_0_qa_0" for i in range(5_000) if i % 100 != 7]
    want = sorted(tuple(r) for r in df.select(F.lit("Generated_Document_x"), "context", "id", "question", "answer",
                                              "answer_start").collect())
    assert sorted(tuple(r) for r in squad.read_document(spark, scratch).collect()) == want
    with open(f"{scratch}-one.json", "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
    assert sorted(tuple(r) for r in squad.read_squad(spark, f"{scratch}-one.json").collect()) == want


def test_empty_document(spark, scratch):
    squad.write_document(_hot(spark, 0), scratch, "x")
    assert squad.read_document(spark, scratch).count() == 0


def test_flat_round_trip(spark, scratch):
    rows = [("a", "t", "ctx é", "q?", "é", 4)]
    df = spark.createDataFrame(rows, "id string, title string, context string, question string, "
                                     "answer_text string, answer_start int")
    squad.write_flat(squad.flat_records(df), scratch)
    back = squad.unflatten_answers(squad.read_flat(spark, scratch)).collect()
    assert [tuple(r) for r in back] == rows


def test_split_is_stable_partition(spark, sf_small):
    rows = _qa_rows(spark, sf_small)
    a = {r.id: r.split for r in evaluate.train_eval_split(rows).collect()}
    b = {r.id: r.split for r in evaluate.train_eval_split(rows.orderBy(F.rand(3))).collect()}
    assert a == b and set(a.values()) <= {"train", "eval"}


def _norm(s):
    s = s.lower()
    s = "".join(ch for ch in s if ch not in set(string.punctuation))
    s = re.sub(r"\b(a|an|the)\b", " ", s)
    return " ".join(s.split())


def _f1(p, g):
    pt, gt = _norm(p).split(), _norm(g).split()
    common = collections.Counter(pt) & collections.Counter(gt)
    same = sum(common.values())
    if same == 0:
        return 0.0
    pr, rc = same / len(pt), same / len(gt)
    return 2 * pr * rc / (pr + rc)


def test_em_f1_match_metric_definition(spark):
    pairs = [("The cat sat.", "cat sat"), ("a b b c", "b c c"), ("", ""), ("x", ""),
             ("An apple, the pear!", "apple pear"), ("Das Haus", "das haus"), ("the", "a")]
    df = spark.createDataFrame([(str(i), p, g) for i, (p, g) in enumerate(pairs)],
                               "id string, prediction_text string, answer_text string")
    got = {r.id: (r.em, r.f1) for r in evaluate.score_pairs(df).collect()}
    for i, (p, g) in enumerate(pairs):
        em, f1 = got[str(i)]
        assert em == float(_norm(p) == _norm(g))
        assert abs(f1 - _f1(p, g)) < 1e-12
    agg = evaluate.squad_em_f1(df.select("id", "prediction_text"), df.select("id", "answer_text")).first()
    assert agg.n == len(pairs) and agg.n_dup_ids == 0
    assert abs(agg.f1 - 100 * sum(_f1(p, g) for p, g in pairs) / len(pairs)) < 1e-9


def test_argmax_first_maximum(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9], 1), ([3.0, 1.0], 1)],
                               "start_logits array<double>, label_start int")
    r = evaluate.argmax_em(df).first()
    assert r.n == 2 and r.exact_match == 0.5


def test_single_document_export_round_trip(spark, sf_small, scratch):
    flat = dataset.wrapped_qa(spark.read.parquet(f"{sf_small}/documents.parquet")).select(
        "id", "title", "context", "question", "answer_text", "answer_start")
    recs = squad.flat_records(flat)
    squad.write_flat_document(recs.unionAll(recs.limit(1)), scratch)  # a repeated record too
    back = squad.unflatten_answers(squad.read_flat_document(spark, scratch))
    assert back.count() == flat.count() + 1
    assert set(map(tuple, back.collect())) == set(map(tuple, flat.collect()))
    import json
    import glob
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{scratch}/part-*")))
    assert list(json.loads(text)) == ["data"] and len(json.loads(text)["data"]) == back.count()


def test_dataset_path_format():
    assert squad.dataset_path("s3a://bucket/corpus/", "t7") == \
        "s3a://bucket/corpus/generated_datasets/squad_dataset_t7"

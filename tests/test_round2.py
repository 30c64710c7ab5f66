"""Rows that used to be lost or miscounted."""

import math

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, evaluate, knn, status
from quire.plans import rag
from quire.session import checkpoint_dir
from quire.sources import files


def test_one_bad_vector_costs_only_itself(spark):
    good = [(i, [float(i), 0.0]) for i in range(50)]
    bad = [(100, [math.nan, 0.0]), (101, [None, 0.0]), (102, [1.0]), (103, None), (104, [math.inf, 0.0])]
    corpus = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [3.2, 0.0]), (2, [1.0, 2.0, 3.0]), (3, [math.nan, 0.0]), (4, [7.0])],
                                    "qid long, embedding array<float>")
    got = {(r.qid, r["rank"]): r.vec_id for r in knn.knn_topk(corpus, queries, 2).collect()}
    assert got == {(1, 1): 3, (1, 2): 4, (4, 1): 102}


def test_ties_stay_exact_over_slices(spark, monkeypatch):
    monkeypatch.setattr(knn, "CANDIDATE_SLICE", 7)
    corpus = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(q, [0.0, float(q)]) for q in range(5)], "qid long, embedding array<float>")
    got = knn.knn_topk(corpus, queries, 3).collect()
    assert sorted((r.qid, r.vec_id) for r in got) == [(q, v) for q in range(5) for v in range(3)]


def test_references_without_prediction_score_zero(spark):
    refs = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "z")], "id string, answer_text string")
    preds = spark.createDataFrame([("a", "x")], "id string, prediction_text string")
    r = evaluate.squad_em_f1(preds, refs).first()
    assert (r.n, r.n_missing, r.n_dup_ids) == (3, 2, 0)
    assert abs(r.exact_match - 100 / 3) < 1e-9 and abs(r.f1 - 100 / 3) < 1e-9


def test_states_of_the_inference_service(spark):
    rows = spark.createDataFrame([(s,) for s in status.INFERENCE_STATES + status.RUN_STATES], "status string")
    active = {r.status: r.active for r in status.active_tasks(rows).collect()}
    assert {s for s, a in active.items() if not a} == {"inference_ready", "error", "completed", "failed"}


def test_question_longer_than_the_window(spark):
    df = spark.createDataFrame([(1, "q " * 300, "w " * 600), (2, "q q", "w " * 600)], "id int, question string, context string")
    got = chunking.token_windows(df, ["id"], "context", 384, 128, question_col="question").collect()
    one = [r for r in got if r["id"] == 1]
    assert len(one) == 1 and one[0].win_no == -1 and one[0].text is None and one[0].n_tokens == 0
    assert max(r.n_tokens for r in got if r["id"] == 2) == 382 and len(got) == 3


def test_relative_path_of_a_short_base(spark, tmp_path):
    base = tmp_path / "e"
    (base / "e" / "a").mkdir(parents=True)
    (base / "e" / "a" / "doc.txt").write_text("x")
    assert [r.rel_path for r in files.file_manifest(spark, str(base)).collect()] == ["e/a/doc.txt"]


def test_unreadable_index_raises(spark, tmp_path):
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "part-0.parquet").write_bytes(b"not parquet")
    docs = spark.createDataFrame([(1, "some text " * 20)], "doc_id long, text string")
    with pytest.raises(Exception):
        rag.update_index(spark, docs, str(tmp_path / "index"))


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_index_id_is_a_pair_and_blank_documents_are_done_once(spark, tmp_path):
    docs = spark.createDataFrame([(1 << 43, "alpha beta " * 100, "a"), (1, " ", "b"), (-5, "gamma delta", "c")],
                                 "doc_id long, text string, source string")
    path = str(tmp_path / "index")
    assert [rag.update_index(spark, docs, path) for _ in range(3)] == [3, 0, 0]
    top = rag.retrieve(rag.load_index(spark, path), spark.createDataFrame([(1, "gamma delta")], "qid long, query string"), 2)
    hits = [(r.doc_id, r.chunk_no) for r in top.orderBy("rank").collect()]
    assert hits[0] == (-5, 0) and hits[1][0] == 1 << 43  # no packing: the id comes back whole

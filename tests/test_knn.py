"""Exact kNN against NumPy brute force, plus edge cases."""

import numpy as np
from pyspark.sql import functions as F

from quire.operators import knn


def brute(ids, mat, q_ids, q_mat, k):
    out = {}
    for qi, qv in zip(q_ids, q_mat):
        d = ((mat.astype(np.float64) - qv.astype(np.float64)) ** 2).sum(1)
        order = sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j]))[:k]
        out[qi] = [(ids[j], d[j]) for j in order]
    return out


def test_knn_matches_bruteforce(spark, sf_small):
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = emb.select("vec_id", "embedding").collect()
    ids = [r.vec_id for r in rows]
    mat = np.array([r.embedding for r in rows], dtype=np.float32)
    q = emb.where(F.col("vec_id") % 7 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    qrows = q.collect()
    want = brute(ids, mat, [r.qid for r in qrows],
                 np.array([r.embedding for r in qrows], dtype=np.float32), 5)
    got = {}
    for r in knn.knn_topk(emb, q, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.vec_id, r.dist))
    assert set(got) == set(want)
    for qid, hits in want.items():
        assert [h[0] for h in got[qid]] == [h[0] for h in hits]
        assert np.allclose([h[1] for h in got[qid]], [h[1] for h in hits], atol=1e-9)


def test_knn_small_groups_equal_one_group(spark, sf_small):
    """Many cells, salts and query parts give what one group gives."""
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    q = emb.select(F.col("vec_id").alias("qid"), "embedding")
    one = knn.knn_topk(emb, q, 3, cells=1).collect()
    many = knn.knn_topk(emb, q, 3, cells=9, corpus_rows=5, query_rows=7).collect()
    key = lambda r: (r.qid, r.rank)
    assert len(one) == 3 * q.count()
    assert [(r.qid, r.rank, r.vec_id) for r in sorted(one, key=key)] == \
        [(r.qid, r.rank, r.vec_id) for r in sorted(many, key=key)]


def test_knn_edges_ties_k_gt_n_k_zero_ragged(spark):
    corpus = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 1.0, 1.0])],
        "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(10, [1.0, 0.0])], "qid long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in knn.knn_topk(corpus, q, 10).orderBy("rank").collect()]
    # ties at distance 0 go to the smaller id; the 3-d vector is not comparable; k > N -> N rows
    assert got == [(1, 2), (2, 4), (3, 1), (4, 3)]
    assert knn.knn_topk(corpus, q, 0).count() == 0


def test_context_assembly_in_rank_order(spark):
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, "only")],
                                 "qid long, rank int, text string")
    got = {r.qid: r.context for r in knn.assemble_context(hits).collect()}
    assert got == {1: "first\nsecond", 2: "only"}


def test_hash_embedding_matches_python(spark, sf_small):
    import hashlib
    import re

    from quire.operators import embed
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: np.array(r.embedding) for r in embed.hash_embed(docs, "text").collect()}
    for r in docs.collect():
        counts = np.zeros(64)
        for tok in re.findall(r"[^\W_]+", r.text.lower()):
            counts[int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % 64] += 1
        want = (counts / np.sqrt((counts ** 2).sum())).astype(np.float32) if counts.any() else counts
        assert np.allclose(got[r.doc_id], want, atol=1e-7), r.doc_id


def test_knn_duplicates_do_not_inflate_candidates(spark):
    # a third of the corpus is copies of one vector: each query still gets
    # exactly k rows, ties resolved by the smallest ids
    rows = [(i, [1.0, 1.0]) for i in range(3000)] + [(3000 + i, [float(i % 7) + 5, 0.0]) for i in range(6000)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.1, 0.9])], "qid long, embedding array<float>")
    got = knn.knn_topk(corpus, q, 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.vec_id) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    ids, mat = np.array([[r[0]] for r in rows]), np.array([r[1] for r in rows])
    out = list(knn._group_topk(ids, mat, np.array([[1.0, 1.0], [1.1, 0.9]]), np.array([3, 2]), np.full(2, np.inf)))
    assert [len(o[0]) for o in out] == [5]
    # the copies' cell is cut into groups that many tasks share
    small = knn.knn_topk(corpus, q, 3, corpus_rows=100).orderBy("qid", "rank").collect()
    assert [(r.qid, r.vec_id) for r in small] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    made = knn._cells_of(corpus.select(F.col("embedding").alias("cv")), 2, 16, 100)
    assert made.salts.max() >= 30 and made.ring_count.sum() == 9000


def test_each_query_has_its_own_k(spark):
    corpus = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 0.0], 2), (2, [39.0, 0.0], 0), (3, [10.2, 0.0], None), (4, [5.0, 0.0], 100), (4, [5.0, 0.0], 1),
                               (5, [5.0, 0.0], -1)], "qid long, embedding array<float>, top_k int")
    got = knn.knn_topk(corpus, q, 3, k_col="top_k", cells=5, corpus_rows=4, query_rows=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.qid, []).append((r["rank"], r.vec_id))
    assert sorted(by) == [1, 3, 4]
    assert sorted(by[1]) == [(1, 0), (2, 1)] and sorted(by[3]) == [(1, 10), (2, 11), (3, 9)]
    assert len(by[4]) == 41 and sorted(by[4])[:2] == [(1, 5), (1, 5)]  # two rows of one id are two queries


def test_cells_that_cannot_hold_a_neighbour_are_ruled_out(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 100, (20, 8))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.1, 8)).tolist()) for i in range(2000)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = corpus.where("vec_id < 60").select(F.col("vec_id").alias("qid"), "embedding")
    made = knn._cells_of(corpus.select(F.col("embedding").alias("cv")), 8, 64, 1000)
    asked = knn._asked(q.select("qid", F.lit(5).alias("top_k"), F.col("embedding").alias("qv")), 8, made)
    each = [len(r.cells) for r in asked.collect()]
    # pivots of the query's own cluster, and no other
    assert len(each) == 60 and max(each) < len(made.pivots) / 3
    ids, mat = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32)
    want = brute(ids, mat, list(range(60)), mat[:60], 5)
    got = {}
    for r in knn.knn_topk(corpus, q, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    assert got == {k: [i for i, _ in v] for k, v in want.items()}


def test_squared_l2_expression_matches_numpy(spark, sf_small):
    from quire.functions import vectors as V
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet").limit(50)
    a = emb.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = emb.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    pairs = a.join(b, F.col("a") < F.col("b") + 3).where(F.col("b") < F.col("a") + 3)
    for r in pairs.select("va", "vb", V.squared_l2("va", "vb").alias("d")).collect():
        va, vb = np.array(r.va, dtype=np.float64), np.array(r.vb, dtype=np.float64)
        assert abs(r.d - ((va - vb) ** 2).sum()) < 1e-9

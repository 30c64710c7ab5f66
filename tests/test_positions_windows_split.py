"""Exact ordinals, windows with answers, exact-size splits, several gold answers,
sparse embeddings and page assembly."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, embed, evaluate, positions, squad
from quire.plans import dataset


# --- positions -------------------------------------------------------------------

def test_number_within_equals_sorted_lists(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "a", "a", "b", "", "c" * 40]), r.choice([None, *range(30)]), i) for i in range(4000)]
    rows += [("hot", 5, -1)] * 3000  # equal rows, told apart by their place only
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(6)
    got = positions.number_within(df, ["g"], ["k", "v"], "pos", "n").collect()
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append((row[1] is not None, row[1] or 0, row[2]))
    assert len(got) == len(rows)
    for g, want in groups.items():
        mine = sorted((x.pos, (x.k is not None, x.k or 0, x.v)) for x in got if x.g == g)
        assert [p for p, _ in mine] == list(range(len(want))) and [k for _, k in mine] == sorted(want)
        assert {x.n for x in got if x.g == g} == {len(want)}


def test_number_within_splits_a_hot_group(spark):
    df = spark.range(40_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 40_000).alias("k"))
    out = positions.number_within(df.repartition(4), ["g"], ["k"], "pos")
    assert out.where("pos <> k").count() == 0
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "pos" in out.columns and sum(p["count"] for p in parts) == 40_000
    # the window sees one count per partition, not the rows
    assert plan.index("HashAggregate") > plan.index("Window") or "Window" in plan


def test_number_within_without_groups_or_rows(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert {r.k: r.position for r in positions.number_within(df, [], ["k"]).collect()} == {None: 0, "a": 1, "b": 2}
    assert positions.number_within(df.where("k = 'z'"), [], ["k"]).count() == 0
    with pytest.raises(ValueError):
        positions.number_within(df.withColumnRenamed("k", "_nw_row"), [], ["_nw_row"])


def test_paragraph_of_100_000_questions(spark):
    """The hot paragraph's questions are rows with their positions, never one value."""
    n = 100_000
    qa = spark.range(n).select(
        F.format_string("%d_chunk_0_qa_0", "id").alias("id"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_no"), F.lit(0).alias("q_no"),
        F.when(F.col("id") % 1000 == 7, F.concat(F.lit("rare "), F.col("id").cast("string"))).otherwise("boilerplate").alias("context"),
        F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit(0).alias("answer_start"))
    paras, rows = squad.numbered_tables(qa, "x")
    p = {r.context: (r.paragraph_no, r.n_qas) for r in paras.collect()}
    assert p["boilerplate"] == (0, n - 100) and p["rare 7"] == (1, 1) and p["rare 1007"] == (2, 1)
    hot = rows.where("paragraph_no = 0")
    got = hot.agg(F.count("*").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"),
                  F.count_distinct("position").alias("d")).first()
    assert (got.n, got.lo, got.hi, got.d) == (n - 100, 0, n - 101, n - 100)
    some = {r.position: r.id for r in hot.where("position in (0, 7, 50000)").collect()}
    kept = [i for i in range(n) if i % 1000 != 7]
    assert some == {i: f"{kept[i]}_chunk_0_qa_0" for i in (0, 7, 50_000)}


def test_numbered_tables_equal_the_nested_form(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    paras, rows = dataset.nested_tables(docs, "x")
    nested = sorted(dataset.nested_dataset(docs, "x").collect(), key=lambda r: (r.first_doc_id, r.first_chunk_no, r.first_q_no))
    by = defaultdict(dict)
    for r in rows.collect():
        by[r.paragraph_no][r.position] = (r.id, r.question, r.answers)
    assert [r.context for r in paras.orderBy("paragraph_no").collect()] == [r.context for r in nested]
    for i, r in enumerate(nested):
        assert [by[i][k] for k in range(len(by[i]))] == [(q.id, q.question, q.answers) for q in r.qas]


# --- windows with answers --------------------------------------------------------------

def brute_windows(question, context, answer, start, window, overlap):
    spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", context or "")]
    budget = window - len((question or "").split())
    if budget <= overlap:
        return [(-1, -1, 0, -1, -1, None, -1, -1)]
    hit = [i for i, (b, e) in enumerate(spans) if answer and start is not None and start >= 0 and e > start and b < start + len(answer)]
    out, no = [], 0
    while True:
        lo = no * (budget - overlap)
        part = spans[lo:lo + budget]
        inside = bool(hit) and lo <= hit[0] and hit[-1] < lo + len(part)
        c, e = (part[0][0], part[-1][1]) if part else (0, 0)
        out.append((no, lo, len(part), c, e, (context or "")[c:e], hit[0] - lo if inside else -1, hit[-1] - lo if inside else -1))
        if lo + budget >= len(spans):
            return out
        no += 1


def test_answer_windows_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        words = [r.choice(["a", "bb", "né", "日本", "😀x", "c-d"]) for _ in range(r.randrange(0, 90))]
        context = "".join(w + r.choice([" ", "  ", "\n", "　", "\t "]) for w in words)
        at = r.randrange(len(context) + 1)
        answer = context[at:at + r.randrange(0, 25)]
        rows.append((i, r.choice(["q", "what is it", ""]), context, answer, r.choice([at, at, at, -1, None])))
    rows += [(60, "q " * 30, "x y z", "y", 2), (61, None, None, None, None), (62, "q", " \n ", "", 0), (63, "q", "w " * 400, "w", 700)]
    df = spark.createDataFrame(rows, "key int, question string, context string, answer_text string, answer_start int")
    got = chunking.answer_windows(df, ["key"], window=20, overlap=6)
    assert got.columns == ["key", "win_no", "question", "tok_start", "n_tokens", "char_start", "char_end", "text", "answer_first", "answer_last"]
    by = defaultdict(list)
    for x in got.drop("question").collect():
        by[x.key].append(tuple(x)[1:])
    for i, q, c, a, s in rows:
        assert sorted(by[i], key=lambda x: x[0]) == brute_windows(q, c, a, s, 20, 6), i


def test_document_windows_have_later_windows_and_labels(spark):
    import __spark_entry__ as E
    w = E.queries()["qa_token_windows"](spark, "/root/testdata/sf0.01")
    n = w.agg(F.count_if(F.col("win_no") > 0).alias("later"), F.count_if(F.col("answer_first") >= 0).alias("held"),
              F.count_if((F.col("win_no") > 0) & (F.col("answer_first") >= 0)).alias("both"),
              F.count_if(F.col("answer_first") < 0).alias("without")).first()
    assert min(n) > 10, n
    kept = E.queries()["train_examples"](spark, "/root/testdata/sf0.01").count()
    assert 0 < kept < dataset.wrapped_qa(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).count()


# --- splits -----------------------------------------------------------------------------

@pytest.mark.parametrize("fraction,seed", [(0.1, 0), (0.25, 3), (0.0, 0), (1.0, 1), (0.333, 9)])
def test_exact_split_has_the_exact_size(spark, fraction, seed):
    n = 1999
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % 101).alias("doc_id")).repartition(5)
    a = {r.id: r.split for r in evaluate.exact_split(df, "id", fraction, seed).collect()}
    order = sorted(range(n), key=lambda i: (int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:15], 16), str(i)))
    want = {str(i) for i in order[:math.ceil(round(fraction * n, 6))]}
    assert {i for i, s in a.items() if s == "eval"} == want
    by = defaultdict(set)
    for r in evaluate.exact_split(df, "doc_id", fraction, seed).collect():
        by[r.doc_id].add(r.split)
    assert all(len(s) == 1 for s in by.values())
    assert sum(s == {"eval"} for s in by.values()) == math.ceil(round(fraction * 101, 6))


def test_exact_split_null_and_repeated_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string")
    got = sorted((r.id or "", r.split) for r in evaluate.exact_split(df, "id", 0.5).collect())
    assert got.count(("", "train")) == 1 and len({s for i, s in got if i == "a"}) == 1
    assert sum(s == "eval" for _, s in set(got)) == 1
    assert evaluate.exact_split(df.where("id = 'z'"), "id", 0.5).count() == 0
    with pytest.raises(ValueError):
        evaluate.exact_split(df, "id", 1.5)


# --- several gold answers ----------------------------------------------------------------

def test_best_of_answers(spark):
    refs = spark.createDataFrame([("a", ["x y", "the cat"]), ("b", ["q"]), ("b", ["dog house"]), ("c", []), ("d", None), ("e", ["z", None, ""])],
                                 "id string, answers array<string>")
    preds = spark.createDataFrame([("a", "Cat!"), ("b", "dog"), ("c", "x"), ("d", "x"), ("e", "")], "id string, prediction_text string")
    got = {r.id: (r.em, round(r.f1, 6), r.n_answers, r.n_rows, r.missing) for r in evaluate.best_of_answers(preds, refs).collect()}
    assert got == {"a": (1.0, 1.0, 2, 1, False), "b": (0.0, round(2 / 3, 6), 2, 2, False), "c": (0.0, 0.0, 0, 1, False),
                   "d": (0.0, 0.0, 0, 1, False), "e": (1.0, 0.0, 2, 1, False)}
    total = evaluate.squad_best_of(preds.where("id <> 'a'"), refs).first()
    assert (total.n, total.n_missing, total.n_dup_ids, total.n_answers) == (5, 1, 1, 6)
    assert total.exact_match == pytest.approx(20) and total.f1 == pytest.approx(100 * (2 / 3) / 5)
    plan = evaluate.squad_best_of(preds, refs)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    plan = evaluate.squad_em_f1(preds, spark.createDataFrame([("a", "x")], "id string, answer_text string"))._jdf.queryExecution().executedPlan()
    assert "Expand" not in plan.toString()


# --- embeddings, pages, prompts ----------------------------------------------------------

def test_embedding_of_odd_rows_and_wide_vectors(spark):
    df = spark.createDataFrame([(1, "b a b A"), (2, None), (3, ""), (4, "..."), (5, "é É ß 日本")], "k int, text string")
    for dim in (1, 64, 1 << 20):
        got = {r.k: [(r.bucket, r.weight) for r in rows] for rows in [embed.hash_embed_sparse(df, ["k"], "text", dim).collect()] for r in rows}
        sparse = defaultdict(dict)
        for r in embed.hash_embed_sparse(df, ["k"], "text", dim).collect():
            sparse[r.k][r.bucket] = r.weight
        assert set(sparse) == {1, 5} and got
        for k, text in ((1, "b a b a"), (5, "é é ß 日本")):
            counts = defaultdict(int)
            for t in text.split():
                counts[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1
            norm = math.sqrt(sum(c * c for c in counts.values()))
            assert sparse[k] == {b: pytest.approx(c / norm, abs=1e-7) for b, c in counts.items()}
    dense = {r.k: r.e for r in embed.hash_embed(df, "text", "e", 64).collect()}
    assert dense[2] is None and len(dense[3]) == 64 and not any(dense[3]) and not any(dense[4])
    assert np.isclose(np.linalg.norm(dense[1]), 1)


def test_pages_of_many_documents_and_null_ids(spark):
    r = random.Random(5)
    rows = [(r.choice([None, *range(300)]), r.randrange(50), r.choice([None, "", "x", "long " * 300])) for _ in range(5000)]
    rows += [(1000, p, f"{p}") for p in range(3000)]
    df = spark.createDataFrame(rows, "d long, p int, text string").repartition(7)
    groups = defaultdict(list)
    for d, p, t in rows:
        groups[d].append((p, t or ""))
    got = {x.d: (x.text, x.n_pages) for x in chunking.assemble_pages(df, "d", "p", "text", "|").collect()}
    assert got == {d: ("|".join(t for _, t in sorted(v)), len(v)) for d, v in groups.items()}
    assert chunking.assemble_pages(df.where("d = -1"), "d", "p").count() == 0


def test_prompts_keep_their_line_breaks(spark):
    from quire.functions import text as T
    from quire.operators import rag
    df = spark.createDataFrame([("a\n b\t c d",), ("  a",), ("x " * 600,), ("",)], "prompt string")
    got = [r.t for r in df.select(T.cut_tokens("prompt", 3).alias("t")).collect()]
    assert got == ["a\n b\t c", "  a", "x x x", ""]
    out = rag.generate_with_model(df, lambda: lambda p: np.array([str(len(t)) for t in p]), token_budget=None).collect()
    assert [r.response for r in out] == [str(len(r.prompt)) for r in out]
    cut = rag.generate_with_model(df, lambda: lambda p: np.array([str(len(t.split())) for t in p])).collect()
    assert [r.response for r in cut] == ["4", "1", "512", "0"]

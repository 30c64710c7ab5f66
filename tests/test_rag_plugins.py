"""RAG plan: persisted/incremental index, contexts, and the model plug-in slots."""

import numpy as np
from pyspark.sql import functions as F

from quire.operators import embed, qa, rag
from quire.plans import rag as R


def _docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


def test_incremental_index_equals_full_build(spark, sf_small, scratch):
    docs = _docs(spark, sf_small)
    path = f"{scratch}/index"
    assert R.update_index(spark, docs.where(F.col("doc_id") < 100), path) == 100
    assert R.update_index(spark, docs.where(F.col("doc_id") < 100), path) == 0
    added = R.update_index(spark, docs, path)
    assert added == docs.count() - 100
    stored = sorted((r.doc_id, r.chunk_no, r.text) for r in R.load_index(spark, path).select("doc_id", "chunk_no", "text").collect())
    full = sorted((r.doc_id, r.chunk_no, r.text) for r in R.build_index(docs).select("doc_id", "chunk_no", "text").collect())
    assert stored == full


def test_contexts_from_stored_index_equal_the_lazy_one(spark, sf_small, scratch):
    docs = _docs(spark, sf_small)
    path = f"{scratch}/index2"
    q = spark.read.parquet(f"{sf_small}/benchmark.parquet").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"))
    a = {r.qid: r.context for r in R.contexts(R.stored_index(spark, docs, path), q, 3).collect()}
    b = {r.qid: r.context for r in R.contexts(R.build_index(docs), q, 3).collect()}
    assert a == b and len(a) == q.count()


def test_embedding_plugin_runs_in_arrow_batches(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "text string")

    def make_model():
        def model(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)
        return model

    got = [list(r.embedding) for r in embed.embed_with_model(df, "text", make_model, dim=2).collect()]
    assert sorted(got) == [[1.0, 1.0], [3.0, 1.0]]


def test_answer_and_generation_plugins(spark):
    df = spark.createDataFrame([("what?", "alpha beta gamma")], "question string, context string")

    def make_reader():
        def model(questions, contexts):
            return (np.array(["beta"] * len(questions)), np.array([None] * len(questions), dtype=object),
                    np.array([0.5] * len(questions)))
        return model

    r = qa.answer_with_model(df, make_reader).first()
    assert (r.answer, r.answer_start, r.score) == ("beta", 6, 0.5)

    def make_generator():
        return lambda prompts: np.array([p.split()[-1] for p in prompts])

    p = df.select(rag.zero_shot_prompt("context", "question").alias("prompt"))
    out = rag.generate_with_model(p, make_generator).first()
    assert out.response == "Answer:"


def test_model_question_generation_feeds_answers(spark):
    chunks = spark.createDataFrame([(1, 0, "Rivers flow to the sea. Mountains are tall.")],
                                   "doc_id long, chunk_no int, text string")

    def make_generator():
        return lambda prompts: np.array(["  Where do rivers flow?\n\nWhat is tall?\nQ3\nQ4"] * len(prompts))

    gen = qa.generate_questions(chunks, make_generator)
    rows = qa.questions_with_answers(gen, ("doc_id", "chunk_no"), "text",
                                     questions=F.col("questions")).orderBy("q_no").collect()
    assert [r.question for r in rows] == ["Where do rivers flow?", "What is tall?", "Q3"]
    assert rows[0].answer == "Rivers flow to the sea." and rows[1].answer == "Mountains are tall."


def test_streamed_index_equals_full_build(spark, sf_small, scratch):
    from quire.streaming import ingest
    docs = _docs(spark, sf_small)
    src, out, ckpt = f"{scratch}/docs", f"{scratch}/idx", f"{scratch}/ckpt"
    docs.where(F.col("doc_id") < 100).write.parquet(src)
    ingest.ingest_index(spark, src, out, ckpt)
    docs.where(F.col("doc_id") >= 100).write.mode("append").parquet(src)
    ingest.ingest_index(spark, src, out, ckpt)
    stored = sorted((r.doc_id, r.chunk_no, r.text) for r in R.load_index(spark, out).select("doc_id", "chunk_no", "text").collect())
    full = sorted((r.doc_id, r.chunk_no, r.text) for r in R.build_index(docs).select("doc_id", "chunk_no", "text").collect())
    assert stored == full


def test_path_keyed_corpus_is_numbered_then_indexed(spark, sf_small, scratch):
    import os

    import pytest

    from quire.sources import files
    from quire.sources.tables import number_rows
    src = os.path.join(scratch, "corpus")
    rows = _docs(spark, sf_small).limit(30).collect()
    for r in rows:
        os.makedirs(os.path.join(src, str(r.doc_id % 3)), exist_ok=True)
        open(os.path.join(src, str(r.doc_id % 3), f"d{r.doc_id}.txt"), "w", encoding="utf-8").write(r.text)
    docs = files.load_corpus(spark, src).where("text_ok") \
        .select(F.col("rel_path").alias("source"), "text")
    with pytest.raises(TypeError):
        R.build_index(docs.withColumn("doc_id", F.col("source")))
    numbered = number_rows(docs.repartition(3, "source"), "doc_id")
    ids = [r.doc_id for r in numbered.select("doc_id").collect()]
    assert sorted(ids) == list(range(len(rows)))
    path = os.path.join(scratch, "idx")
    assert R.update_index(spark, numbered, path, key="source") == len(rows)
    again = number_rows(docs, "doc_id", start=1000)
    assert R.update_index(spark, again, path, key="source") == 0

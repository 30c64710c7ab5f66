"""

Every query reads the driver tables under ``sf_dir`` whole (no id subsets, no
row caps) and is built from the operators in :mod:`quire`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_statements as oracle
from quire.functions import text as T
from quire.operators import chunking, corpus, embed, evaluate, knn, qa, rag, squad, status
from quire.plans import dataset, rag as rag_plan
from quire.session import materialize, scratch_path
from quire.sources import extractors, files
from quire.sources.tables import spread, table
from quire.streaming import ingest, tasks

try:  # training-data operators: registered when their subpackage is there
    from quire.llm import queries as llm_queries
except ImportError:
    llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"
TASK_ID = "corpus"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def _events_as_status(spark, sf_dir):
    """events as a status log: user = task, event_type = state, props = error text."""
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"), F.col("props").alias("error_message"), "value")


def _benchmark_queries(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                 F.col("text").alias("query"))


def _documents(spark, sf_dir):
    """Documents as scanned; cheap per-row expressions run right on the scan."""
    return _t(spark, sf_dir, "documents")


def _documents_spread(spark, sf_dir):
    """Documents for CPU-heavy folds (wrap, packing, embedding, windows): spread
    across cores when the scan yields too few partitions (a no-op for a corpus
    stored as many files)."""
    return spread(_documents(spark, sf_dir), "doc_id")


# --- queries ------------------------------------------------------------------

def q_knn_topk(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    top = knn.knn_topk(emb, emb.select(F.col("vec_id").alias("qid"), "embedding"), 3)
    return top.select("qid", "rank", "vec_id", F.round("dist", 6).alias("dist"))


def q_knn_topk_dirty(spark, sf_dir):
    """The search over vectors of which some are unusable: a NaN (vec_id % 50 = 1),
    a null element (2), one element missing (3); queries of 4 are one too long."""
    e, m = F.col("embedding"), F.col("vec_id") % 50
    emb = _t(spark, sf_dir, "embeddings").select("vec_id", F.when(
        m == 1, F.concat(F.slice(e, 1, F.size(e) - 1), F.array(F.lit(float("nan")).cast("float"))))
        .when(m == 2, F.concat(F.slice(e, 1, F.size(e) - 1), F.array(F.lit(None).cast("float"))))
        .when(m == 3, F.slice(e, 1, F.size(e) - 1)).otherwise(e).alias("embedding"))
    queries = emb.select(F.col("vec_id").alias("qid"), F.when(
        m == 4, F.concat(e, F.array(F.lit(0.5).cast("float")))).otherwise(e).alias("embedding")).where(m != 3)
    top = knn.knn_topk(emb, queries, 3)
    return top.select("qid", "rank", "vec_id", F.round("dist", 6).alias("dist"))


def q_knn_topk_mixed(spark, sf_dir):
    """Each query with its own top_k: 0 to 6, every seventh the default of 3, and one
    that asks for more vectors than there are."""
    emb = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    k = F.when(F.col("vec_id") == 5, 1_000_000).when(F.col("vec_id") % 7 != 6, F.col("vec_id") % 7)
    top = knn.knn_topk(emb, emb.select(F.col("vec_id").alias("qid"), "embedding", k.alias("top_k")), 3, k_col="top_k")
    return top.select("qid", "rank", "vec_id", F.round("dist", 6).alias("dist"))


def q_index_stats(spark, sf_dir):
    return corpus.index_stats(_t(spark, sf_dir, "embeddings"))


def q_argmax_em(spark, sf_dir):
    logits = _t(spark, sf_dir, "embeddings").select(
        F.col("embedding").alias("start_logits"), F.col("label").alias("label_start"))
    return evaluate.argmax_em(logits).select("n", F.round("exact_match", 6).alias("exact_match"))


def _pages_path(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", "url", T.strip_query("url").alias("path"))


def q_ext_filter(spark, sf_dir):
    return corpus.ext_filter(_pages_path(spark, sf_dir), "path", [".html"]).select("page_id", "url")


def q_ext_audit(spark, sf_dir):
    return corpus.ext_audit(_pages_path(spark, sf_dir), "path", [".html"])


def q_path_parts(spark, sf_dir):
    p = _pages_path(spark, sf_dir)
    key_path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return p.select("page_id", T.basename("path").alias("basename"), T.stem("path").alias("stem"),
                    F.lower(T.suffix("path")).alias("ext"),
                    T.join_key(F.lit("pages"), key_path).alias("key"))


def q_min_text_filter(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return corpus.min_text_filter(d).select("doc_id", F.length(T.py_strip("text")).alias("stripped_len"))


def q_text_prefix(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", qa.text_prefix("text").alias("prefix"))


def q_qgen_prompt(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", qa.question_prompt(qa.text_prefix("text")).alias("prompt"))


def q_page_concat(spark, sf_dir):
    return chunking.assemble_pages(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "")


def q_page_concat_nl(spark, sf_dir):
    return chunking.assemble_pages(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "\n")


def q_corpus_union(spark, sf_dir):
    conv = chunking.assemble_pages(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "\n") \
        .select(F.col("conv_id").alias("doc_id"), "text")
    return corpus.corpus_union([("documents", _documents(spark, sf_dir)), ("conversations", conv)])


def q_incremental_anti(spark, sf_dir):
    return corpus.incremental_anti(_documents(spark, sf_dir).select("doc_id", "n_chars"),
                                   _t(spark, sf_dir, "labels"), ["doc_id"])


def q_quarantine(spark, sf_dir):
    return corpus.quarantine(_documents(spark, sf_dir), ["doc_id"])


def q_latest_status(spark, sf_dir):
    return status.latest_status(_events_as_status(spark, sf_dir))


def q_run_counters(spark, sf_dir):
    return status.run_counters(_events_as_status(spark, sf_dir)) \
        .withColumn("value_sum", F.round("value_sum", 6))


def q_status_progress(spark, sf_dir):
    return status.status_progress(_events_as_status(spark, sf_dir))


def q_active_tasks(spark, sf_dir):
    return status.active_tasks(status.latest_status(_events_as_status(spark, sf_dir)))


def q_parse_questions(spark, sf_dir):
    return T.explode_indexed(_documents(spark, sf_dir), ["doc_id"], qa.parse_questions("text"),
                             "q_no", "question")


def q_truncate_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.truncate_tokens("text", 512).alias("text"))


def q_token_windows(spark, sf_dir):
    return chunking.token_windows(_documents_spread(spark, sf_dir), ["doc_id"], "text", 384, 128)


def q_sentence_pack(spark, sf_dir):
    return chunking.sentence_chunks(_documents_spread(spark, sf_dir), ["doc_id"], "text")


def q_rule_questions(spark, sf_dir):
    kept = corpus.min_text_filter(_documents_spread(spark, sf_dir))
    chunks = chunking.sentence_chunks(kept, ["doc_id"], "text")
    return T.explode_indexed(chunks, ["doc_id", "chunk_no"], qa.rule_questions("text"), "q_no", "question")


def q_qa_pairs(spark, sf_dir):
    return dataset.sentence_qa(_documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


def q_squad_nested(spark, sf_dir):
    """H3/I4: the nested dataset in normal form: a row per paragraph and a row per
    question, with their ordinals."""
    paras, rows = dataset.nested_tables(_documents(spark, sf_dir), TASK_ID)
    none = F.lit(None)
    paras = paras.select(F.lit("paragraph").alias("kind"), "paragraph_no", none.cast("long").alias("position"), "title", "context",
                         "n_qas", *[none.cast("string").alias(c) for c in ("id", "question", "answer")],
                         none.cast("int").alias("answer_start"))
    one = F.col("answers")[0]
    rows = rows.select(F.lit("question").alias("kind"), "paragraph_no", "position", *[none.cast("string").alias(c) for c in ("title", "context")],
                       none.cast("long").alias("n_qas"), "id", "question", one["text"].alias("answer"), one["answer_start"].alias("answer_start"))
    return paras.unionByName(rows)


def q_squad_document(spark, sf_dir):
    """The sentence flow written as one SQuAD document (part files in gzip), and read back."""
    path = scratch_path(spark, f"squad-{uuid.uuid4().hex}")
    dataset.squad_document(_documents(spark, sf_dir), path, TASK_ID, "gzip")
    return squad.read_document(spark, path)


def q_read_squad_flat(spark, sf_dir):
    """Flat records written as JSON lines, and read back."""
    path = scratch_path(spark, f"flat-{uuid.uuid4().hex}")
    flat = dataset.wrapped_qa(_documents(spark, sf_dir)).select(
        "id", "title", "context", "question", "answer_text", "answer_start")
    squad.write_flat(squad.flat_records(flat), path)
    return squad.unflatten_answers(squad.read_flat(spark, path))


def q_index_round_trip(spark, sf_dir):
    """The chunk index written, read back and listed without its vectors."""
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    rag_plan.save_index(rag_plan.build_index(_documents(spark, sf_dir)), path)
    return rag_plan.load_index(spark, path).select(
        "doc_id", "chunk_no", "source", "text", F.size("embedding").alias("dim"))


def q_answer_offset(spark, sf_dir):
    """D5 with answers that are absent or empty: each wrapped chunk looked for in
    its whole document (a line break inside a chunk became a space, so many are
    absent), every seventh chunk's answer empty."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    chunks = chunking.wrap_chunks(_documents_spread(spark, sf_dir), ["doc_id"], "text", 500) \
        .withColumnRenamed("text", "chunk")
    answer = F.when(F.col("chunk_no") % 7 == 6, "").otherwise(F.col("chunk"))
    return chunks.join(docs, "doc_id").select(
        "doc_id", "chunk_no", qa.answer_offset(answer, F.col("text")).alias("answer_start"))


def q_train_eval_split(spark, sf_dir):
    return evaluate.train_eval_split(dataset.sentence_qa(_documents(spark, sf_dir))).select("id", "split")


def q_train_eval_exact(spark, sf_dir):
    """L1 with exactly ceil(0.1 n) rows to evaluate on."""
    return evaluate.exact_split(materialize(dataset.sentence_qa(_documents(spark, sf_dir)).select("id")), "id", 0.1, seed=0)


def q_train_eval_by_document(spark, sf_dir):
    """L1 by document: a quarter of the documents, and all chunks of a document on
    one side."""
    rows = materialize(chunking.sentence_chunks(_documents_spread(spark, sf_dir), ["doc_id"], "text").select("doc_id", "chunk_no"))
    return evaluate.exact_split(rows, "doc_id", 0.25, seed=7)


def q_squad_best_of(spark, sf_dir):
    """H6 with one to three gold answers an id: the answer, for two of three ids also
    the context's first sentence, for one of three also the question; the first
    sentence is predicted, for some ids the answer in other words, for some nothing."""
    rows = evaluate.train_eval_split(dataset.sentence_qa(_documents(spark, sf_dir)))
    ev = materialize(rows.where(F.col("split") == "eval").select("id", "answer", "question", F.try_element_at(
        T.sentence_spans("context"), F.lit(1)).alias("first"), (F.conv(F.substring(F.md5(F.col("id").cast("binary")), 9, 8), 16, 10)
                                                               .cast("long") % 12).alias("m")))
    gold = F.array_compact(F.array("answer", F.when(F.col("m") % 3 != 0, F.col("first")), F.when(F.col("m") % 3 == 1, F.col("question"))))
    said = F.when(F.col("m") % 4 == 0, F.concat(F.lit("The "), "answer", F.lit("!"))).when(F.col("m") % 4 == 1, F.concat_ws(" ", "question", "answer")) \
        .otherwise(F.col("first"))
    out = evaluate.squad_best_of(ev.where("m <> 5").select("id", said.alias("prediction_text")), ev.select("id", gold.alias("answers")))
    return out.select("n", "n_answers", "n_missing", "n_dup_ids", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


def q_extract_answer(spark, sf_dir):
    """F6/D5 with empty and absent answers: every fifth turn's context is empty, and
    the answers are looked for in the lower-cased context."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(
        F.col("turn") % 5 == 4, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    rows = qa.questions_with_answers(turns, ("conv_id", "turn"), "text")
    return rows.select("conv_id", "turn", "q_no", "question", "answer", F.round("score", 6).alias("score"),
                       qa.answer_offset("answer", F.lower("context")).alias("answer_start"))


def q_squad_em_f1(spark, sf_dir):
    """Scores the first-sentence baseline against the held-out split's answers;
    about a third of the references have no prediction (by a hash of the id)."""
    rows = evaluate.train_eval_split(dataset.sentence_qa(_documents(spark, sf_dir)))
    # predictions and references both come from the held-out rows: write them
    # once so the id join below does not run the QA plan twice
    ev = materialize(rows.where(F.col("split") == "eval").select("id", "answer", "context"))
    refs = ev.select("id", F.col("answer").alias("answer_text"))
    preds = ev.select("id", F.try_element_at(T.sentence_spans("context"), F.lit(1)).alias("prediction_text")) \
        .where(F.conv(F.substring(F.md5(F.col("id").cast("binary")), 9, 8), 16, 10).cast("long") % 3 != 0)
    return evaluate.squad_em_f1(preds, refs).select(
        "n", "n_missing", "n_dup_ids", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


def q_wrap_chunks(spark, sf_dir):
    return chunking.wrap_chunks(_documents_spread(spark, sf_dir), ["doc_id"], "text", 500)


def q_hash_embed(spark, sf_dir):
    sparse = embed.hash_embed_sparse(_documents_spread(spark, sf_dir), ["doc_id"], "text")
    return sparse.withColumn("weight", F.round("weight", 6))


def q_qa_flat(spark, sf_dir):
    return dataset.wrapped_qa(_documents(spark, sf_dir)).select(
        "id", "title", "context", "question", "answer_text", "answer_start")


def q_qa_flat_json(spark, sf_dir):
    flat = dataset.wrapped_qa(_documents(spark, sf_dir)).select(
        "id", "title", "context", "question", "answer_text", "answer_start")
    return squad.json_lines(squad.flat_records(flat))


def q_train_examples(spark, sf_dir):
    """Answers looked for in their whole documents; those that are not there
    (wrapping took a line break out of them) are dropped."""
    return qa.train_examples(dataset.anchored_qa(_documents(spark, sf_dir)))


def _index(spark, sf_dir):
    """The chunk index of the documents: one stored table per session, to which each
    use adds the documents it has not yet."""
    path = scratch_path(spark, f"rag-index-{hashlib.md5(sf_dir.encode()).hexdigest()}")
    return rag_plan.stored_index(spark, _documents(spark, sf_dir), path)


def q_rag_index_stats(spark, sf_dir):
    """H1 on the stored chunk index."""
    return corpus.index_stats(_index(spark, sf_dir))


def q_qa_token_windows(spark, sf_dir):
    """E5 as training uses it: 384-token windows with 128 overlap over whole
    documents, the question kept whole in every window, and the answer's place."""
    ex = qa.train_examples(dataset.document_qa(_documents(spark, sf_dir)))
    return chunking.answer_windows(ex, ["id"])


def q_rag_context(spark, sf_dir):
    return rag_plan.contexts(_index(spark, sf_dir), _benchmark_queries(spark, sf_dir))


def q_rag_prompt(spark, sf_dir):
    q = _benchmark_queries(spark, sf_dir)
    ctx = rag_plan.contexts(_index(spark, sf_dir), q)
    a = q.join(ctx, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return a.select("qid", rag.zero_shot_prompt("context", "query").alias("zero_shot"),
                    T.truncate_tokens(rag.few_shot_prompt("context", "query"), 512).alias("few_shot_truncated"))


def q_rag_answer(spark, sf_dir):
    return rag_plan.answers(_index(spark, sf_dir), _benchmark_queries(spark, sf_dir)) \
        .select("qid", "query", "context", "response")


def q_rag_context_mixed(spark, sf_dir):
    """H2 with each query's own number of hits: 0 to 4, every sixth the default."""
    q = _benchmark_queries(spark, sf_dir).withColumn("top_k", F.when(F.col("qid") % 6 != 5, F.col("qid") % 6))
    return rag_plan.contexts(_index(spark, sf_dir), q)


def q_page_extract(spark, sf_dir):
    """Pages and failed attempts of two extractors over the raw pages."""
    raw = _t(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return files.extract_pages(raw, [extractors.html_paragraphs, extractors.html_stripped], "page_id")


#: events as a task log: what each event type stands for
TASK_EVENTS = {"signup": tasks.PENDING, "view": tasks.RUNNING, "click": tasks.PROGRESS,
               "purchase": tasks.COMPLETED, "error": tasks.FAILED}


def q_task_status(spark, sf_dir):
    """M2: the task state machine over the events (user = task): a progress event is a
    file done, its value the examples it gave; six hours without an event make a
    task that is under way stale."""
    raw = ingest.stream_documents(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    kind = F.create_map(*[F.lit(x) for pair in TASK_EVENTS.items() for x in pair])
    events = raw.select(F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), kind[F.col("event_type")].alias("event"),
                        F.lit(1).alias("n"), F.floor("value").alias("examples"), F.col("props").alias("message"))
    run = scratch_path(spark, f"tasks-{uuid.uuid4().hex}")
    tasks.track(spark, events, f"{run}/view", f"{run}/_checkpoint", stale_after=6 * 3600, delay="1 hour")
    return tasks.task_rows(spark, f"{run}/view", "long")


def q_stream_sentence_pack(spark, sf_dir):
    """M1: the sentence chunker run as an incremental availableNow stream over
    the documents table; returns what the stream wrote (same rows as batch)."""
    return ingest.stream_sentence_chunks(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


def q_stream_latest_status(spark, sf_dir):
    """M2: latest status per task kept by an incremental streaming aggregation
    over the events table; same rows as the batch view."""
    return ingest.stream_latest_status(spark, f"{sf_dir.rstrip('/')}/events.parquet")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "knn_topk": q_knn_topk,
    "knn_topk_dirty": q_knn_topk_dirty,
    "knn_topk_mixed": q_knn_topk_mixed,
    "index_stats": q_index_stats,
    "argmax_em": q_argmax_em,
    "ext_filter": q_ext_filter,
    "ext_audit": q_ext_audit,
    "path_parts": q_path_parts,
    "min_text_filter": q_min_text_filter,
    "text_prefix": q_text_prefix,
    "qgen_prompt": q_qgen_prompt,
    "page_concat": q_page_concat,
    "page_concat_nl": q_page_concat_nl,
    "corpus_union": q_corpus_union,
    "incremental_anti": q_incremental_anti,
    "quarantine": q_quarantine,
    "latest_status": q_latest_status,
    "run_counters": q_run_counters,
    "status_progress": q_status_progress,
    "active_tasks": q_active_tasks,
    "parse_questions": q_parse_questions,
    "truncate_tokens": q_truncate_tokens,
    "token_windows": q_token_windows,
    "sentence_pack": q_sentence_pack,
    "rule_questions": q_rule_questions,
    "qa_pairs": q_qa_pairs,
    "squad_nested": q_squad_nested,
    "squad_document": q_squad_document,
    "read_squad_flat": q_read_squad_flat,
    "index_round_trip": q_index_round_trip,
    "answer_offset": q_answer_offset,
    "train_eval_split": q_train_eval_split,
    "train_eval_exact": q_train_eval_exact,
    "train_eval_by_document": q_train_eval_by_document,
    "squad_best_of": q_squad_best_of,
    "extract_answer": q_extract_answer,
    "squad_em_f1": q_squad_em_f1,
    "wrap_chunks": q_wrap_chunks,
    "hash_embed": q_hash_embed,
    "qa_flat": q_qa_flat,
    "qa_flat_json": q_qa_flat_json,
    "train_examples": q_train_examples,
    "rag_index_stats": q_rag_index_stats,
    "qa_token_windows": q_qa_token_windows,
    "rag_context": q_rag_context,
    "rag_prompt": q_rag_prompt,
    "rag_answer": q_rag_answer,
    "rag_context_mixed": q_rag_context_mixed,
    "page_extract": q_page_extract,
    "task_status": q_task_status,
    "stream_sentence_pack": q_stream_sentence_pack,
    "stream_latest_status": q_stream_latest_status,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: documents -> 500-char chunks -> hashed embeddings -> exact
    top-3 for every benchmark item -> context -> prompt -> extractive answer."""
    return q_rag_answer(spark, SMOKE_DIR)


def _wide_ints(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registered results use 64-bit integers throughout (ordinals, sizes and
    counts alike), the integer type the SQL oracle produces."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        small = {"int", "smallint", "tinyint"}
        return df.select(*[F.col(c).cast("bigint").alias(c) if t in small else F.col(c)
                           for c, t in df.dtypes])
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _wide_ints(v) for k, v in _QUERIES.items()}
    if llm_queries is not None:
        out |= llm_queries.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    sql = oracle.statements()
    # the stream writes exactly what the batch chunker produces
    sql["stream_sentence_pack"] = sql["sentence_pack"]
    sql["stream_latest_status"] = sql["latest_status"]
    out = {k: v for k, v in sql.items() if k in _QUERIES}
    if llm_queries is not None:
        out |= llm_queries.ORACLE_SQL
    return out

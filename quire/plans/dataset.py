"""QA dataset plans.

* :func:`sentence_qa` - the dataset-service flow: minimum text -> sentence pack
  -> rule questions -> extractive answers -> ``{doc}_chunk_{i}_qa_{j}`` ids.
* :func:`wrapped_qa` - the generator flow: 500-char wrap -> questions ->
  answers -> flat records with a deterministic md5 id and a title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunking, corpus, qa, squad
from quire.session import materialize
from quire.sources.tables import spread


def sentence_qa(docs: DataFrame, max_length: int = 512, min_length: int = 50) -> DataFrame:
    """``(id, doc_id, chunk_no, q_no, context, question, answer, answer_start, score)``."""
    kept = corpus.min_text_filter(spread(docs.select("doc_id", "text"), "doc_id"), "text")
    chunks = chunking.sentence_chunks(kept, ("doc_id",), "text", max_length, min_length)
    rows = qa.questions_with_answers(chunks, ("doc_id", "chunk_no"), "text")
    return rows.select(qa.structured_id().alias("id"), "doc_id", "chunk_no", "q_no", "context",
                       "question", "answer", "answer_start", "score")


def wrapped_qa(docs: DataFrame, width: int = 500, title_col: str = "source") -> DataFrame:
    """``(id, title, doc_id, chunk_no, q_no, context, question, answer_text, answer_start)``."""
    chunks = chunking.wrap_chunks(spread(docs, "doc_id"), ("doc_id",), "text", width, keep=(title_col,))
    rows = qa.questions_with_answers(chunks, ("doc_id", "chunk_no"), "text", keep=(title_col,))
    return rows.select(qa.record_id("doc_id", "chunk_no", "q_no").alias("id"),
                       F.col(title_col).alias("title"), "doc_id", "chunk_no", "q_no", "context",
                       "question", F.col("answer").alias("answer_text"), "answer_start")


def document_qa(docs: DataFrame, title_col: str = "source") -> DataFrame:
    """Questions over whole documents, at most three each: ``(id, title, doc_id,
    q_no, context, question, answer_text, answer_start)``, the context being the
    document's text."""
    rows = qa.questions_with_answers(spread(docs.select("doc_id", title_col, "text"), "doc_id"), ("doc_id",), "text",
                                     keep=(title_col,))
    return rows.select(qa.record_id("doc_id", "q_no").alias("id"), F.col(title_col).alias("title"), "doc_id", "q_no",
                       "context", "question", F.col("answer").alias("answer_text"), "answer_start")


def anchored_qa(docs: DataFrame, width: int = 500, title_col: str = "source") -> DataFrame:
    """The generator flow's questions and answers over the documents they come from:
    as :func:`wrapped_qa`, with the whole document as context and the answer looked
    for in it.  Wrapping turned line breaks into spaces, so an answer that went over
    a line is absent there (``answer_start`` -1).  Rows meet their document by a join
    on ``doc_id``."""
    rows = wrapped_qa(docs, width, title_col).drop("context", "answer_start")
    whole = docs.select("doc_id", F.col("text").alias("context"))
    return rows.join(whole, "doc_id").withColumn("answer_start", qa.answer_offset("answer_text", "context")) \
        .select("id", "title", "doc_id", "chunk_no", "q_no", "context", "question", "answer_text", "answer_start")


def nested_tables(docs: DataFrame, task_id: str) -> tuple[DataFrame, DataFrame]:
    """B2 input in normal form: (paragraphs, questions) of the sentence flow with
    their ordinals (:func:`quire.operators.squad.numbered_tables`)."""
    return squad.numbered_tables(materialize(sentence_qa(docs), "sentence-qa"), task_id)


def nested_dataset(docs: DataFrame, task_id: str) -> DataFrame:
    """B2 input: paragraphs of the sentence flow, grouped by context."""
    return squad.paragraphs(sentence_qa(docs), task_id)


def squad_document(docs: DataFrame, path: str, task_id: str, compression: str | None = None) -> None:
    """B2: the sentence flow's dataset as one SQuAD document in ``path``.  The QA
    rows are written first, as the document is put together from several reads;
    answers are written there as their place in the context."""
    qa_rows = materialize(squad.cut_answers(sentence_qa(docs).drop("score")), "squad-rows", "zstd")
    squad.write_document(squad.whole_answers(qa_rows), path, task_id, compression)

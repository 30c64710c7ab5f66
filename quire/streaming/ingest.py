"""M1/M2: incremental ingest with Structured Streaming.

``availableNow`` runs process whatever arrived since the last run and stop;
the checkpoint under the session's ``spark.checkpoint.dir`` records progress,
so a rerun (or a retry after a lost executor) picks up only new files and the
file sink commits each micro-batch exactly once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chunking, status
from quire.session import scratch_path
from quire.streaming import views


def _run_available_now(df: DataFrame, out_path: str, ckpt: str, mode: str = "append",
                       fmt: str = "parquet") -> None:
    q = (df.writeStream.format(fmt).outputMode(mode)
         .option("checkpointLocation", ckpt).option("path", out_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_documents(spark: SparkSession, path: str, schema=None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a table folder, or of one file inside a folder (the
    folder is watched with a glob filter on that file name); the schema is
    taken from the batch reader, never inferred per micro-batch."""
    schema = schema or spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if path.rstrip("/").endswith(".parquet") and not _is_dir(spark, path):
        folder, name = path.rstrip("/").rsplit("/", 1)
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def ingest_sentence_chunks(spark: SparkSession, source: str, out_path: str, ckpt: str) -> None:
    """One incremental run: new documents -> sentence chunks appended to ``out_path``."""
    docs = stream_documents(spark, source)
    chunks = chunking.sentence_chunks(docs, ["doc_id"], "text")
    _run_available_now(chunks, out_path, ckpt)


def stream_sentence_chunks(spark: SparkSession, source: str, run_id: str | None = None) -> DataFrame:
    """Runs :func:`ingest_sentence_chunks` into a fresh folder under the
    checkpoint dir and returns what the stream wrote."""
    run = run_id or uuid.uuid4().hex
    out_path = scratch_path(spark, f"stream-chunks-{run}/data")
    ckpt = scratch_path(spark, f"stream-chunks-{run}/_checkpoint")
    ingest_sentence_chunks(spark, source, out_path, ckpt)
    return spark.read.parquet(out_path)


def _latest_status_agg(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct(F.col("status"), F.col("error_message").alias("err"), F.col("ts")),
                    F.struct(F.col("ts"), F.col("seq")))
    return (events.groupBy("task_id").agg(last.alias("_l"), F.count(F.lit(1)).alias("n_events"))
            .select("task_id", F.col("_l.status").alias("status"),
                    F.when(F.col("_l.status").isin(*status.ERROR_STATES), F.col("_l.err"))
                    .alias("error_message"),
                    status.iso_timestamp(F.col("_l.ts")).alias("updated_at"), "n_events"))


def stream_status(spark: SparkSession, events: DataFrame, query_name: str) -> "object":
    """M2 (interactive): latest status per task maintained by a streaming
    aggregation in ``complete`` mode into a memory table named ``query_name``;
    the caller stops the returned query.  For tests and notebooks."""
    return (_latest_status_agg(events).writeStream.format("memory").queryName(query_name)
            .outputMode("complete")
            .option("checkpointLocation", scratch_path(spark, f"status-{query_name}-{uuid.uuid4().hex}"))
            .start())


def stream_status_table(spark: SparkSession, events: DataFrame, out_path: str, ckpt: str) -> None:
    """M2: the same aggregation run incrementally (``availableNow``); each epoch's
    complete result is published as the view in ``out_path`` by moving a pointer
    (:func:`quire.streaming.views.read_view` reads it), so readers see the view before
    or after an epoch, and a re-run resumes from the checkpointed state."""
    q = (_latest_status_agg(events).writeStream.outputMode("complete")
         .foreachBatch(lambda batch, epoch: views.publish_view(batch, out_path, epoch))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_latest_status(spark: SparkSession, events_path: str, run_id: str | None = None) -> DataFrame:
    """Runs :func:`stream_status_table` over a status-event table (events as a
    status log: user = task, event_type = state, props = error text) and
    returns the published view."""
    run = run_id or uuid.uuid4().hex
    raw = stream_documents(spark, events_path)
    ev = raw.select(F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"),
                    F.col("event_type").alias("status"), F.col("props").alias("error_message"))
    out_path = scratch_path(spark, f"stream-status-{run}/view")
    stream_status_table(spark, ev, out_path, scratch_path(spark, f"stream-status-{run}/_checkpoint"))
    return views.read_view(spark, out_path)


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest_corpus_files(spark: SparkSession, base: str, qa_path: str, quarantine_path: str,
                        ckpt: str, extensions=(".txt",), extractors: dict | None = None,
                        max_files_per_trigger: int = 10_000, on_epoch=None) -> None:
    """One incremental run of the dataset job over a folder of files: new files
    only -> text -> QA rows in ``qa_path``; files that are malformed, unreadable,
    too short or of an unsupported kind go to ``quarantine_path`` with their reason
    instead of disappearing.

    ``extensions`` are read as UTF-8 text.  ``extractors`` (extension -> chain of
    extractors, see :func:`quire.sources.files.extract_texts`) adds other kinds, such as
    ``.pdf``; a failed file's quarantine row holds every attempt and its reason in
    ``detail``.  Files of other kinds are listed, never opened.

    Progress lives in ``ckpt``; a micro-batch holds ``max_files_per_trigger`` files at
    most.  Its files are read once, into ``<qa_path>/_texts``; QA and quarantine rows
    come from there, each in the epoch's own folder, and both logs are moved on by
    their pointers last (:func:`quire.streaming.views.read_log` reads them).  An epoch
    that is run again after a failure writes over what it left.  ``on_epoch(epoch,
    texts, qa)`` is called in between, with the epoch's written tables."""
    from quire.functions import text as T
    from quire.operators import corpus as C
    from quire.plans import dataset
    from quire.sources.files import extension_glob, extract_texts

    chains = {k.lower(): v for k, v in (extractors or {}).items()}
    native = [e.lower() for e in extensions if e.lower() not in chains]
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", extension_glob([*native, *chains]))
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_per_trigger).load(base)
             .select(F.col("path").alias("doc_id"), F.lower(T.suffix("path")).alias("ext"), "content"))
    no_failures = F.array().cast("array<struct<attempt:int,reason:string>>")
    is_native = F.col("ext").isin(native)

    def texts_of(batch: DataFrame) -> DataFrame:
        # undecodable bytes become U+FFFD; what the rule goes by is the bytes' validity
        ok, text = (F.call_function(f, F.col("content")) for f in ("is_valid_utf8", "make_valid_utf8"))
        if not chains:
            return batch.select("doc_id", ok.alias("text_ok"), text.alias("text"), no_failures.alias("failures"))
        # one pass: the bytes of kinds with extractors take the Arrow map, others are decoded before it
        x = batch.select("doc_id", "ext", F.when(is_native, ok).otherwise(True).alias("text_ok"), F.when(is_native, text).alias("plain"),
                         F.when(~is_native, F.col("content")).alias("content"))
        return extract_texts(x, chains).select(
            "doc_id", "text_ok", F.when(is_native, F.col("plain")).when(F.col("extractor") >= 0, F.col("text")).alias("text"),
            F.when(is_native, no_failures).otherwise(F.col("failures")).alias("failures"))

    def run(batch: DataFrame, epoch: int) -> None:
        state, reason = C.quarantine_columns("text", valid_col="text_ok")
        rows = texts_of(batch).select("doc_id", "text", state.alias("status"), F.when(
            F.col("text").isNull() & (F.size("failures") > 0), F.lit("unreadable")).otherwise(reason).alias("reason"),
            F.array_join(F.transform("failures", lambda x: F.concat_ws(": ", x["attempt"].cast("string"), x["reason"])), "; ").alias("detail"))
        stage = f"{qa_path.rstrip('/')}/_texts/epoch={epoch}"
        rows.write.mode("overwrite").parquet(stage)
        texts = spark.read.parquet(stage)
        bad = texts.where(F.col("status") != "ok").select("doc_id", "reason", "detail")
        views.append_epoch(bad, quarantine_path, epoch)
        views.append_epoch(dataset.sentence_qa(texts.where(F.col("status") == "ok").select("doc_id", "text")), qa_path, epoch)
        if on_epoch is not None:
            on_epoch(epoch, texts, spark.read.parquet(f"{qa_path.rstrip('/')}/epoch={epoch}"))
        views.commit_epoch(spark, quarantine_path, epoch)
        views.commit_epoch(spark, qa_path, epoch)

    q = (files.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def unsupported_files(spark: SparkSession, base: str, supported) -> DataFrame:
    """``(doc_id, reason, detail)`` for files of ``base`` of another kind than
    ``supported``: a listing, no file is opened."""
    from quire.operators import corpus as C
    from quire.sources.files import file_manifest
    ext = C.extension("path")
    return file_manifest(spark, base).where(~ext.isin([e.lower() for e in supported])) \
        .select(F.col("path").alias("doc_id"), F.lit("unsupported").alias("reason"), ext.alias("detail"))


def ingest_index(spark: SparkSession, docs_path: str, index_path: str, ckpt: str,
                 width: int = 500) -> None:
    """A10/B3 as a stream: documents arriving in ``docs_path`` are chunked,
    embedded and appended to the index table, one ``epoch=`` partition per
    micro-batch (overwritten on retry, so exactly-once).  Queries read the
    table with :func:`quire.plans.rag.load_index`."""
    from quire.plans import rag as rag_plan

    def run(batch: DataFrame, epoch: int) -> None:
        rag_plan.build_index(batch, width).sortWithinPartitions(*rag_plan.ID) \
            .write.mode("overwrite").parquet(f"{index_path.rstrip('/')}/epoch={epoch}")

    q = (stream_documents(spark, docs_path).writeStream.foreachBatch(run)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()

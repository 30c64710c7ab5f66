"""Status views, corpus files and incremental streaming."""

import datetime as dt
import os

from pyspark.sql import functions as F

from quire.operators import chunking, corpus, status
from quire.sources import files
from quire.streaming import ingest, views


def _events(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("a", t, 1, "pending", None, 0.0),
            ("a", t + dt.timedelta(seconds=1, microseconds=5), 2, "running", None, 1.0),
            ("a", t + dt.timedelta(seconds=2), 3, "failed", "boom", 2.0),
            ("b", t, 1, "pending", "ignored", 0.0),
            ("b", t, 2, "running", "masked", 3.0)]
    return spark.createDataFrame(rows, "task_id string, ts timestamp_ntz, seq long, status string, "
                                        "error_message string, value double")


def test_latest_status_and_error_mask(spark):
    got = {r.task_id: r for r in status.latest_status(_events(spark)).collect()}
    assert (got["a"].status, got["a"].error_message, got["a"].updated_at) == \
        ("failed", "boom", "2024-01-01T00:00:02")
    # same timestamp: the later sequence number wins; non-error states hide the message
    assert (got["b"].status, got["b"].error_message, got["b"].n_events) == ("running", None, 2)


def test_counters_and_iso_format(spark):
    ev = _events(spark)
    c = {r.task_id: r for r in status.run_counters(ev).collect()}
    assert (c["a"].total, c["a"].processed, c["a"].failed) == (3, 2, 1)
    p = {r.task_id: r for r in status.status_progress(ev).collect()}
    assert p["a"].started_at == dt.datetime(2024, 1, 1).isoformat()
    assert p["a"].last_update_at == dt.datetime(2024, 1, 1, 0, 0, 2).isoformat()
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 1, 5),)], "ts timestamp_ntz")
    assert one.select(status.iso_timestamp("ts").alias("s")).first().s == \
        dt.datetime(2024, 1, 1, 0, 0, 1, 5).isoformat()


def test_streaming_status_equals_batch(spark):
    ev = _events(spark)
    # the same rows as files read by a stream
    path = os.path.join(ingest.scratch_path(spark, "status-src"), "ev")
    ev.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(ev.schema).parquet(path)
    q = ingest.stream_status(spark, stream, "status_view_test")
    q.processAllAvailable()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM status_view_test").collect())
    q.stop()
    want = sorted(tuple(r) for r in status.latest_status(ev).collect())
    assert got == want


def _write(base, rel, data):
    p = os.path.join(base, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_listing_reading_and_quarantine(spark, scratch):
    base = os.path.join(scratch, "corpus")
    _write(base, "a/x.txt", b"hello from a " * 20)
    _write(base, "b/x.txt", b"hello from b " * 20)       # same stem, other folder
    _write(base, "b/UPPER.TXT", b"upper case extension " * 10)
    _write(base, "c/bad.txt", b"bad \xff\xfe bytes " * 20)  # malformed UTF-8
    _write(base, "c/skip.bin", b"\x00\x01")
    _write(base, "top.pdf", b"%PDF-1.4 not really")
    man = {r.rel_path: r for r in files.file_manifest(spark, base).collect()}
    assert set(man) == {"a/x.txt", "b/x.txt", "b/UPPER.TXT", "c/bad.txt", "c/skip.bin", "top.pdf"}
    assert man["c/skip.bin"].length == 2
    sup = {r.rel_path for r in files.list_supported(spark, base).collect()}
    assert sup == {"a/x.txt", "b/x.txt", "b/UPPER.TXT", "c/bad.txt", "top.pdf"}
    audit = {r.ext: r.n_files for r in corpus.ext_audit(files.file_manifest(spark, base), "path").collect()}
    assert audit == {".bin": 1}
    docs = files.load_corpus(spark, base)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {"a/x.txt", "b/x.txt", "b/UPPER.TXT", "c/bad.txt"}
    assert got["a/x.txt"].text.startswith("hello from a") and got["a/x.txt"].text_ok
    assert not got["c/bad.txt"].text_ok
    q = {r.doc_id: (r.status, r.reason) for r in corpus.quarantine(docs, ["doc_id"], valid_col="text_ok").collect()}
    assert q["c/bad.txt"] == ("quarantine", "bad_utf8") and q["a/x.txt"] == ("ok", None)


def test_extractor_fallback_chain(spark, scratch):
    base = os.path.join(scratch, "pdfs")
    _write(base, "one.pdf", b"PAGE1|PAGE2")
    _write(base, "two.pdf", b"BROKEN")  # zero-length files are never scanned by Spark
    raw = spark.read.format("binaryFile").load(base).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_id"), "content")

    def primary(b):
        if b == b"BROKEN":
            raise ValueError("unreadable")
        return b.decode().split("|")

    def secondary(b):
        return ""

    pages = files.extract_documents(raw, [primary, secondary])
    got = sorted((r.doc_id, r.page_no, r.text, r.extractor) for r in pages.collect())
    assert got == [("one.pdf", 0, "PAGE1", 0), ("one.pdf", 1, "PAGE2", 0), ("two.pdf", 0, "", -1)]
    docs = {r.doc_id: r.text for r in chunking.assemble_pages(pages, "doc_id", "page_no", "text", "\n").collect()}
    assert docs == {"one.pdf": "PAGE1\nPAGE2", "two.pdf": ""}


def test_incremental_stream_picks_up_only_new_files(spark, scratch, sf_small):
    src = os.path.join(scratch, "incoming")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    docs.where(F.col("doc_id") % 2 == 0).coalesce(1).write.parquet(os.path.join(src, "p1"))
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    ingest.ingest_sentence_chunks(spark, src + "/p1", out, ckpt)
    first = spark.read.parquet(out).count()
    # second run on the same source: nothing new, nothing written twice
    ingest.ingest_sentence_chunks(spark, src + "/p1", out, ckpt)
    assert spark.read.parquet(out).count() == first
    docs.where(F.col("doc_id") % 2 == 1).coalesce(1).write.mode("append").parquet(os.path.join(src, "p1"))
    ingest.ingest_sentence_chunks(spark, src + "/p1", out, ckpt)
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select("doc_id", "chunk_no", "text").collect())
    batch = sorted(tuple(r) for r in chunking.sentence_chunks(docs, ["doc_id"], "text").collect())
    assert streamed == batch


def test_status_table_stream_incremental_equals_batch(spark, scratch):
    ev = _events(spark)
    src = os.path.join(scratch, "ev")
    ev.where(F.col("seq") == 1).write.parquet(src)
    out, ckpt = os.path.join(scratch, "view"), os.path.join(scratch, "ckpt")
    stream = spark.readStream.schema(ev.schema).parquet(src)
    ingest.stream_status_table(spark, stream, out, ckpt)
    ev.where(F.col("seq") > 1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    ingest.stream_status_table(spark, stream, out, ckpt)
    got = sorted(tuple(r) for r in views.read_view(spark, out).collect())
    want = sorted(tuple(r) for r in status.latest_status(ev).collect())
    assert got == want


def test_dataset_plan_runs_on_a_stream(spark, scratch, sf_small):
    from quire.plans import dataset
    src = os.path.join(scratch, "docs")
    spark.read.parquet(f"{sf_small}/documents.parquet").write.parquet(src)
    stream = ingest.stream_documents(spark, src)
    out, ckpt = os.path.join(scratch, "qa"), os.path.join(scratch, "qa_ckpt")
    ingest._run_available_now(dataset.sentence_qa(stream), out, ckpt)
    batch = dataset.sentence_qa(spark.read.parquet(src))
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == \
        sorted(r.id for r in batch.select("id").collect())


def test_corpus_file_stream_ingests_new_files_and_quarantines(spark, scratch):
    base = os.path.join(scratch, "files")
    good = ("Rivers flow to the sea in 2020. They carry water from the mountains to the city. "
            "Where does the water go after that? It evaporates and falls again as rain. ") * 3
    _write(base, "a/one.txt", good.encode())
    _write(base, "a/short.txt", b"too short")
    qa_out, q_out, ckpt = (os.path.join(scratch, n) for n in ("qa", "quarantine", "ckpt"))
    ingest.ingest_corpus_files(spark, base, qa_out, q_out, ckpt)
    first = spark.read.parquet(qa_out).count()
    assert first > 0
    _write(base, "b/two.TXT", good.replace("Rivers", "Streams").encode())
    _write(base, "b/bad.txt", b"\xff\xfe" + good.encode())
    ingest.ingest_corpus_files(spark, base, qa_out, q_out, ckpt)
    ids = {r.doc_id.rsplit("/", 2)[-2] + "/" + r.doc_id.rsplit("/", 1)[-1]
           for r in spark.read.parquet(qa_out).select("doc_id").distinct().collect()}
    assert ids == {"a/one.txt", "b/two.TXT"}
    assert spark.read.parquet(qa_out).count() == 2 * first
    reasons = {r.doc_id.rsplit("/", 1)[-1]: r.reason for r in spark.read.parquet(q_out).collect()}
    assert reasons == {"short.txt": "too_short", "bad.txt": "bad_utf8"}


def test_spread_balances_null_keys(spark):
    from quire.sources.tables import spread
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"))
    df = df.coalesce(1)
    out = spread(df, "doc_id", min_partitions=8)
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert out.count() == 4000 and len(sizes) == 8
    assert max(r["count"] for r in sizes) < 4000 / 8 * 1.5


def test_non_recursive_pdf_listing(spark, scratch):
    base = os.path.join(scratch, "flat")
    _write(base, "a.PDF", b"x")
    _write(base, "b.pdf", b"x")
    _write(base, "c.txt", b"x")
    _write(base, "sub/d.pdf", b"x")
    got = {r.rel_path for r in files.list_supported(spark, base, [".pdf"], recursive=False).collect()}
    assert got == {"a.PDF", "b.pdf"}

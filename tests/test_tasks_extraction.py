"""Task state machine, published views, extraction with reasons, the dataset job."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking
from quire.plans import jobs
from quire.sources import extractors, files
from quire.streaming import ingest, tasks, views

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _event(task, minutes, seq, event, n=0, examples=0, message=None):
    return task, T0 + dt.timedelta(minutes=minutes), seq, event, n, examples, message


def _append(spark, path, rows):
    spark.createDataFrame(rows, tasks.EVENTS).coalesce(1).write.mode("append").parquet(path)


def _track(spark, scratch, **options):
    events = spark.readStream.schema(tasks.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/events")
    tasks.track(spark, events, f"{scratch}/view", f"{scratch}/ckpt", **options)
    return {r.task_id: r for r in tasks.task_rows(spark, f"{scratch}/view").collect()}


def test_task_machine_over_several_runs(spark, scratch):
    _append(spark, f"{scratch}/events", [
        _event("a", 3, 4, "progress", 2, 7), _event("a", 0, 1, "pending"), _event("a", 1, 2, "running"), _event("a", 2, 3, "total", 5),
        _event("b", 0, 1, "running"), _event("b", 1, 2, "pending"), _event("b", 2, 3, "failed", message="boom"),
        _event("c", 0, 1, "pending"), _event("c", 0, 2, "running"), (None, T0, 1, "pending", 0, 0, None), ("d", T0, 1, None, 0, 0, None)])
    got = _track(spark, scratch, stale_after=600)
    assert set(got) == {"a", "b", "c"}
    a, b = got["a"], got["b"]
    assert (a.status, a.total_files, a.processed_files, a.generated_examples, a.started_at, a.completed_at) == \
        ("running", 5, 2, 7, "2024-01-01T00:00:00", None)
    assert (b.status, b.error_message, b.completed_at, b.n_illegal, b.run_no) == ("failed", "boom", "2024-01-01T00:02:00", 1, 1)
    assert not any(r.stale for r in got.values())
    # a later run: the counters go on; a failed task starts anew; an old event changes nothing
    _append(spark, f"{scratch}/events", [
        _event("a", 10, 5, "progress", 3, 1), _event("a", 11, 6, "completed"), _event("a", 11, 7, "progress", 1, 1),
        _event("b", 1, 9, "running"), _event("b", 12, 10, "pending"), _event("b", 300, 11, "running")])
    got = _track(spark, scratch, stale_after=600)
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.status, a.processed_files, a.generated_examples, a.completed_at, a.n_illegal) == ("completed", 5, 8, "2024-01-01T00:11:00", 1)
    assert (b.status, b.run_no, b.error_message, b.started_at, b.n_late, b.completed_at) == ("running", 2, None, "2024-01-01T00:12:00", 1, None)
    # five hours have gone by for c, which is under way: its timer marked it; a is done, b is new
    assert (c.status, c.stale, a.stale, b.stale) == ("running", True, False, False)
    _append(spark, f"{scratch}/events", [_event("c", 301, 3, "failed", message="late in the day")])
    c = _track(spark, scratch, stale_after=600)["c"]
    assert (c.status, c.stale, c.error_message) == ("failed", False, "late in the day")
    # nothing new: the view stays
    before = views.current(spark, f"{scratch}/view")
    assert _track(spark, scratch, stale_after=600)["c"].status == "failed"
    assert views.current(spark, f"{scratch}/view") is not None and before is not None


def test_step_follows_the_legal_transitions():
    s = tasks.fresh()
    for i, (event, want) in enumerate([("completed", None), ("pending", "pending"), ("progress", "pending"), ("running", "running"),
                                       ("pending", "running"), ("completed", "completed"), ("failed", "completed"), ("pending", "pending")]):
        tasks.step(s, i, 0, event, 1, 1, None)
        assert s["status"] == want, event
    assert (s["n_illegal"], s["run_no"], s["processed_files"]) == (4, 2, 0)


def test_readers_see_the_old_view_or_the_new_one(spark, scratch):
    folder = f"{scratch}/view"
    assert views.read_view(spark, folder, "x int").count() == 0
    with pytest.raises(FileNotFoundError):
        views.read_view(spark, folder)
    views.publish_view(spark.createDataFrame([(1,)], "x int"), folder, 0)
    old = views.read_view(spark, folder)
    # an epoch that was written but not pointed to, as after a kill
    spark.createDataFrame([(9,)], "x int").write.parquet(f"{folder}/table-000000000001-dead")
    assert [r.x for r in views.read_view(spark, folder).collect()] == [1]
    views.publish_view(views.read_view(spark, folder).select((F.col("x") + 1).alias("x")), folder, 1)
    assert [r.x for r in views.read_view(spark, folder).collect()] == [2]
    assert [r.x for r in old.collect()] == [1]  # a reader that has begun keeps its table
    for i in range(2, 6):
        views.publish_view(spark.createDataFrame([(i,)], "x int"), folder, i)
    assert [r.x for r in views.read_view(spark, folder).collect()] == [5]
    assert len([n for n in os.listdir(folder) if n.startswith("table-")]) == 2


GOOD = ("Rivers flow to the sea in 2020. They carry water from the mountains to the city. "
        "Where does the water go after that? It evaporates and falls again as rain. ") * 3


def _write(base, rel, data):
    p = os.path.join(base, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_killed_run_repeats_without_duplicates(spark, scratch):
    base, qa, bad, ckpt = (os.path.join(scratch, n) for n in ("files", "qa", "bad", "ckpt"))
    _write(base, "a/one.txt", GOOD.encode())
    ingest.ingest_corpus_files(spark, base, qa, bad, ckpt)
    first = views.read_log(spark, qa).count()
    _write(base, "b/two.txt", GOOD.replace("Rivers", "Streams").encode())
    _write(base, "b/short.txt", b"short")

    def killed(epoch, texts, rows):
        # written, not published: readers still see the first epoch
        assert rows.count() > 0 and views.read_log(spark, qa).count() == first
        raise RuntimeError("killed")

    with pytest.raises(Exception):
        ingest.ingest_corpus_files(spark, base, qa, bad, ckpt, on_epoch=killed)
    assert views.read_log(spark, qa).count() == first and views.read_log(spark, bad).count() == 0
    ingest.ingest_corpus_files(spark, base, qa, bad, ckpt)
    rows = views.read_log(spark, qa)
    assert rows.count() == 2 * first == rows.select("id").distinct().count()
    assert [r.reason for r in views.read_log(spark, bad).collect()] == ["too_short"]
    ingest.ingest_corpus_files(spark, base, qa, bad, ckpt)
    assert views.read_log(spark, qa).count() == 2 * first


def pdf_chain():
    """Two extractors (made here, so that workers need not import this module)."""
    def first(content):
        if content.startswith(b"BROKEN"):
            raise ValueError("no pages")
        return [] if content == b"EMPTY" else content.decode().split("|")

    def second(content):
        return "rescued " * 20 if b"RESCUE" in content else ""

    return [first, second]


def test_extraction_reports_every_failed_attempt(spark):
    rows = [(1, b"p1|p2"), (2, b"BROKEN"), (3, b"EMPTY"), (4, b"BROKEN RESCUE"), (5, None), (None, b"x")]
    df = spark.createDataFrame(rows, "page long, content binary")
    got = files.extract_pages(df, pdf_chain(), "page")
    assert dict(got.dtypes)["page"] == "bigint"  # the id keeps its type
    pages = sorted((r.page or 0, r.page_no, r.text, r.extractor) for r in files.pages_of(got).collect())
    assert pages == [(0, 0, "x", 0), (1, 0, "p1", 0), (1, 1, "p2", 0), (2, 0, "", -1), (3, 0, "", -1), (4, 0, "rescued " * 20, 1), (5, 0, "", -1)]
    failed = sorted((r.page, r.attempt, r.reason) for r in files.failures_of(got).collect())
    assert failed == [(2, 0, "ValueError: no pages"), (2, 1, "empty"), (3, 0, "empty"), (3, 1, "empty"), (4, 0, "ValueError: no pages"),
                      (5, 0, "empty"), (5, 1, "empty")]
    docs = {r.page: r.text for r in chunking.assemble_pages(files.pages_of(got), "page", "page_no", "text", "\n").collect()}
    assert docs[1] == "p1\np2" and docs[2] == ""
    assert files.extract_pages(df.where("page > 9"), pdf_chain()[:1], "page").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SinglePartition" not in plan


def test_dataset_job_appends_its_events(spark, scratch):
    base, events, out, ckpt = (os.path.join(scratch, n) for n in ("files", "events", "out", "ckpt"))
    _write(base, "a/one.txt", GOOD.encode())
    _write(base, "a/short.txt", b"short")
    _write(base, "b/doc.PDF", GOOD.replace("Rivers", "Pages").encode())
    _write(base, "b/bad.pdf", b"BROKEN")
    _write(base, "b/image.png", b"\x00\x01")
    log = jobs.start_task(spark, events, "t1")
    chain = {".pdf": pdf_chain()}
    jobs.run_dataset_task(spark, log, base, out, ckpt, extractors=chain, max_files_per_trigger=2)
    qa = views.read_log(spark, f"{out}/qa")
    assert {r.doc_id.rsplit("/", 1)[-1] for r in qa.select("doc_id").distinct().collect()} == {"one.txt", "doc.PDF"}
    bad = {r.doc_id.rsplit("/", 1)[-1]: (r.reason, r.detail) for r in views.read_log(spark, f"{out}/quarantine").collect()}
    assert bad == {"short.txt": ("too_short", ""), "bad.pdf": ("unreadable", "0: ValueError: no pages; 1: empty")}
    assert [r.detail for r in spark.read.parquet(f"{out}/unsupported").collect()] == [".png"]

    def state():
        ev = spark.readStream.schema(tasks.EVENTS).parquet(events)
        tasks.track(spark, ev, f"{scratch}/view", f"{scratch}/view_ckpt")
        return {r.task_id: r for r in tasks.task_rows(spark, f"{scratch}/view").collect()}

    r = state()["t1"]
    assert (r.status, r.total_files, r.processed_files, r.generated_examples, r.n_illegal, r.n_late) == ("completed", 4, 4, qa.count(), 0, 0)
    assert r.started_at <= r.completed_at and r.error_message is None
    # a job that fails leaves its error
    _write(base, "c/new.txt", GOOD.encode())
    log2 = jobs.start_task(spark, events, "t2")
    with pytest.raises(Exception):
        jobs.run_dataset_task(spark, log2, base, out, ckpt, extensions=(".txt",), extractors={".pdf": None})
    r = state()["t2"]
    assert r.status == "failed" and r.error_message


def test_html_extractors():
    page = b"<html><body><p>one</p><p>t<b>w</b>o</p></body></html>"
    assert extractors.html_paragraphs(page) == ["one"]
    assert extractors.html_stripped(page).pop().split() == ["one", "t", "w", "o"]
    with pytest.raises(ValueError):
        extractors.html_paragraphs(page[:-3])
    with pytest.raises(UnicodeDecodeError):
        extractors.utf8_text(b"\xff")

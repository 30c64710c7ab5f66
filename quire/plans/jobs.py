"""The dataset job as a task: it runs the incremental ingest of a folder and appends
its own events, from which :mod:`quire.streaming.tasks` keeps the task's row."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import corpus
from quire.sources import files
from quire.streaming import ingest, tasks


class EventLog:
    """Appends a task's events to a folder, in the order of the calls."""

    def __init__(self, spark: SparkSession, path: str, task_id: str):
        self.spark, self.path, self.task_id, self.seq = spark, path, task_id, 0

    def add(self, event: str, n: int = 0, examples: int = 0, message: str | None = None) -> None:
        self.seq += 1
        now = dt.datetime.now(dt.timezone.utc)
        row = (self.task_id, now, self.seq, event, n, examples, message)
        self.spark.createDataFrame([row], tasks.EVENTS).coalesce(1).write.mode("append").parquet(self.path)


def start_task(spark: SparkSession, events_path: str, task_id: str | None = None) -> EventLog:
    """Registers a task: its first event, ``pending``."""
    log = EventLog(spark, events_path, task_id or str(uuid.uuid4()))
    log.add(tasks.PENDING)
    return log


def run_dataset_task(spark: SparkSession, log: EventLog, base: str, out: str, ckpt: str, *,
                     extensions: Sequence[str] = (".txt",), extractors: dict | None = None,
                     max_files_per_trigger: int = 10_000) -> None:
    """One run over ``base``: QA rows in ``<out>/qa``, refused files in
    ``<out>/quarantine``, files of other kinds in ``<out>/unsupported``.  Events:
    ``running``, a ``total`` with the number of supported files, a ``progress`` per
    epoch (its files, and the examples they gave), then ``completed``, or ``failed`` with
    the error, which is raised again.  Counts are aggregates over the epoch's written
    tables."""
    kinds = [*extensions, *(extractors or {})]
    out = out.rstrip("/")
    try:
        log.add(tasks.RUNNING)
        found = files.file_manifest(spark, base).agg(F.count_if(corpus.extension("path").isin(
            [k.lower() for k in kinds])).alias("n")).first()["n"]
        log.add(tasks.TOTAL, n=found)

        def on_epoch(_epoch: int, texts: DataFrame, qa: DataFrame) -> None:
            log.add(tasks.PROGRESS, n=texts.count(), examples=qa.count())

        ingest.ingest_corpus_files(spark, base, f"{out}/qa", f"{out}/quarantine", ckpt, extensions, extractors,
                                   max_files_per_trigger, on_epoch)
        ingest.unsupported_files(spark, base, kinds).write.mode("overwrite").parquet(f"{out}/unsupported")
    except Exception as e:
        log.add(tasks.FAILED, message=f"{type(e).__name__}: {e}"[:2000])
        raise
    log.add(tasks.COMPLETED)

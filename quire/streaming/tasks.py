"""M2: the state of every task, kept by a stream over an append-only event log.

A job appends events ``(task_id, ts, seq, event, n, examples, message)``:

* state events ``pending``, ``running``, ``completed``, ``failed`` (``message``: the
  error);
* ``total`` (``n`` files were found) and ``progress`` (``n`` files done, which gave
  ``examples``).

:class:`TaskMachine` holds one row of state per task, with the transitions of LEGAL.
``pending`` begins a run: counters, times and error start anew.  An event that is not
legal in the task's state changes nothing and is counted in ``n_illegal``; one that is
older than the task's last event, in ``n_late``.  A task that is neither completed nor
failed and has had no event for ``stale_after`` seconds of event time is marked
``stale`` by a timer; its next event clears the mark.

:func:`track` keeps the latest row of every task in a published view
(:mod:`quire.streaming.views`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quire.operators.status import iso_timestamp
from quire.streaming import views

# fixed values: a task's states
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
TOTAL, PROGRESS = "total", "progress"

LEGAL = {None: (PENDING,), PENDING: (RUNNING, FAILED), RUNNING: (COMPLETED, FAILED, TOTAL, PROGRESS),
         COMPLETED: (PENDING,), FAILED: (PENDING,)}

_FIELDS = ("run_no", "status", "total_files", "processed_files", "generated_examples", "error_message",
           "started_us", "completed_us", "n_illegal", "n_late", "stale", "last_us", "last_seq")
_STATE = ("run_no long, status string, total_files long, processed_files long, generated_examples long, "
          "error_message string, started_us long, completed_us long, n_illegal long, n_late long, stale boolean, "
          "last_us long, last_seq long")
EVENTS = "task_id string, ts timestamp, seq long, event string, n long, examples long, message string"


def step(state: dict, us: int, seq: int, event: str, n: int, examples: int, message: str | None) -> None:
    """One event of a task, in place."""
    if (us, seq) <= (state["last_us"], state["last_seq"]):
        state["n_late"] += 1
        return
    state["last_us"], state["last_seq"], state["stale"] = us, seq, False
    if event not in LEGAL[state["status"]]:
        state["n_illegal"] += 1
    elif event == TOTAL:
        state["total_files"] += n
    elif event == PROGRESS:
        state["processed_files"] += n
        state["generated_examples"] += examples
    else:
        state["status"] = event
        if event == PENDING:
            state.update(run_no=state["run_no"] + 1, total_files=0, processed_files=0, generated_examples=0,
                         error_message=None, started_us=us, completed_us=None)
        elif event != RUNNING:
            state["completed_us"] = us
            state["error_message"] = message if event == FAILED else None


def fresh() -> dict:
    return dict(zip(_FIELDS, (0, None, 0, 0, 0, None, None, None, 0, 0, False, -(1 << 62), 0)))


class TaskMachine(StatefulProcessor):
    """One value of state per task.  A micro-batch's events of a task are put in order
    by (ts, seq); a micro-batch is bounded by the stream's files per trigger."""

    def __init__(self, stale_after: float):
        self.stale_ms = int(stale_after * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", _STATE)

    def _load(self) -> dict:
        return dict(zip(_FIELDS, self.state.get())) if self.state.exists() else fresh()

    def _row(self, key, state: dict) -> Row:
        self.state.update(tuple(state[f] for f in _FIELDS))
        return Row(task_id=key[0], **{f: state[f] for f in _FIELDS})

    def handleInputRows(self, key, rows, timerValues):
        state = self._load()
        for r in sorted((r["us"], r["seq"], r["event"], r["n"], r["examples"], r["message"]) for r in rows):
            step(state, r[0], r[1], r[2], r[3], r[4], r[5] or None)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state["status"] in (PENDING, RUNNING):
            self.handle.registerTimer(state["last_us"] // 1000 + self.stale_ms)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self._load()
        if state["status"] in (PENDING, RUNNING):
            state["stale"] = True
            yield self._row(key, state)


def machine_rows(events: DataFrame, stale_after: float, delay: str) -> DataFrame:
    """Updates of task rows from a stream of events; needs the RocksDB state store."""
    kind = events.schema["task_id"].dataType.simpleString()
    x = events.select("task_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "event",
                      F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"),
                      F.coalesce(F.col("examples").cast("long"), F.lit(0)).alias("examples"),
                      F.coalesce("message", F.lit("")).alias("message")) \
        .where("task_id is not null and ts is not null and seq is not null and event is not null") \
        .withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return x.groupBy("task_id").transformWithState(TaskMachine(stale_after), f"task_id {kind}, {_STATE}", "update", "eventTime")


def _iso(us: str) -> Column:
    return iso_timestamp(F.timestamp_micros(us))


def track(spark: SparkSession, events: DataFrame, view: str, ckpt: str, *, stale_after: float = 3600,
          delay: str = "1 hour") -> None:
    """One incremental run (``availableNow``): new events -> task rows, merged into the
    view.  ``events`` is a streaming DataFrame with the columns of EVENTS (``task_id`` of
    any type).  The view holds a row per task; an epoch that is run again puts the same
    rows in the same places."""
    schema = f"task_id {events.schema['task_id'].dataType.simpleString()}, {_STATE}"

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy("task_id").agg(F.max_by(F.struct(*_FIELDS), F.struct("last_us", "last_seq", "n_late", "stale")).alias("s")) \
            .select("task_id", "s.*")
        old = views.read_view(spark, view, schema)
        views.publish_view(old.join(new.select("task_id"), "task_id", "left_anti").unionByName(new), view, epoch)

    # state in RocksDB (on disk, not in the workers' memory); as many state partitions
    # as there are cores twice over, at most
    conf = spark.conf
    wanted = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.shuffle.partitions": str(min(int(conf.get("spark.sql.shuffle.partitions")),
                                                      2 * spark.sparkContext.defaultParallelism))}
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        q = (machine_rows(events, stale_after, delay).writeStream.outputMode("update").foreachBatch(merge)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)
    q.awaitTermination()


def task_rows(spark: SparkSession, view: str, task_id: str = "string") -> DataFrame:
    """The published row of every task: ``(task_id, run_no, status, total_files,
    processed_files, generated_examples, error_message, started_at, completed_at,
    n_illegal, n_late, stale)``, times as ISO texts."""
    rows = views.read_view(spark, view, f"task_id {task_id}, {_STATE}")
    return rows.select("task_id", "run_no", "status", "total_files", "processed_files", "generated_examples", "error_message",
                       _iso("started_us").alias("started_at"), _iso("completed_us").alias("completed_at"),
                       "n_illegal", "n_late", "stale")

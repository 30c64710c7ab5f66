"""Task status from an append-only status-event table.

Every status change is a row ``(task_id, ts, seq, status, counters...)``;
the current view is derived, never updated in place.  All aggregations are
partial on the map side (``max_by`` and counters), so a task with a very large
share of events still reduces to one row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the states a run and an inference service report
RUN_STATES = ("pending", "running", "completed", "failed")
INFERENCE_STATES = ("initializing", "generating_qa_pairs", "fine_tuning", "evaluating",
                    "loading_model", "inference_ready", "error")
TERMINAL_STATES = ("completed", "failed", "inference_ready", "error")
ERROR_STATES = ("error", "failed")


def iso_timestamp(ts) -> Column:
    """``datetime.isoformat()``: microseconds only when non-zero (UTC session)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.when(F.date_format(t, "SSSSSS") == "000000",
                  F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def latest_status(events: DataFrame, task_col: str = "task_id", ts_col: str = "ts",
                  seq_col: str = "seq", status_col: str = "status",
                  error_col: str = "error_message") -> DataFrame:
    """The last event per task by ``(ts, seq)``; the error text is shown
    only when that status is an error state."""
    last = F.max_by(F.struct(F.col(status_col).alias("status"), F.col(error_col).alias("err"),
                             F.col(ts_col).alias("ts")),
                    F.struct(F.col(ts_col), F.col(seq_col)))
    return (events.groupBy(F.col(task_col).alias("task_id"))
            .agg(last.alias("_l"), F.count(F.lit(1)).alias("n_events"))
            .select("task_id", F.col("_l.status").alias("status"),
                    F.when(F.col("_l.status").isin(*ERROR_STATES), F.col("_l.err")).alias("error_message"),
                    iso_timestamp(F.col("_l.ts")).alias("updated_at"),
                    "n_events"))


def run_counters(events: DataFrame, task_col: str = "task_id", status_col: str = "status",
                 value_col: str = "value") -> DataFrame:
    """H4: per task, events seen, processed (non-error) and failed ones, and the
    summed counter value."""
    is_err = F.col(status_col).isin(*ERROR_STATES)
    return (events.groupBy(F.col(task_col).alias("task_id"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(~is_err).alias("processed"),
                 F.count_if(is_err).alias("failed"),
                 F.sum(value_col).alias("value_sum")))


def status_progress(events: DataFrame, task_col: str = "task_id", ts_col: str = "ts") -> DataFrame:
    """Per task, first and last event time as ISO strings."""
    return (events.groupBy(F.col(task_col).alias("task_id"))
            .agg(F.min(ts_col).alias("_s"), F.max(ts_col).alias("_e"))
            .select("task_id", iso_timestamp("_s").alias("started_at"),
                    iso_timestamp("_e").alias("last_update_at")))


def active_tasks(latest: DataFrame) -> DataFrame:
    """H5: number of tasks per current status (active = not terminal)."""
    return (latest.groupBy("status")
            .agg(F.count(F.lit(1)).alias("n_tasks"))
            .withColumn("active", ~F.col("status").isin(*TERMINAL_STATES)))

"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quire", driver_memory: str = "16g") -> SparkSession:
    """Local session used by tests and bench; a cluster passes its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", driver_memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator to a shared filesystem.  Only when
    it is unset (local tests) do we create one, so lineage cuts and stream
    checkpoints always land in the folder the session names.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir() or conf
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="quire-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written tables and stream state."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


def materialize(df, name: str | None = None, compression: str | None = None):
    """Cut lineage by writing ``df`` as a Parquet table into the session's
    checkpoint folder (shared storage on a cluster) and reading it back;
    ``compression`` is the table's, else the session's.

    One pass: Spark's eager reliable ``checkpoint()`` runs the plan once to
    count and again to write unless the data is cached; a written table is
    computed exactly once, survives lost executors, and several consumers
    then read it instead of recomputing the plan.
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"materialized/{name or 'df'}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)

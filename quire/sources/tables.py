"""Readers for the driver tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, min_partitions: int | None = None,
           bytes_per_partition: int = 256 << 10) -> DataFrame:
    """Hash-spread rows on ``key`` when the scan yields too few partitions.

    A table stored as one file with one row group scans as a single task, so
    CPU-heavy row folds (wrap, sentence pack, embedding) would run on one core.
    The target is about one partition per ``bytes_per_partition`` of input (the
    optimizer's estimate, i.e. compressed Parquet bytes; text folds cost much CPU
    per byte), at most twice the default parallelism.  When
    the input already has that many partitions (the normal case for a large
    table stored as many files) nothing is added; a repartition with an
    explicit count is not coalesced back by AQE.
    """
    if df.isStreaming:  # micro-batches are partitioned by the source
        return df
    spark = df.sparkSession
    if min_partitions is None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        target = min(2 * spark.sparkContext.defaultParallelism,
                     max(1, -(-size // bytes_per_partition)))
    else:
        target = min_partitions
    if df.rdd.getNumPartitions() >= target:
        return df
    # rows without a key are spread by scan position (deterministic for a file
    # scan) instead of all hashing to one partition
    k = F.col(key)
    return df.repartition(target, F.when(k.isNull(), F.monotonically_increasing_id())
                          .otherwise(F.xxhash64(k)))


def number_rows(df: DataFrame, col: str = "doc_id", start: int = 0) -> DataFrame:
    """Contiguous 64-bit ids ``start, start + 1, ...`` without a shuffle (the
    DataFrame form of zip-with-index): one job counts rows per partition (one
    small row per partition reaches the driver), then each partition numbers
    its rows from its offset in an Arrow map.  ``df`` must be deterministic
    (a file scan or a materialised table) so both passes see the same rows."""
    import pyarrow as pa

    counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    offsets, acc = {}, start
    for r in sorted(counts, key=lambda r: r["p"]):
        offsets[r["p"]] = acc
        acc += r["count"]

    def run(batches):
        from pyspark import TaskContext
        nxt = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            ids = pa.array(range(nxt, nxt + batch.num_rows), pa.int64())
            nxt += batch.num_rows
            yield pa.RecordBatch.from_arrays(batch.columns + [ids], names=batch.schema.names + [col])

    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(col, LongType(), False)])
    return df.mapInArrow(run, schema)

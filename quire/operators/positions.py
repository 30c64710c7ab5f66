"""Exact row positions inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize


def number_within(df: DataFrame, group: list[str], order: list[str], col: str = "position",
                  total: str | None = None, name: str = "numbered") -> DataFrame:
    """``df`` with each row's position (from 0) in its group by ``order``
    (ascending, nulls first) as ``col`` and, if asked for, the group's row count
    as ``total``.

    A range sort deals the rows out by (group, order); a partition's rows of a
    group are counted, and the counts of the partitions before it are a row's
    offset.  So a group may span any number of partitions, and what a window sees
    is one count per partition and group, never the group's rows.  Rows that are
    equal in ``group`` and ``order`` are told apart by their place in ``df``, so
    that a hot value is split too.

    ``df`` should be a scan or a written table: its plan runs twice, once for the
    sample of the range sort.  The sorted rows are written to the checkpoint folder.
    Empty input gives an empty result; null groups are a group of their own.
    """
    work = {"_nw_tie", "_nw_part", "_nw_row", "_nw_first", "_nw_n"} & set(df.columns)
    if work:
        raise ValueError(f"reserved column names: {sorted(work)}")
    keys = [*group, *order, "_nw_tie"]
    x = df.withColumn("_nw_tie", F.monotonically_increasing_id()) \
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_nw_tie")
    x = materialize(x.withColumn("_nw_part", F.spark_partition_id())
                    .withColumn("_nw_row", F.monotonically_increasing_id()), name)
    per = x.groupBy("_nw_part", *group).agg(F.min("_nw_row").alias("_nw_first"), F.count(F.lit(1)).alias("_nw_n"))
    whole = Window.partitionBy(*group)
    before = F.sum("_nw_n").over(whole.orderBy("_nw_part").rowsBetween(Window.unboundedPreceding, -1))
    named = [F.col(g).alias(f"_nw_g{i}") for i, g in enumerate(group)]
    per = per.select(F.col("_nw_part").alias("_nw_p"), *named,
                     (F.coalesce(before, F.lit(0)) - F.col("_nw_first")).alias("_nw_shift"),
                     F.sum("_nw_n").over(whole).alias("_nw_total"))
    same: list[Column] = [F.col("_nw_part") == F.col("_nw_p")]
    same += [F.col(g).eqNullSafe(F.col(f"_nw_g{i}")) for i, g in enumerate(group)]
    out = x.join(per, reduce(lambda a, b: a & b, same))
    extra = [F.col("_nw_total").alias(total)] if total else []
    kept = [c for c in df.columns if c not in (col, total)]
    return out.select(*kept, (F.col("_nw_row") + F.col("_nw_shift")).alias(col), *extra)

"""Mixing sources to target weights.

Sizes (word counts) are summed per source.  Targets share ``share`` times all
words by weight, each at most ``most`` times its source; what a full source
cannot take goes to the others by weight (water-filling, in closed form over
the per-source table).  A document of a source with rate r = target / size is
emitted floor(r) times plus one Bernoulli copy with probability r - floor(r).

The Bernoulli draws are hash-seeded and systematic: a source's documents are
dealt by hash into strata of about ``stratum`` rows; inside a stratum, in order
of size, the k-th document gets the copy when floor(k f + u) passes an integer,
u being the stratum's hashed seed.  Every document still has probability f, but
the words taken stay near the target, however uneven the sizes are, and no
stratum grows with a hot source.

Defined cases: a null text has size 0; the null source is a source of its own,
last in order; size-0 documents follow their source's rate; repeated rows are
separate documents; a source without words has target 0; an empty table gives
an empty result; a null id hashes as a fixed value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import n_words, require, unit_hash
from quire.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(mx_source, mx_size, mx_rows) -> target per source.  ``sizes`` has one row
    per source; its windows run over that table only."""
    in_order = Window.orderBy(F.col("mx_source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    w = sizes.withColumn("mx_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    # sources fill in the order of cap / weight; while the sources before are full,
    # the level is what is left of the share over the weights still open
    fill = Window.orderBy(F.col("mx_cap") / F.col("mx_w"), F.col("mx_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("mx_cap", F.col("mx_size") * F.lit(float(most)))
    w = w.withColumn("mx_all", F.sum("mx_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share)))
    w = w.withColumn("mx_level", (F.col("mx_all") - F.coalesce(F.sum("mx_cap").over(before), F.lit(0.0)))
                     / F.sum("mx_w").over(after))
    # the first source that stays below its cap fixes the level for all after it
    open_ = F.col("mx_level") * F.col("mx_w") < F.col("mx_cap")
    w = w.withColumn("mx_final", F.first(F.when(open_, F.col("mx_level")), ignorenulls=True)
                     .over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return w.select("mx_source", "mx_size", "mx_rows", F.when(F.col("mx_final").isNull(), F.col("mx_cap"))
                    .otherwise(F.least(F.col("mx_cap"), F.col("mx_final") * F.col("mx_w"))).alias("mx_target"))


def planned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *,
            weights=WEIGHTS, share: float = 1.5, most: float = 2.0, stratum: int = 4096,
            seed: str = "mix", keep_row: bool = False, broadcast_sources: int = 100_000) -> DataFrame:
    """One row per document: mx_id, mx_n (size), mx_source, mx_size (of the
    source), mx_target, mx_copies, and with ``keep_row`` the document as the
    struct mx_row (its own column names cannot clash with ours)."""
    require(docs, doc_id, text, source)
    cols = [F.col(doc_id).alias("mx_id"), F.col(source).alias("mx_source"), n_words(F.col(text)).alias("mx_n")]
    x = docs.select(*cols, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mx_row")] if keep_row else []))
    per = docs.select(*cols).groupBy("mx_source").agg(F.sum("mx_n").alias("mx_size"), F.count(F.lit(1)).alias("mx_rows"))
    t = materialize(targets(per, weights, share, most), "mix-targets")
    t = t.withColumn("mx_strata", F.ceil(F.col("mx_rows") / F.lit(stratum))).withColumnRenamed("mx_source", "mx_s2")
    # one row per source: broadcast when that is checked to be few, else joined
    small = t.limit(broadcast_sources + 1).count() <= broadcast_sources
    rate = F.when(F.col("mx_size") > 0, F.col("mx_target") / F.col("mx_size")).otherwise(F.lit(0.0))
    x = x.join(F.broadcast(t) if small else t, F.col("mx_source").eqNullSafe(F.col("mx_s2"))).withColumn("mx_rate", rate)
    x = x.withColumn("mx_h", unit_hash(F.lit(seed), F.col("mx_id")))
    x = x.withColumn("mx_stratum", F.floor(F.col("mx_h") * F.col("mx_strata")))
    k = F.row_number().over(Window.partitionBy("mx_source", "mx_stratum").orderBy("mx_n", "mx_h", "mx_id"))
    f = F.col("mx_rate") - F.floor("mx_rate")
    u = unit_hash(F.lit(seed), F.lit("stratum"), F.col("mx_source"), F.col("mx_stratum"))
    extra = F.floor(F.col("mx_k") * f + u) - F.floor((F.col("mx_k") - 1) * f + u)
    x = x.withColumn("mx_k", k).withColumn("mx_copies", (F.floor("mx_rate") + extra).cast("long"))
    return x.select("mx_id", "mx_n", "mx_source", "mx_size", "mx_target", "mx_copies", *(["mx_row"] if keep_row else []))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    plan = planned(docs, doc_id, text, source, keep_row=True, **options).where("mx_copies > 0")
    return plan.select("mx_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mx_copies")))).select("mx_row.*")

"""Exact k-nearest-neighbour retrieval and context assembly.

A k-nearest-neighbour join over metric cells (no cross join, no side held whole):

1. Pivots are sampled from the corpus (``cells`` vectors at most).  A corpus vector
   belongs to the cell of its nearest pivot; a task reports how many vectors lie in
   each cell and ring around its pivot, so that what the driver learns of the corpus
   is ``cells x RINGS`` rows.
2. A query's distances to the pivots give, by the triangle inequality, the distance
   within which ``top_k`` vectors must lie (the rings' counts and outer radii) and, for
   each cell, the least distance a vector in it can have (rings and the plane between
   two pivots).  The query is sent to the cells it cannot rule out, only.
3. Cells are split by a salt into groups of about ``corpus_rows`` vectors and
   ``query_rows`` queries, and both sides meet in a cogroup.  Corpus vectors of cells
   that no query needs are dropped in the scan.  A group keeps, for each query, its
   ``top_k`` best by exact distance.
4. Each query's survivors are ranked by (distance, id).

A cell that holds a large part of the corpus, copies of one vector for instance, only
has more salts.  Every query has its own ``top_k``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pivots at most, rings of a cell, vectors and queries of a group.
CELLS, RINGS = 64, 16
CORPUS_ROWS, QUERY_ROWS = 8192, 2048
# distances are ranked on this many decimals so that mathematically equal
# distances computed in different summation orders tie, and the id decides
RANK_DECIMALS = 9
# candidate pairs whose exact distances are computed at once
CANDIDATE_SLICE = 1 << 16
# queries whose distances to a group's vectors are estimated at once
QUERY_SLICE = 256


class Cells(NamedTuple):
    """Pivots (p, d), the distances between them, each cell's least and greatest
    radius, salts, and its rings that hold vectors: cell, outer radius, count."""
    pivots: np.ndarray
    gap: np.ndarray
    low: np.ndarray
    high: np.ndarray
    salts: np.ndarray
    ring_cell: np.ndarray
    ring_radius: np.ndarray
    ring_count: np.ndarray


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances (len(a), len(b)), by differences, in slices."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for at in range(0, len(a), step):
        d = a[at:at + step, None, :] - b[None]
        out[at:at + step] = np.sqrt(np.einsum("qpd,qpd->qp", d, d))
    return out


def _usable(batch: pa.RecordBatch, col: int, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector in column ``col`` has ``dim`` finite elements, and these
    as a matrix; a null element reads as NaN."""
    lens = pc.fill_null(pc.list_value_length(batch.column(col)), -1).to_numpy(zero_copy_only=False)
    if not (lens == dim).all():
        batch = batch.filter(pa.array(lens == dim))
    mat = batch.column(col).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    finite = np.isfinite(mat).all(axis=1)
    if not finite.all():
        batch, mat = batch.filter(pa.array(finite)), mat[finite]
    return batch, mat


def _nearest(mat: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each vector and its distance to that cell's pivot."""
    cell = np.argmin(np.einsum("pd,pd->p", pivots, pivots)[None] - 2.0 * (mat @ pivots.T), axis=1)
    d = mat - pivots[cell]
    return cell.astype(np.int32), np.sqrt(np.einsum("nd,nd->n", d, d))


def _sampled(corpus: DataFrame, dim: int, n: int) -> np.ndarray:
    """``n`` usable vectors at most, uniform over the rows: each task draws its own
    ``n`` smallest numbers, the smallest of all stay."""
    def run(batches):
        from pyspark import TaskContext
        rng = np.random.default_rng(TaskContext.get().partitionId())
        draw, kept = np.empty(0), np.empty((0, dim))
        for batch in batches:
            _, mat = _usable(batch, 0, dim)
            draw, kept = np.concatenate([draw, rng.random(len(mat))]), np.concatenate([kept, mat])
            first = np.argsort(draw, kind="stable")[:n]
            draw, kept = draw[first], kept[first]
        off = pa.array(np.arange(0, kept.size + 1, dim), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(draw), pa.ListArray.from_arrays(off, pa.array(kept.ravel()))], names=["u", "v"])

    rows = corpus.select("cv").mapInArrow(run, "u double, v array<double>").orderBy("u").limit(n).collect()
    return np.array([r["v"] for r in rows]).reshape(-1, dim)


def _cells_of(corpus: DataFrame, dim: int, cells: int, corpus_rows: int) -> Cells | None:
    """Pivots and what the corpus looks like from them; None without a usable vector."""
    sample = _sampled(corpus, dim, 2 * cells)
    if not len(sample):
        return None
    pivots = np.unique(sample[:cells], axis=0)
    width = max(_nearest(sample, pivots)[1].max() * 2 / RINGS, 1e-12)
    p = len(pivots)

    def run(batches):
        count, high, low = np.zeros(p * RINGS, np.int64), np.zeros(p * RINGS), np.full(p * RINGS, np.inf)
        for batch in batches:
            _, mat = _usable(batch, 0, dim)
            cell, r = _nearest(mat, pivots)
            ring = cell * RINGS + np.minimum(r / width, RINGS - 1).astype(np.int64)
            count += np.bincount(ring, minlength=p * RINGS)
            np.maximum.at(high, ring, r)
            np.minimum.at(low, ring, r)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(high[some]), pa.array(low[some])],
                                         names=["ring", "n", "high", "low"])

    rows = corpus.select("cv").mapInArrow(run, "ring long, n long, high double, low double").groupBy("ring").agg(
        F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low")).collect()  # p * RINGS rows at most
    ring, n = np.array([r["ring"] for r in rows]), np.array([r["n"] for r in rows])
    radius, cell = np.array([r["high"] for r in rows]), ring // RINGS
    low, high = np.full(p, np.inf), np.zeros(p)
    np.minimum.at(low, cell, [r["low"] for r in rows])
    np.maximum.at(high, cell, radius)
    salts = np.maximum(1, -(-np.bincount(cell, weights=n, minlength=p).astype(np.int64) // corpus_rows)).astype(np.int32)
    return Cells(pivots, _distances(pivots, pivots), low, high, salts, cell, radius, n)


def _reach(c: Cells, to_pivot: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A distance within which each query has its ``k`` vectors (inf: it has not)."""
    outer = to_pivot[:, c.ring_cell] + c.ring_radius
    order = np.argsort(outer, axis=1)
    have = np.cumsum(c.ring_count[order], axis=1)
    at = (have < k[:, None]).sum(1)
    rows = np.arange(len(k))
    return np.where(at < have.shape[1], outer[rows, order[rows, np.minimum(at, have.shape[1] - 1)]], np.inf)


def _open_cells(c: Cells, to_pivot: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which cells may hold a vector within ``reach`` of each query."""
    own = np.argmin(to_pivot, axis=1)
    rows = np.arange(len(own))
    gap = c.gap[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (to_pivot ** 2 - to_pivot[rows, own][:, None] ** 2) / (2 * gap), 0.0)
    least = np.maximum(np.maximum(to_pivot - c.high, c.low - to_pivot), np.maximum(plane, 0.0))
    # rounding of the distances, and ties of the ranked squares
    least = np.maximum(least * (1 - 1e-9) - 1e-9 * to_pivot, 0.0)
    return least ** 2 <= (reach ** 2 * (1 + 1e-9))[:, None] + 1e-8


def _asked(queries: DataFrame, dim: int, c: Cells) -> DataFrame:
    """Each query with its row number, its reach (squared) and the cells it needs."""
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        for batch in (whole.slice(at, QUERY_SLICE) for whole in batches for at in range(0, whole.num_rows, QUERY_SLICE)):
            batch, mat = _usable(batch, 2, dim)
            if not batch.num_rows:
                continue
            to_pivot = _distances(mat, c.pivots)
            reach = _reach(c, to_pivot, batch.column(1).to_numpy())
            q, cell = np.nonzero(_open_cells(c, to_pivot, reach))
            off = pa.array(np.searchsorted(q, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (cell, c.salts[cell])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + batch.num_rows)), *batch.columns, pa.array(reach ** 2), *lists],
                names=["qrow", "qid", "top_k", "qv", "reach", "cells", "salts"])
            row += batch.num_rows

    return queries.mapInArrow(run, "qrow long, qid long, top_k int, qv array<float>, reach double, cells array<int>, salts array<int>")


def _dealt(corpus: DataFrame, dim: int, c: Cells, needed: np.ndarray, id_schema: str) -> DataFrame:
    """The corpus vectors of needed cells with their cell and salt."""
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() * 7919
        for batch in batches:
            batch, mat = _usable(batch, batch.num_columns - 1, dim)
            cell, _ = _nearest(mat, c.pivots)
            salt = ((row + np.arange(len(cell))) % c.salts[cell]).astype(np.int32)
            row += len(cell)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(salt)],
                                             names=[*batch.schema.names, "cell", "salt"])
            keep = needed[cell]
            yield out if keep.all() else out.filter(pa.array(keep))

    return corpus.mapInArrow(run, f"{id_schema}, cv array<float>, cell int, salt int")


def _topk_rows(qi: np.ndarray, ci: np.ndarray, dist: np.ndarray, k: np.ndarray):
    """Per query, its ``k[query]`` best candidates under the global order
    ``(round(dist, RANK_DECIMALS), id)``; ``ci`` holds corpus ids, one row each
    with as many columns as an id has parts."""
    order = np.lexsort((*ci.T[::-1], np.round(dist, RANK_DECIMALS), qi))
    qs = qi[order]
    first = np.searchsorted(qs, qs, side="left")
    keep = order[(np.arange(len(qs)) - first) < k[qs]]
    return qi[keep], ci[keep], dist[keep]


def _group_topk(ids: np.ndarray, mat: np.ndarray, q_mat: np.ndarray, k: np.ndarray, reach: np.ndarray):
    """(query index, ids, squared distance) of each query's ``k`` best in a group:
    candidates from the BLAS identity ``|q|^2 + |c|^2 - 2 q.c`` widened by a bound
    on its rounding error (so no true neighbour is missed), exact squared
    distances for the candidates only, slice by slice, so that ties never pile up."""
    slack = 10.0 ** (-RANK_DECIMALS + 1)
    c_norm = np.einsum("cd,cd->c", mat, mat)
    for lo in range(0, len(q_mat), QUERY_SLICE):
        part = q_mat[lo:lo + QUERY_SLICE]
        kk = np.minimum(k[lo:lo + QUERY_SLICE], len(mat))
        q_norm = np.einsum("qd,qd->q", part, part)
        approx = q_norm[:, None] + c_norm[None] - 2.0 * (part @ mat.T)
        kth = np.take_along_axis(np.partition(approx, np.unique(kk - 1), axis=1), (kk - 1)[:, None], axis=1)[:, 0]
        err = 1e-9 * (1.0 + q_norm + c_norm.max())
        limit = np.minimum(kth + 2 * err + slack, reach[lo:lo + QUERY_SLICE] * (1 + 1e-9) + err + slack)
        qi, cj = np.nonzero(approx <= limit[:, None])
        best = np.empty(0, np.int64), np.empty((0, ids.shape[1]), np.int64), np.empty(0)
        for at in range(0, len(qi), CANDIDATE_SLICE):
            qs, cs = qi[at:at + CANDIDATE_SLICE], cj[at:at + CANDIDATE_SLICE]
            diff = part[qs] - mat[cs]
            found = qs, ids[cs], np.einsum("pd,pd->p", diff, diff)
            best = _topk_rows(*(np.concatenate(x) for x in zip(best, found)), kk)
        yield best[0] + lo, best[1], best[2]


def knn_topk(corpus: DataFrame, queries: DataFrame, k: int = 3, *,
             corpus_id: str | tuple = "vec_id", corpus_vec: str = "embedding",
             query_id: str = "qid", query_vec: str = "embedding", k_col: str | None = None,
             cells: int = CELLS, corpus_rows: int = CORPUS_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Exact top-k by squared L2: ``(qid, rank, vec_id, dist)``, rank 1-based.
    An id of several integer columns (a tuple, as ``("doc_id", "chunk_no")``)
    comes back in columns of these names instead of ``vec_id``.

    Returns ``min(k, N)`` rows per query; ``k_col`` names a column of the queries with
    each query's own number (null: ``k``; 0 or less: no rows).  Ties go to the smaller
    corpus id.  A query meets the vectors of its own dimension.  Null vectors and
    vectors with a null or non-finite element take no part on either side (a query of
    that kind has no rows); they never affect other rows (see
    :func:`quire.operators.corpus.index_stats`).  Each row of ``queries`` is ranked by
    itself, also when ids repeat.  ``corpus`` is read three times: pass a stored table
    or a scan.
    """
    spark: SparkSession = corpus.sparkSession
    id_cols = ("vec_id",) if isinstance(corpus_id, str) else tuple(corpus_id)
    id_schema = ", ".join(f"{c} long" for c in id_cols)
    given = (corpus_id,) if isinstance(corpus_id, str) else corpus_id
    wanted = F.lit(int(k)) if k_col is None else F.coalesce(F.col(k_col).cast("int"), F.lit(int(k)))
    q = queries.select(F.col(query_id).cast("long").alias("qid"), wanted.alias("top_k"),
                       F.col(query_vec).cast("array<float>").alias("qv")).where("top_k > 0 and qv is not null")
    # the dimension check runs inside the kernels: a Spark filter on the vector
    # column would be pushed below a lazily computed embedding and evaluate it twice
    c = corpus.select(*[F.col(g).cast("long").alias(i) for g, i in zip(given, id_cols)],
                      F.col(corpus_vec).cast("array<float>").alias("cv"))
    parts = []
    for r in q.groupBy(F.size("qv").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("top_k").alias("k")) \
            .where("dim > 0").collect():  # one search per dimension of the queries
        found = _search(c, q, r["dim"], r["n"], r["k"], id_cols, cells, corpus_rows, query_rows)
        if found is not None:
            parts.append(found)
    if not parts:
        return spark.createDataFrame([], f"qid long, rank int, {id_schema}, dist double")
    return reduce(DataFrame.unionByName, parts)


def _search(corpus: DataFrame, queries: DataFrame, dim: int, n_queries: int, k_max: int, id_cols: tuple, cells: int,
            corpus_rows: int, query_rows: int) -> DataFrame | None:
    from quire.session import materialize as written
    id_schema = ", ".join(f"{c} long" for c in id_cols)
    made = _cells_of(corpus, dim, cells, corpus_rows)
    if made is None:
        return None
    asked = written(_asked(queries, dim, made), "knn-queries")
    needed = np.zeros(len(made.pivots), bool)
    needed[[r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]] = True  # cells at most
    parts = max(1, -(-n_queries // query_rows))

    right = asked.select("qrow", "qid", "top_k", "qv", "reach", F.explode(F.arrays_zip("cells", "salts")).alias("c"),
                         F.pmod(F.xxhash64("qrow"), F.lit(parts)).cast("int").alias("part")) \
        .select("qrow", "qid", "top_k", "qv", "reach", F.col("c.cells").alias("cell"), "part",
                F.explode(F.sequence(F.lit(0), F.col("c.salts") - 1)).alias("salt"))
    left = _dealt(corpus, dim, made, needed, id_schema) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    schema = pa.schema([("qrow", pa.int64()), ("qid", pa.int64()), ("top_k", pa.int32()),
                        *[(c, pa.int64()) for c in id_cols], ("dist", pa.float64())])

    def match(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asking.num_rows:
            return schema.empty_table()
        ids = np.stack([vectors.column(c).to_numpy() for c in id_cols], axis=1)
        mats = [t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                for t, c in ((vectors, "cv"), (asking, "qv"))]
        qi, ci, dist = (np.concatenate(x) for x in zip(*_group_topk(
            ids, *mats, asking.column("top_k").to_numpy(), asking.column("reach").to_numpy())))
        mine = asking.select(["qrow", "qid", "top_k"]).take(pa.array(qi))
        return pa.Table.from_arrays([*mine.columns, *[pa.array(x) for x in ci.T], pa.array(dist)], schema=schema)

    keys = ("cell", "salt", "part")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        match, f"qrow long, qid long, top_k int, {id_schema}, dist double")
    w = Window.partitionBy("qrow").orderBy(F.round("dist", RANK_DECIMALS), *id_cols)
    return near.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k_max) & (F.col("rank") <= F.col("top_k"))) \
        .select("qid", "rank", *id_cols, "dist")


def materialize(top: DataFrame) -> DataFrame:
    """Cut the lineage of a top-k result with a table in the session's checkpoint
    folder, so several consumers (hit lookup, context join) do not re-run the
    corpus scan and a lost executor does not either.  The result is bounded by
    ``queries x k`` rows."""
    from quire.session import materialize as _materialize
    return _materialize(top)


def attach_text(topk: DataFrame, corpus: DataFrame, *, corpus_id: str | tuple = "vec_id",
                text_col: str = "text") -> DataFrame:
    """Look the winning ids up in the corpus after ranking, so texts never
    travel through the distance scan.  One equi-join on the id; Spark broadcasts
    the top-k side by its size (it is bounded by queries x k)."""
    ids = (corpus_id,) if isinstance(corpus_id, str) else tuple(corpus_id)
    own = ("vec_id",) if isinstance(corpus_id, str) else ids
    texts = corpus.select(*[F.col(g).cast("long").alias(i) for g, i in zip(ids, own)], F.col(text_col).alias("text"))
    return texts.join(topk, list(own))


def assemble_context(hits: DataFrame, sep: str = "\n") -> DataFrame:
    """H2: per query, the hit texts in rank order joined by ``sep``.
    Each group holds at most k rows, so the collect is bounded."""
    return (hits.groupBy("qid")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_h"))
            .select("qid",
                    F.array_join(F.transform("_h", lambda h: h["text"]), sep).alias("context"),
                    F.size("_h").alias("n_hits")))

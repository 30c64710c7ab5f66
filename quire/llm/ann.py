"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector x is turned by a random rotation (seeded by its dimension); its
code is the signs of the coordinates, packed into bits, and its correction is
f = <x, s> with s the code's unit vector (signs / sqrt(d)).  For a turned unit
query q, <s, q> / f estimates <x, q>; the error is below
``sigmas`` * sqrt((1 - f^2) / f^2 / (d - 1)) but for a small probability.  A
vector is compared exactly (cosine of the original vectors, double precision)
when its estimate plus bound reaches the query's k-th best so far, or the k-th
largest estimate less bound of the batch.

The index (id, code, correction, vector) of every usable vector is written once.
Queries and vectors meet in cells: blocks of ``q_block`` queries are held, the
vectors of a part stream past them, and only a cell's k best per query come
out.  Neither side is collected or broadcast, and a task's memory is bounded.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; vectors are compared with
those of their own dimension; rows that repeat id and vector count once, rows
that share the query's id are its own; ties go to the smaller id; with fewer
candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lean, require
from quire.session import materialize


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed + d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and corrections of the rows of ``v`` (any length)."""
    u = v / np.abs(v).max(axis=1, keepdims=True)
    u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
    x = u @ turn.T
    return np.packbits(x > 0, axis=1), np.abs(x).sum(1) / np.sqrt(x.shape[1])


def usable(c) -> F.Column:
    return c.isNotNull() & (F.size(c) > 0) & F.forall(
        c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(c, lambda e: e != 0)


def index(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, d, code, f, v (doubles) of every usable row."""
    require(df, vec_id, embedding)
    x = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    x = x.where(F.col("id").isNotNull() & usable(F.col("e"))).dropDuplicates(["id", "e"])

    def run(batches):
        turned = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lists = batch.column(1)
                sizes = lists.value_lengths().to_numpy()
                flat = lists.flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for d in np.unique(sizes):
                    rows = np.nonzero(sizes == d)[0]
                    v = flat[starts[rows][:, None] + np.arange(d)]
                    if d not in turned:
                        turned[d] = rotation(int(d))
                    code, f = encode(v, turned[d])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d), pa.int32()),
                         pa.array([c.tobytes() for c in code], pa.binary()), pa.array(f),
                         pa.array([c.tobytes() for c in v], pa.binary())], names=["id", "d", "code", "f", "v"])

    return x.mapInArrow(lean(run), "id long, d int, code binary, f double, v binary")


class _Best:
    """The k best candidates of each of n queries, by score, then id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, sigmas: float):
        self.ids, self.k, self.sigmas = ids, k, sigmas
        self.unit = v / np.abs(v).max(axis=1, keepdims=True)
        self.unit = np.ascontiguousarray(self.unit)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.unit, self.unit))
        self.turn = rotation(v.shape[1])
        self.turned = (self.unit / self.norm[:, None]) @ self.turn.T
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids, code, f, v):
        d, k = v.shape[1], self.k
        signs = np.unpackbits(code, axis=1, count=d).astype(np.float64) * 2 - 1
        estimate = (self.turned @ signs.T) / np.sqrt(d) / f
        bound = self.sigmas * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(1, d - 1))
        other = self.ids[:, None] != ids
        low = np.where(other, estimate - bound, -np.inf)
        need = self.score[:, -1]
        if low.shape[1] >= k:
            need = np.maximum(need, np.partition(low, -k, axis=1)[:, -k])
        q, c = np.nonzero(other & (estimate + bound >= need[:, None]))
        if not len(q):
            return
        u = v / np.abs(v).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", u, u))
        exact = np.empty(len(q))
        for at in range(0, len(q), 1 << 15):
            a, b = q[at:at + (1 << 15)], c[at:at + (1 << 15)]
            exact[at:at + (1 << 15)] = np.einsum("ij,ij->i", self.unit[a], u[b]) / (self.norm[a] * norm[b])
        keep = exact >= self.score[q, -1]
        q, c, exact = q[keep], c[keep], exact[keep]
        # merge with what was best before, and cut each query's list at k
        rows = np.concatenate([np.repeat(np.arange(len(self.ids)), k), q])
        score = np.concatenate([self.score.ravel(), exact])
        who = np.concatenate([self.found.ravel(), ids[c]])
        order = np.lexsort((who, -score, rows))
        rows, score, who = rows[order], score[order], who[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < k
        self.score, self.found = score[top].reshape(-1, k), who[top].reshape(-1, k)

    def out(self) -> pa.RecordBatch:
        real = self.score > -np.inf
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, self.k)[real.ravel()]), pa.array(self.found[real]), pa.array(self.score[real])],
            names=["query_id", "vec_id", "score"])


def search(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, query=None, k: int = 5,
           sigmas: float = 3.0, q_block: int = 1024, v_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each indexed row for
    which ``query`` (a condition on the column ``id``) holds."""
    idx = materialize(index(df, vec_id, embedding), "codes")
    chosen = idx.where(query if query is not None else F.lit(True))
    n, m = idx.count(), chosen.count()
    parts, blocks = max(1, -(-n // v_block)), max(1, -(-m // q_block))

    def dealt(x, own, own_n, other, other_n, side):
        return x.select("d", F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int").alias(own),
                        F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other), F.lit(side).alias("side"),
                        "id", "code", "f", "v").select("d", "part", "block", "side", "id", "code", "f", "v")

    cells = dealt(chosen, "block", blocks, "part", parts, 0).union(dealt(idx, "part", parts, "block", blocks, 1))
    cells = cells.repartition(max(parts * blocks, 1), "d", "part", "block") \
        .sortWithinPartitions("d", "part", "block", "side")

    def run(batches):
        cell, held, best = None, [], None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                if not batch.num_rows:
                    continue
                d, part, block, side, ids, f = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 6))
                turn = np.nonzero((d[1:] != d[:-1]) | (part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1]))[0] + 1
                for s, e in zip([0, *turn], [*turn, batch.num_rows]):
                    if (d[s], part[s], block[s]) != cell:
                        if best is not None:
                            yield best.out()
                        cell, held, best = (d[s], part[s], block[s]), [], None
                    v = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(7)[s:e]), np.float64).reshape(e - s, d[s])
                    if side[s] == 0:
                        held.append((ids[s:e], v))
                        continue
                    if not held:
                        continue
                    if best is None:
                        best = _Best(*(np.concatenate(x) for x in zip(*held)), k, sigmas)
                    code = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(5)[s:e]), np.uint8).reshape(e - s, -1)
                    best.see(ids[s:e], code, f[s:e], v)
        if best is not None:
            yield best.out()

    near = cells.mapInArrow(lean(run), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

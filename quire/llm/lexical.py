"""Ranked lexical search, term at a time with limited accumulators.

Terms are maximal runs of ASCII letters and digits and of characters beyond
ASCII, A-Z lower-cased.  A document's score for a query sums, over the query's
terms (repeats included), w * ((10^9 tf) div (1000 tf + 12 m)), with
w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 75 + (25 n N) div L, all but w in
64-bit integers.

1. The documents are read once.  What is kept of one is its length n and, for
   terms that some query may hold, hash and frequency; a table of SLOTS flags,
   the only thing broadcast there, tells which (a false hit costs a posting).
   N, L and the terms' df are sums over what was kept.
2. Documents meet the queries in slabs.  In a slab a query's terms are taken
   rarest first.  Each adds its contributions to the documents' accumulators, and
   new accumulators are made until the greatest sum that the remaining terms
   could still give (from each term's greatest contribution in the slab) is under
   the k-th best partial score, or under the k-th best score of the task's earlier
   slabs: a document not yet met cannot reach the result any more.  From there on
   only the documents that have an accumulator are updated, to their exact scores.
3. A task gives at most k documents a query; Spark ranks these.

Queries go in blocks of at most TERMS term rows, one pass over the kept postings
each (not over the texts); what a pass broadcasts is bounded by that.  Each pass is
written before the next one.

Defined cases: a null or term-free text matches nothing and does not count in N; a
query without terms has no rows; each row of the queries is a query of its own,
and each row of the documents a document, so repeated rows give repeated results,
equal in score; equal scores go by id, a null id last; a text is read whole; empty
tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lean, require
from quire.session import materialize, scratch_path

#: Flags that tell which terms to keep, term rows of a block, rows of a slab.
SLOTS, TERMS, SLAB = 1 << 20, 1 << 18, 8192

#: Every byte that separates terms as a space, A-Z as a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> Counter:
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split())


def _hashes(terms) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms)).view(np.int64)


def _asked(queries: DataFrame) -> DataFrame:
    """(q, h, times) of queries (q, t)."""
    def run(batches):
        for batch in batches:
            q, h, times = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = terms_of(t)
                q += [i] * len(c)
                h += _hashes(c).tolist()
                times += c.values()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(h, pa.int64()), pa.array(times, pa.int64())],
                                             names=["q", "h", "times"])

    return queries.select("q", "t").mapInArrow(lean(run), "q long, h long, times long")


def _kept(docs: DataFrame, flags) -> DataFrame:
    """(id, n, hs, tfs) of every document (id, t) with a term."""
    def run(batches):
        wanted = flags.value
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            rows, n, size, hs, tfs = [], [], [0], [], []
            for i, t in enumerate(batch.column(1)):
                c = terms_of(t.as_py())
                if not c:
                    continue
                h, tf = _hashes(c), np.fromiter(c.values(), np.int64, len(c))
                some = wanted[h & (SLOTS - 1)]
                rows.append(i)
                n.append(int(tf.sum()))
                hs.append(h[some])
                tfs.append(tf[some])
                size.append(size[-1] + len(hs[-1]))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (hs, tfs)]
            off = pa.array(size, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()),
                 *[pa.ListArray.from_arrays(off, f) for f in flat]], names=["id", "n", "hs", "tfs"])

    return docs.mapInArrow(lean(run), "id long, n long, hs array<long>, tfs array<long>")


class Slab:
    """Postings of some documents, by term: documents ascending, impacts."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, hs: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int):
        of = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        m = 75 + (25 * n * n_docs) // n_terms
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[of])
        order = np.argsort(hs, kind="stable")
        self.size, self.h, self.doc, self.impact = len(n), hs[order], of[order], impact[order]

    def find(self, terms: np.ndarray):
        """First and last posting of each of the sorted ``terms``, and its greatest impact."""
        lo, hi = np.searchsorted(self.h, terms, "left"), np.searchsorted(self.h, terms, "right")
        top = np.zeros(len(terms), np.int64)
        some = np.flatnonzero(hi > lo)
        if len(some):
            cuts = np.stack([lo[some], hi[some]], 1).ravel()
            top[some] = np.maximum.reduceat(np.append(self.impact, 0), cuts)[::2]
        return lo, hi, top


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th best, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def term_at_a_time(slab: Slab, lo, hi, weight, bound, k: int, floor: int, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the slab and exact scores: all that can be among the k best
    with a score of ``floor`` or more.  The terms come rarest first: postings
    ``lo:hi``, weight, greatest contribution.  ``acc`` is all zero, and is left so."""
    rest = np.cumsum(bound[::-1])[::-1]
    total = int(rest[0])
    met = None  # documents with an accumulator, once no new ones are made
    for at in range(len(lo)):
        remaining = int(rest[at])
        if met is None and at:
            # a partial score is at most the bounds of the terms taken
            if remaining < floor or (total - remaining > remaining and remaining < kth(acc[acc > 0], k)):
                met = np.flatnonzero(acc)
        elif met is None and remaining < floor:
            break
        docs, gain = slab.doc[lo[at]:hi[at]], slab.impact[lo[at]:hi[at]]
        if met is None:
            acc[docs] += weight[at] * gain
        else:
            place = np.minimum(np.searchsorted(docs, met), len(docs) - 1)
            here = docs[place] == met
            acc[met[here]] += weight[at] * gain[place[here]]
    if met is None:
        met = np.flatnonzero(acc)
    scores = acc[met]
    acc[met] = 0
    keep = scores >= max(floor, kth(scores, k), 1)
    return met[keep], scores[keep]


def _pass(kept: DataFrame, block, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """Candidates (q, id, score) of a block of queries, at most k a query and task."""
    def run(batches):
        q_of, starts, term_of, weight, terms = block.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(q_of)
        floor = np.zeros(len(q_of), np.int64)
        acc = np.zeros(0, np.int64)
        for batch in (whole.slice(at, SLAB) for whole in batches for at in range(0, whole.num_rows, SLAB)):
            if not batch.num_rows:
                continue
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            slab = Slab(batch.column(1).to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(),
                        batch.column(3).flatten().to_numpy(), n_docs, n_terms)
            if len(acc) < slab.size:
                acc = np.zeros(slab.size, np.int64)
            lo, hi, top = slab.find(terms)
            for i in range(len(q_of)):
                mine = slice(starts[i], starts[i + 1])
                t, w = term_of[mine], weight[mine]
                bound = w * top[t]
                some = bound > 0
                if not some.any():
                    continue
                t, w = t[some], w[some]
                docs, scores = term_at_a_time(slab, lo[t], hi[t], w, bound[some], k, int(floor[i]), acc)
                if not len(docs):
                    continue
                s, z, d = (np.concatenate(c) for c in zip(best[i], (scores, nulls[docs], ids[docs])))
                first = np.lexsort((d, z, -s))[:k]
                best[i] = s[first], z[first], d[first]
                if len(first) == k:
                    floor[i] = s[first[-1]]
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            s, z, d = (np.concatenate(c) for c in zip(*best))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_of, sizes), pa.int64()), pa.array(d, pa.int64(), mask=z),
                                              pa.array(s, pa.int64())], names=["q", "id", "score"])

    return kept.mapInArrow(lean(run), "q long, id long, score long")


def search(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = 20, block_terms: int = TERMS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long)."""
    require(docs, doc_id, text)
    require(queries, item_id, item_text)
    spark = docs.sparkSession
    sc = spark.sparkContext
    items = materialize(queries.select(F.monotonically_increasing_id().alias("q"), F.col(item_id).alias("item"),
                                       F.col(item_text).cast("string").alias("t")), "items")
    asked = materialize(_asked(items), "asked")
    wanted = np.zeros(SLOTS, bool)
    slots = asked.select(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("s")).distinct().toArrow()  # SLOTS rows at most
    wanted[slots.column("s").to_numpy()] = True
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    kept = materialize(_kept(slim, sc.broadcast(wanted)), "postings")

    sums = kept.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    n_docs, n_terms = int(sums["d"]), int(sums["t"])
    df = kept.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    asked = materialize(asked.join(df, "h").select("q", "h", "df", (F.col("times") * weight).cast("long").alias("w")), "weighed")
    blocks = max(1, -(-asked.count() // block_terms))
    path = scratch_path(spark, f"lexical-{uuid.uuid4().hex}")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        q, h, d, w = (rows.column(c).to_numpy() for c in ("q", "h", "df", "w"))
        order = np.lexsort((h, d, q))  # rarest first in each query
        q, h, w = q[order], h[order], w[order]
        q_of, starts = np.unique(q, return_index=True)
        terms, term_of = np.unique(h, return_inverse=True)
        block = sc.broadcast((q_of, np.append(starts, len(q)), term_of, w, terms))
        _pass(kept, block, k, n_docs, n_terms).write.mode("append").parquet(path)
        block.unpersist()
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = spark.read.schema("q long, id long, score long").parquet(path) \
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(items.select("q", "item"), "q").select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")

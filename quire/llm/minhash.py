"""Near-duplicate removal by min-max hashing.

A text's set is its distinct k-word shingles, hashed to 64 bits.  Under each of
``perms`` permutations both the least and the greatest hash are kept, so half
as many evaluations give a signature of ``2 * perms`` values whose agreement
estimates the Jaccard similarity.  ``rows`` values make a band; at a
similarity of 0.8 the defaults (80 permutations, 32 bands of 5) miss a pair
with a probability of 3e-6.

1. Texts of equal sets are one class, known by its smallest id: the copies of a
   text never meet in pairs, and only classes go on.
2. In each bucket (band, values) the smallest member is compared with the
   others: a star, not all pairs.  Links are confirmed on the full sets.
3. One round of large-star and small-star gives each linked class a label; classes of
   one label are connected.  Then, in buckets that still hold several
   labels, members outside the bucket's largest label are compared
   with the members of the other labels, so that a link which does not go
   through a bucket's centre is found too; between classes of one label nothing is
   left to learn.  This goes block by block over sketches of 512 values, and only
   pairs that can reach the similarity (five standard deviations) come out, to
   be confirmed on the full sets.
4. Components of labels and new links by alternating large-star and small-star
   steps, until every component is a star; documents take them over from their class.

Tables between the steps are written to the shared folder, so that a lost
executor costs a task, and no list of a bucket, links or components reaches the
driver.

Defined cases: null or empty texts, and texts without words, have an empty set
and link with nothing; fewer than ``k`` words make one shingle of the whole
sequence; rows that share an id are one document (their sets all link through
it); rows with a null id take no part and are kept, each with a null component;
ties go to the smaller id.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import LOWER, lean, require
from quire.session import materialize

_M = np.uint64(0x9E3779B97F4A7C15)

#: Permutations of the longer signature, members of a bucket compared in one block.
SKETCH, BLOCK = 256, 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    acc = np.full(n, np.uint64(min(k, len(words))))
    for i in range(min(k, len(words))):
        acc = acc * _M + h[i:i + n]
    return np.unique(_mix(acc))


def permutations(perms: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, perms, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min and max under each permutation, interleaved; the set must not be empty."""
    low = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    high = np.zeros(len(a), np.uint64)
    for at in range(0, len(shingles), 2048):
        v = a[:, None] * shingles[None, at:at + 2048] + b[:, None]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig[: len(sig) // rows * rows].reshape(-1, rows)
    acc = np.arange(1, len(bands) + 1, dtype=np.uint64) * _M
    for i in range(rows):
        acc = _mix(acc * _M + bands[:, i])
    return acc.view(np.int64)


def _signed(df: DataFrame, k: int, perms: int, rows: int) -> DataFrame:
    """id, n (set size), dig (128-bit digest of the set, empty for an empty set), keys."""
    def run(batches):
        import hashlib
        a, b = permutations(perms)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            n, dig, keys = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), k)
                n.append(len(s))
                dig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"")
                keys.append(band_keys(signature(s, a, b), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(dig, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "dig", "keys"])

    return df.mapInArrow(lean(run), "id long, n long, dig binary, keys array<long>")


def _sets(df: DataFrame, k: int, perms: int, rows: int) -> DataFrame:
    """id, s (the set), sig: 8 bits of each value of a longer signature (2 * SKETCH
    values), on which a pair's similarity is estimated before its sets are compared;
    keys: the set's buckets, by which a pair is compared in its first one only."""
    def run(batches):
        a, b = permutations(SKETCH, seed=12)
        pa_, pb_ = permutations(perms)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            ids, sets, sig, keys = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(t.as_py(), k)
                if len(s):
                    ids.append(i)
                    sets.append(s.tobytes())
                    sig.append(_mix(signature(s, a, b)).astype(np.uint8).tobytes())
                    keys.append(band_keys(signature(s, pa_, pb_), rows).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.binary()) for c in (sets, sig, keys)]],
                                             names=["id", "s", "sig", "keys"])

    return df.mapInArrow(lean(run), "id long, s binary, sig binary, keys binary")


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |A and B| >= num * |A or B| on the full sets."""
    x = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    x = x.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return x.mapInArrow(lean(run), "a long, b long")


def _close_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of a bucket's members in different components, at least one
    outside the bucket's largest, whose sketches agree so far that a similarity
    under ``similarity`` is not five standard deviations away.

    A bucket is cut into blocks of BLOCK members; a task compares one block of
    minor members with one block of all members, so neither a hot bucket nor its
    pairs ever stand in one task or in rows.  A pair that shares several buckets
    comes out of the first of them: there, too, the two are in different
    components, hence one is minor."""
    values = 2 * SKETCH
    floor = similarity - 5 * (similarity * (1 - similarity) / values) ** 0.5
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["key", "id", "n", "root", "minor", "sig", "keys"]
    left = members.where("minor").select(*cols, block.alias("i"), others.alias("j"), F.lit(0).alias("side"))
    right = members.select(*cols, block.alias("j"), others.alias("i"), F.lit(1).alias("side"))
    x = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def run(batches):
        cell, held = None, None

        def matched(sub):
            nonlocal cell, held
            # one side of one cell
            key, side = sub[0], sub[1]
            ids, n, root, minor, sig, keys = sub[2]
            if key != cell:
                cell, held = key, []
            if side == 0:
                held.append((ids, n, root, sig, keys))
                return
            if not held:
                return
            if len(held) > 1:
                held[:] = [tuple(np.concatenate(c) for c in zip(*held))]
            hi, hn, hr, hs, hk = held[0]
            for at in range(0, len(ids), 64):
                cut = slice(at, at + 64)
                ok = hr[:, None] != root[None, cut]
                ok &= ~minor[None, cut] | (ids[None, cut] < hi[:, None])
                ok &= np.minimum(hn[:, None], n[None, cut]) >= similarity * np.maximum(hn[:, None], n[None, cut])
                p, q = np.nonzero(ok)
                for c in range(0, len(p), 1 << 14):
                    u, v = p[c:c + (1 << 14)], q[c:c + (1 << 14)] + at
                    agree = np.count_nonzero(hs[u] == sig[v], axis=1) / values
                    near = (agree * 256 - 1) / 255 >= floor
                    u, v = u[near], v[near]
                    first = np.argmax(hk[u] == keys[v], axis=1)
                    here = hk[u, first] == key[0]
                    u, v = u[here], v[here]
                    if len(u):
                        one, two = hi[u], ids[v]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            num = {c: cols[c].to_numpy(zero_copy_only=False) for c in ("key", "id", "n", "root", "minor", "i", "j", "side")}
            sig = np.frombuffer(b"".join(s.as_buffer() for s in cols["sig"]), np.uint8).reshape(batch.num_rows, values)
            keys = np.frombuffer(b"".join(s.as_buffer() for s in cols["keys"]), np.int64).reshape(batch.num_rows, -1)
            turn = np.zeros(batch.num_rows, bool)
            for c in ("key", "i", "j", "side"):
                turn[1:] |= num[c][1:] != num[c][:-1]
            cuts = [0, *np.nonzero(turn)[0].tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                part = tuple(num[c][s:e] for c in ("id", "n", "root", "minor")) + (sig[s:e], keys[s:e])
                yield from matched(((num["key"][s], num["i"][s], num["j"][s]), num["side"][s], part))

    return x.mapInArrow(lean(run), "a long, b long")


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """A node's neighbours hang on the least of them and itself: the larger
    neighbours in a large-star step, the smaller ones in a small-star step."""
    near = _both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    x = near.join(least, near["a"] == least["u"])
    hung = x.where(F.col("b") > F.col("a")) if large else x.where(F.col("b") != F.col("m"))
    out = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _round(e: DataFrame) -> DataFrame:
    return materialize(_star(_star(e, True), False), "edges")


def _all_stars(e: DataFrame) -> bool:
    """Whether every node of the edges (a, b) has one edge to a node that has none,
    so that ``b`` is the root of ``a``."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("in")) \
        .union(e.select("b", F.lit(0), F.lit(1)))
    open_ = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)")
    return not open_.limit(1).count()


def _labelled(e: DataFrame) -> DataFrame:
    """(id, root) of the nodes of edges (a, root)."""
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")) \
        .union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b): root is the smallest id
    reachable.  Alternating large-star and small-star until all are stars."""
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    if edges.limit(1).count():
        edges = _round(edges)
        while not _all_stars(edges):
            edges = _round(edges)
    return _labelled(edges)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = 5, similarity: float = 0.8,
           perms: int = 80, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    require(docs, doc_id, text)
    exact = Fraction(str(similarity))
    num, den = exact.numerator, exact.denominator
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    signed = materialize(_signed(slim, k, perms, rows), "minhash")
    full = signed.where("n > 0 and id is not null")
    # classes of equal sets, each under its smallest id
    lead = materialize(full.groupBy("dig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    # an id with several sets links their classes
    several = full.groupBy("id").agg(F.min("dig").alias("lo"), F.max("dig").alias("hi")).where("lo <> hi").select("id")
    own = full.join(several, "id", "left_semi").select("id", "dig").distinct()
    same = own.join(lead.select("dig", F.col("id").alias("a")), "dig").select("a", F.col("id").alias("b"))

    bands = lead.select("id", "n", F.explode("keys").alias("key"))
    heads = bands.groupBy("key").agg(F.min_by(F.struct("id", "n"), "id").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    live = materialize(bands.join(heads.select("key", "c"), "key"), "buckets")

    def alike(x, y):
        return (F.least(x, y) * den) >= (F.greatest(x, y) * num)

    star = live.where((F.col("id") != F.col("c.id")) & alike(F.col("n"), F.col("c.n"))) \
        .select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()
    star = materialize(star, "pairs")
    wanted = live.select("id").distinct()
    sets = materialize(_sets(slim.join(wanted, "id", "left_semi"), k, perms, rows), "sets")
    first = _round(materialize(_confirm(star, sets, num, den), "links"))

    # second step: across the labels that share a bucket
    now = live.join(_labelled(first), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    per = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("key")
    per = per.withColumn("place", F.row_number().over(w.orderBy(F.desc("m"), "root"))) \
        .withColumn("several", F.max("place").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > 1) \
        .withColumn("blocks", F.ceil(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / F.lit(BLOCK))) \
        .where("several").select("key", "root", F.col("place") > 1, F.col("blocks").cast("int"))
    per = per.toDF("key", "root", "minor", "blocks")
    open_ = now.join(per, ["key", "root"])
    rest = _close_pairs(open_.join(sets.select("id", "sig", "keys"), "id"), num / den)
    rest = materialize(rest.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    second = _confirm(rest, sets, num, den)
    roots = components(first.union(second).union(same))

    # a class's component, and its documents'
    found = lead.join(roots.withColumnRenamed("id", "r"), F.col("id") == F.col("r"), "left") \
        .select(F.col("dig").alias("d"), F.coalesce("root", "id").alias("root"))
    out = signed.select("id", "n", "dig").join(found, F.col("dig") == F.col("d"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose document is not its group's smallest."""
    gone = groups(docs, doc_id, text, **options).where(~F.col("kept")).select(F.col(doc_id).alias("_gone_id")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["_gone_id"], "left_anti")

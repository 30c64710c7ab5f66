"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines; a line further after a sentence's end
. ! ? and white space).  A paragraph's digest, with its number among the equal
paragraphs of the text, is added to ``HASHES`` cells of a sketch of m cells: each
cell keeps a count, the xor of digests and the xor of their checks.  Subtracting
two sketches cell by cell leaves the digests of the paragraphs that differ, and
peeling cells of count +1 or -1 whose check fits recovers them.  When peeling
gets stuck, both sketches are built anew with four times the cells, up to ``most`` cells;
beyond that the two lists are compared.

The likeness of two texts is |A and B| / |A or B| of their paragraphs, with the
size of the difference that peeling recovered; two texts without paragraphs are
alike (1).  The fingerprint string holds the number of paragraphs and the
sketch of ``CELLS`` cells, so equal texts have equal fingerprints.

Neighbours (each row with the next by descending key) come from range buckets
whose bounds are sampled keys; a bucket's rows are sorted and streamed, and the
first row of the bucket that follows is added to it, so one shuffle of the texts
is enough and no task sees more than its bucket.

Defined cases: a null text is empty; rows of a null key come last, then ties go
by text; a single row is its own next; an empty table gives an empty result;
repeated rows are neighbours of each other.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lean, require

CELLS, HASHES = 12, 3
#: Columns of the digests that peeling recovers: only in the text, only in the other.
RECOVERED = ("edited_gone", "edited_come", "next_gone", "next_come")
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")


def paragraphs(text: str) -> np.ndarray:
    """Distinct 64-bit digests: of each paragraph, joined with its number among
    the equal ones."""
    import xxhash
    seen, out = {}, []
    for p in _CUT.split(text):
        p = p.strip()
        if p:
            d = xxhash.xxh3_64_intdigest(p)
            k = seen.get(d, 0)
            seen[d] = k + 1
            out.append(d if not k else xxhash.xxh3_64_intdigest(d.to_bytes(8, "little") + k.to_bytes(8, "little")))
    return np.unique(np.array(out, np.uint64))


_SALTS = (np.arange(1, HASHES + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def _hashes(d: np.ndarray) -> np.ndarray:
    """(1 + HASHES, digests): the check, and a hash for each part of the cells."""
    x = d + _SALTS
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _cells(h: np.ndarray, m: int) -> np.ndarray:
    """A cell in each of HASHES equal parts of the m cells, part after part."""
    part = m // HASHES
    return ((h[1:] % np.uint64(part)).astype(np.int64) + part * np.arange(HASHES)[:, None]).ravel()


def sketch(d: np.ndarray, h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts, xor of digests, xor of checks."""
    at = _cells(h, m)
    keys, checks = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    np.bitwise_xor.at(keys, at, np.concatenate([d] * HASHES))
    np.bitwise_xor.at(checks, at, np.concatenate([h[0]] * HASHES))
    return np.bincount(at, minlength=m), keys, checks


def peel(a, b) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests only in a and only in b, or None when peeling gets stuck."""
    n, k, c = a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]
    m, mine, theirs = len(n), [], []
    while True:
        one = np.nonzero((n == 1) | (n == -1))[0]
        h = _hashes(k[one])
        fits = h[0] == c[one]
        one, h = one[fits], h[:, fits]
        if not len(one):
            break
        d, first = np.unique(k[one], return_index=True)
        h, sign = h[:, first], n[one[first]]
        mine.append(d[sign > 0])
        theirs.append(d[sign < 0])
        at = _cells(h, m)
        np.subtract.at(n, at, np.concatenate([sign] * HASHES))
        np.bitwise_xor.at(k, at, np.concatenate([d] * HASHES))
        np.bitwise_xor.at(c, at, np.concatenate([h[0]] * HASHES))
    if n.any() or k.any() or c.any():
        return None
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *mine]), np.concatenate([empty, *theirs])


def difference(a: "Print", b: "Print", most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in a, only in b: peeled, with four times the cells after each
    failure.  The first sketches are the fingerprints'."""
    m, x, y = CELLS, a.cells, b.cells
    while True:
        got = peel(x, y)
        if got is not None:
            return got
        # a sketch cannot peel far more than its cells; the counts tell the least difference
        m = max(4 * m, (abs(len(a.digests) - len(b.digests)) + HASHES) // HASHES * HASHES)
        if m > most:
            return np.setdiff1d(a.digests, b.digests, assume_unique=True), np.setdiff1d(b.digests, a.digests, assume_unique=True)
        x, y = sketch(a.digests, a.hashes, m), sketch(b.digests, b.hashes, m)


def fingerprint(d: np.ndarray, cells) -> str:
    body = cells[0].astype("<u4").tobytes() + cells[1].astype("<u8").tobytes() + cells[2].astype("<u4").tobytes()
    return f"{len(d)}:" + base64.b64encode(body).decode()


class Print:
    """A text's paragraph digests, its first sketch and the fingerprint string."""

    def __init__(self, text: str):
        self.digests = paragraphs(text)
        self.hashes = _hashes(self.digests)
        self.cells = sketch(self.digests, self.hashes, CELLS)
        self.text = fingerprint(self.digests, self.cells)

    def compared(self, other: "Print") -> tuple[float, np.ndarray, np.ndarray]:
        """The likeness, the digests only in this text and those only in the other."""
        gone, come = difference(self, other)
        a, b = len(self.digests), len(other.digests)
        both = a - len(gone)
        return both / (a + b - both) if a or b else 1.0, gone, come

    def likeness(self, other: "Print") -> float:
        return self.compared(other)[0]


def _lists(digests: list[np.ndarray]) -> pa.Array:
    """array<long>: the 64 bits of each digest, in order."""
    ends = np.cumsum([0] + [len(d) for d in digests])
    every = np.concatenate([np.zeros(0, np.uint64), *[np.sort(d) for d in digests]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every.view(np.int64)))


def edited_text(text: str, nxt: str) -> str:
    k = len(text) // 3
    return text[:len(text) - k] + nxt[:k]


def _neighbours(docs: DataFrame, key: str, text: str, buckets: int | None) -> DataFrame:
    """b, own, k, t: every row in its bucket (own), and the first row of the
    bucket that follows as a guest; sorted, a bucket per run of b."""
    x = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    buckets = buckets or 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [i / buckets for i in range(1, buckets)]
    cuts = sorted({int(c) for c in x.select("k").stat.approxQuantile("k", at, 0.2 / buckets)}) if at else []
    # bucket 0 has the largest keys; null keys stand in the last one
    above = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: F.col("k") < c)) if cuts else F.lit(0)
    x = x.withColumn("b", F.when(F.col("k").isNull(), F.lit(len(cuts) + 1)).otherwise(above).cast("int"))
    firsts = {r["b"]: r["k"] for r in x.groupBy("b").agg(F.max("k").alias("k")).collect()}  # a row per bucket
    order = sorted(firsts)
    own = x.select("b", F.lit(True).alias("own"), "k", "t")
    if not order:
        return own
    schema = "b int, first long, goes int"
    heads = docs.sparkSession.createDataFrame(
        [(b, firsts[b], order[i - 1]) for i, b in enumerate(order)], schema)  # the first bucket's goes to the last
    guests = x.join(F.broadcast(heads), (x["b"] == heads["b"]) & F.col("k").eqNullSafe(F.col("first")))
    guests = guests.groupBy("goes", "first").agg(F.min("t").alias("t"))
    guests = guests.select(F.col("goes").alias("b"), F.lit(False).alias("own"), F.col("first").alias("k"), "t")
    every = own.unionByName(guests).repartition(max(1, buckets // 2), "b")
    return every.sortWithinPartitions("b", F.desc("own"), F.desc_nulls_last("k"), "t")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and for both comparisons the recovered digests
    (``RECOVERED``, array<long>); one row per row of ``docs``."""
    require(docs, doc_id, text)

    def run(batches):
        held = None  # the row whose next one has not come yet: bucket, key, text, print
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part, out = whole.slice(at, 256), []
                for b, own, k, t in zip(*(part.column(i).to_pylist() for i in range(4))):
                    p = Print(t)
                    if held and held[0] == b:
                        e = edited_text(held[2], t)
                        q = Print(e)
                        near_q, *edited = held[3].compared(q)
                        near_p, *following = held[3].compared(p)
                        out.append((held[1], len(held[2]), hashlib.sha256(e.encode()).hexdigest(), held[3].text, q.text,
                                    near_q, near_p, *edited, *following))
                    held = (b, k, t, p) if own else None
                cols = list(zip(*out)) or [()] * (7 + len(RECOVERED))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, kind) for c, kind in zip(cols, kinds)], *[_lists(c) for c in cols[len(kinds):]]],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *RECOVERED])

    return _neighbours(docs, doc_id, text, buckets).mapInArrow(
        lean(run), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, " + ", ".join(f"{c} array<long>" for c in RECOVERED)).withColumnRenamed("id", doc_id)

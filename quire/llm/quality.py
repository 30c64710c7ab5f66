"""Quality scores from document statistics.

1. Each text gives the statistics named in STATISTICS (of characters, words, lines
   and their repetition), taken from the whole text.  They are standardised by
   mean and deviation over all documents and cut at +-5 deviations.
2. Random Fourier features: cos(W x + b) with normal W approximates a Gaussian
   kernel over the statistics; a constant stands beside them.
3. Ridge scores by normal equations: every partition sums Z'Z, Z'y, y'y of its
   labelled rows for each of FOLDS folds, the sums are added up in Spark (a block
   of rows of a fold's matrix at a time), and the driver solves systems of fixed
   size.  The ridge is the one of RIDGES with the least squared error of the folds
   left out, which these sums give without a further pass.
4. Isotonic calibration: labelled rows are scored by the solution without their
   fold; labels and rows are counted in BINS bins of that score, and pooling
   adjacent violators over the bins gives a rising step function, read with
   straight lines between the steps' centres.  SLOPE of the uncalibrated score is
   mixed in, which keeps the order inside a step.

Copies of a text are in one fold (by a hash of it).  All labelled rows given are
learned from; the model's size does not depend on the input's.

Defined cases: a null text is empty; empty texts have statistics (zeros) and a
score; several labels of one id count by their mean, null labels do not count, and
neither do rows with a null id; rows that share an id are scored each; without a
label every score is 0.5; with equal labels it is near that label; empty tables
give an empty result; very long texts are read whole; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lean, require
from quire.session import materialize

STATISTICS = ("chars", "words", "word_length", "word_spread", "longest", "upper", "digits", "blanks", "marks", "symbols",
              "beyond_ascii", "distinct_words", "top_word", "stutter", "distinct_triples", "lines", "distinct_lines",
              "line_length", "capitalised", "marked_ends", "letterless", "entropy")
FOLDS, BINS, SLOPE = 5, 4096, 1e-3
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
#: Rows of a fold's matrix that are added up together.
_ROWS = 32

_MARKS, _SYMBOLS, _ENDS = b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", tuple(".,;:!?")


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text, in the order of STATISTICS."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    n = len(text)
    low = text.lower()
    if len(low) == n:
        upper = int(np.count_nonzero(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
                                     != np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)))
    else:
        upper = sum(c.isupper() for c in text)
    share = seen[seen > 0] / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    words = text.split()
    out[0] = np.log1p(n)
    out[5:11] = (upper / n, seen[48:58].sum() / n, seen[[32, *range(9, 14)]].sum() / n, seen[list(_MARKS)].sum() / n,
                 seen[list(_SYMBOLS)].sum() / n, (n - seen[:128].sum()) / n)
    out[21] = float(-(share * np.log2(share)).sum())
    if lines:
        out[15:18] = len(lines) / n, len(set(lines)) / len(lines), np.log1p(n / len(lines))
    if words:
        m = len(words)
        sizes = np.fromiter(map(len, words), np.int64, m)
        counts = Counter(words)
        number = {w: i for i, w in enumerate(counts)}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, m)
        triples = ids[2:] + ids[1:-1] * 1_000_003 + ids[:-2] * 998_244_353
        out[1:5] = np.log1p(m), sizes.mean(), sizes.std(), np.log1p(sizes.max())
        out[11:15] = (len(counts) / m, max(counts.values()) / m, (ids[1:] == ids[:-1]).mean() if m > 1 else 0.0,
                      len(np.unique(triples)) / len(triples) if m > 2 else 1.0)
        out[18:21] = (sum(c * (w[0].isupper() and not w.isupper()) for w, c in counts.items()) / m,
                      sum(c * w.endswith(_ENDS) for w, c in counts.items()) / m,
                      sum(c * (not any(map(str.isalpha, w))) for w, c in counts.items()) / m)
    return out


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learn: Column | None = None) -> DataFrame:
    """id, learn (may be learned from), fold, x (the statistics); written."""
    require(docs, doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()
    t = F.col(text).cast("string")
    slim = docs.select(F.col(doc_id).alias("id"), (F.lit(True) if learn is None else learn).alias("learn"),
                       F.pmod(F.xxhash64(F.coalesce(t, F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold"), t.alias("t"))

    def run(batches):
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            x = np.array([statistics(t.as_py()) for t in batch.column(3)]).reshape(-1, len(STATISTICS))
            off = pa.array(np.arange(0, x.size + 1, len(STATISTICS)), pa.int32())
            yield pa.RecordBatch.from_arrays(batch.columns[:3] + [pa.ListArray.from_arrays(off, pa.array(x.ravel()))],
                                             names=["id", "learn", "fold", "x"])

    return materialize(slim.mapInArrow(lean(run), f"id {kind}, learn boolean, fold int, x array<double>"), "statistics")


class Model(NamedTuple):
    """How to score: standardisation, random features, weights (one row for the
    whole, then one without each fold), and the calibration's corners."""
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5) @ self.frequency + self.phase
        return np.hstack([np.ones((len(z), 1)), np.cos(z) * np.sqrt(2 / len(self.phase))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(raw), 0.5)
        return (1 - SLOPE) * np.interp(raw, self.at, self.level) + SLOPE * np.clip(raw, 0, 1)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _equations(rows: DataFrame, model: Model) -> np.ndarray:
    """For each fold the summed outer products of (features, label), of fixed size:
    FOLDS x (d + 1) x (d + 1) for d features with the constant."""
    d = len(model.phase) + 2  # constant, features, label
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def add(batches):
        m = shared.value
        sums = np.zeros((FOLDS, d, d))
        for batch in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            z = np.hstack([m.expand(_matrix(batch.column(1), len(m.mean))), batch.column(2).to_numpy()[:, None]])
            fold = batch.column(0).to_numpy()
            for f in np.unique(fold):
                part = z[fold == f]
                sums[f] += part.T @ part
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        for f in range(FOLDS):
            if sums[f].any():
                for at in range(0, d, _ROWS):
                    yield block(f, at, task, sums[f, at:at + _ROWS])

    def block(f, at, task, part):
        return pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([at], pa.int32()), pa.array([task], pa.int32()),
                                           pa.array([part.tobytes()], pa.binary())], names=["f", "at", "task", "part"])

    def total(batches):
        now, held = None, None
        for batch in batches:
            for f, at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (f, at) != now:
                    if now:
                        yield block(*now, 0, held)
                    now, held = (f, at), 0.0
                held = held + np.frombuffer(part.as_buffer())
        if now:
            yield block(*now, 0, held)

    kinds = "f int, at int, task int, part binary"
    pieces = rows.select("fold", "x", "y").mapInArrow(lean(add), kinds) \
        .repartition("f", "at").sortWithinPartitions("f", "at", "task").mapInArrow(lean(total), kinds)
    sums = np.zeros((FOLDS, d, d))
    for r in pieces.toLocalIterator():  # FOLDS * d / _ROWS rows
        part = np.frombuffer(r["part"]).reshape(-1, d)
        sums[r["f"], r["at"]:r["at"] + len(part)] = part
    return sums


def solve(sums: np.ndarray) -> np.ndarray:
    """Weights over all folds, then without each, at the best ridge."""
    whole = sums.sum(0)
    d = len(whole) - 1
    # the constant is not held down
    hold = np.eye(d)
    hold[0, 0] = 1e-9

    def weights(s, ridge):
        return np.linalg.solve(s[:d, :d] + hold * max(1.0, s[0, 0]) * ridge, s[:d, d])

    best = None
    for ridge in RIDGES:
        without = [weights(whole - s, ridge) for s in sums]
        error = sum(s[d, d] - 2 * w @ s[:d, d] + w @ s[:d, :d] @ w for w, s in zip(without, sums))
        if best is None or error < best[0]:
            best = error, ridge, without
    return np.array([weights(whole, best[1]), *best[2]])


def pooled(n: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order (rows, labels, scores summed):
    centres and means of the rising steps."""
    steps: list[list[float]] = []
    for bin_ in zip(n.tolist(), y.tolist(), x.tolist()):
        steps.append(list(bin_))
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    return np.array([s[2] / s[0] for s in steps]), np.array([s[1] / s[0] for s in steps])


def train(feats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", size: int = 256,
          seed: int = 13) -> Model:
    """Learns from the rows of ``features`` with ``learn`` that have a label (0 to 1)."""
    require(labels, doc_id, label)
    spark = feats.sparkSession
    width = len(STATISTICS)
    moments = feats.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Model(np.array([moments[f"m{i}"] or 0.0 for i in range(width)]),
                  np.array([max(moments[f"s{i}"] or 0.0, 1e-6) for i in range(width)]),
                  rng.normal(0, 1 / np.sqrt(width), (width, size)), rng.uniform(0, 2 * np.pi, size),
                  np.zeros((FOLDS + 1, size + 1)), np.zeros(0), np.zeros(0))
    y = labels.groupBy(F.col(doc_id).alias("label_id")).agg(F.avg(F.col(label).cast("double")).alias("y")).where("y is not null")
    rows = materialize(feats.where("learn").join(y, F.col("id") == F.col("label_id")).select("fold", "x", "y"), "labelled")
    sums = _equations(rows, model)
    if not sums.any():
        return model
    model = model._replace(weights=solve(sums))
    shared = spark.sparkContext.broadcast(model)

    def left_out(batches):
        m = shared.value
        for batch in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            z, fold = m.expand(_matrix(batch.column(1), len(m.mean))), batch.column(0).to_numpy()
            raw = np.einsum("rd,rd->r", z, m.weights[1 + fold])
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(2)], names=["raw", "y"])

    bin_ = F.floor((F.greatest(F.least("raw", F.lit(1.5)), F.lit(-0.5)) + 0.5) * (BINS / 2))
    counted = rows.mapInArrow(lean(left_out), "raw double, y double").groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("raw").alias("x")).orderBy("bin").toArrow()  # BINS + 1 rows
    at, level = pooled(*(counted.column(c).to_numpy() for c in ("n", "y", "x")))
    return model._replace(at=at, level=level)


def score(feats: DataFrame, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """id as ``doc_id``, learn, score."""
    kind = feats.schema["id"].dataType.simpleString()
    shared = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            raw = m.expand(_matrix(batch.column(2), len(m.mean))) @ m.weights[0]
            yield pa.RecordBatch.from_arrays(batch.columns[:2] + [pa.array(m.calibrated(raw))], names=["id", "learn", "score"])

    return feats.select("id", "learn", "x").mapInArrow(lean(run), f"id {kind}, learn boolean, score double") \
        .withColumnRenamed("id", doc_id)

"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue: its documents' tokens one after the other, in the order
of (scan task, row).  Queues are served in quanta of ``quantum`` tokens, and a
window of ``length`` tokens takes ``length / quantum`` of them.  Queue s of weight w_s
(``weights`` of the sources; without them its number of quanta, so that all queues
last to the end) gains w_s / W of credit per quantum served (W: the weights of the
queues that still have quanta), so every window has the target proportions, less a
deficit of under a quantum per queue which is carried to the next window; when a
queue has run dry the others go on in their proportions.  The turn of a queue's r-th
quantum is then known without a running state: it is the number of quanta that are
due earlier, those r' of queue s' with (2 r' + 1) / w_s' < (2 r + 1) / w_s (a tie goes
to the smaller queue).  So any task computes the windows of its own documents, and
the deficits carry across windows, tasks and executors.

What is left of the queues when only whole windows are taken (under ``length``
tokens and a quantum per queue) forms the last windows; the final one, if not
full, is cut into powers of two, which need no padding.  Nothing is padded.

1. Tokenise: one pass over the texts writes ids (16 bits each if the vocabulary
   allows) with each document's place in its (task, source) part.
2. Sums per (task, source) give each part's start in its queue: slim rows.
3. Each document's pieces follow from its place in the queue and the queues'
   sizes; the ids are read once more, not shuffled.

Defined cases: a null text is empty and still yields its end id; the null source
is a queue of its own; a null id stays null; repeated rows are packed each; an
empty table gives no piece; more than ``max_queues`` sources share queues by
size, the largest ones keeping their own (the turn of a quantum costs a step per
queue), and no token is lost by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lean, require
from quire.session import materialize

END_TEXT, END_ID = "<|endoftext|>", 50256


def byte_encoder(ranks_path: str, pattern: str, special: str = END_TEXT, special_id: int = END_ID):
    """text -> ids of a byte-level BPE.  ``special`` inside a text is its id, as
    the tokenizer's added token; everything else by merge ranks."""
    import base64

    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list:
        if special not in text:
            return enc.encode_ordinary(text)
        ids = []
        for i, part in enumerate(text.split(special)):
            ids += [special_id] * (i > 0) + enc.encode_ordinary(part)
        return ids

    return encode


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, doc_id: str, text: str, source: str) -> DataFrame:
    """id, source, part (scan task), at (tokens before it in its part), n, ids."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"), F.col(source).cast("string").alias("source"))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encode, seen = byte_encoder(ranks_path, pattern), {}
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                at, n, ids = [], [], []
                for t, s in zip(batch.column(1), batch.column(2).to_pylist()):
                    x = np.array(encode(t.as_py() or "") + [end_id], np.uint32)
                    at.append(seen.get(s, 0))
                    n.append(len(x))
                    seen[s] = at[-1] + len(x)
                    ids.append(x.astype("<u2").tobytes() if end_id < 1 << 16 and x.max() < 1 << 16 else x.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["id", "source", "part", "at", "n", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return slim.mapInArrow(lean(run), f"id {kind}, source string, part int, at long, n long, ids binary")


def turns(r: np.ndarray, queue: int, sizes: list[int], weights: list[int] | None = None) -> np.ndarray:
    """Global turn of the r-th quantum of ``queue``; exact integers of any size."""
    weights = sizes if weights is None else weights
    w = weights[queue]
    big = 2 * (2 * sizes[queue] + 1) * max(weights) + 4 * w >= 1 << 62
    due = 2 * (r.astype(object) if big else r) + 1
    total = due * 0
    for other, (n, v) in enumerate(zip(sizes, weights)):
        if n and other < queue:  # a tie is served before
            total = total + np.minimum((due * v + w) // (2 * w), n)
        elif n and other > queue:
            total = total + np.minimum((due * v + w - 1) // (2 * w), n)
    return (total + r).astype(np.int64)


def pieces_of(first: int, n: int, queue: int, quanta: list[int], tails: list[int], quantum: int, length: int,
              weights: list[int] | None = None):
    """(start, length, sequence, offset) arrays of a document that stands at
    ``first`` in its queue.  ``quanta``: whole quanta of each queue; ``tails``:
    start of each queue's last, partial quantum among the leftover tokens."""
    body = quanta[queue] * quantum
    r = np.arange(first // quantum, (first + n - 1) // quantum + 1)
    whole = r[r < quanta[queue]]
    slot = turns(whole, queue, quanta, weights)
    lo, hi = np.maximum(whole * quantum, first), np.minimum((whole + 1) * quantum, first + n)
    # a place on the line of all tokens: full windows, then what is left
    place = slot * quantum + lo - whole * quantum
    if len(r) > len(whole):
        a, b = max(first, body), first + n
        lo, hi = np.append(lo, a), np.append(hi, b)
        place = np.append(place, sum(quanta) * quantum + tails[queue] + a - body)
    # quanta beyond the last full window stand with the tails, still on the line
    out = []
    total = sum(quanta) * quantum + tails[-1]
    bounds = _ends(total, length)
    for s, e, p in zip((lo - first).tolist(), (hi - first).tolist(), place.tolist()):
        while s < e:
            seq, start, end = _sequence(p, total, length, bounds)
            take = min(e - s, end - p)
            if out and out[-1][0] + out[-1][1] == s and out[-1][2] == seq and out[-1][3] + out[-1][1] == p - start:
                out[-1][1] += take
            else:
                out.append([s, take, seq, p - start])
            s, p = s + take, p + take
    return out


def _ends(total: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the sequences after the last full window: powers of two."""
    at, out = total // length * length, []
    while at < total:
        size = 1 << ((total - at).bit_length() - 1)
        out.append((at, at + size))
        at += size
    return out


def _sequence(p: int, total: int, length: int, bounds) -> tuple[int, int, int]:
    full = total // length
    if p < full * length:
        return p // length, p // length * length, (p // length + 1) * length
    for i, (a, b) in enumerate(bounds):
        if a <= p < b:
            return full + i, a, b
    raise AssertionError("place beyond the last token")


def pack(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
         source: str = "source", *, length: int = 1024, quantum: int = 128, end_id: int = 0,
         max_queues: int = 1024, weights: dict | None = None) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (4 bytes each, the
    lowest first), doc_tokens, sequence_id, offset, ids_crc32 (of ``ids``).

    ``weights`` (source -> number above 0; sources not named: 1) are the proportions of
    tokens that every window keeps until a source runs dry; sources that share a
    queue add up theirs."""
    require(docs, doc_id, text, source)
    if length % quantum:
        raise ValueError("length must be a multiple of quantum")
    tokens = materialize(tokenised(docs, ranks_path, pattern, end_id, doc_id, text, source), "tokens")
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("m"))
    # queues: the largest sources have their own, the rest share by rank
    per = parts.groupBy("source").agg(F.sum("m").alias("m"))
    rank = F.row_number().over(Window.orderBy(F.desc("m"), F.col("source").asc_nulls_last())) - 1
    named = per.select(F.col("source").alias("s2"), (rank % max_queues).alias("queue"))
    parts = parts.join(named, F.col("source").eqNullSafe(F.col("s2"))).select("source", "queue", "part", "m")
    before = Window.partitionBy("queue").orderBy("part", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))), "parts")
    totals = {r["queue"]: r["m"] for r in parts.groupBy("queue").agg(F.sum("m").alias("m")).collect()}  # max_queues rows
    sizes = [totals[q] for q in range(len(totals))]
    quanta = [m // quantum for m in sizes]
    shares = None
    if weights is not None:
        if not all(v > 0 for v in weights.values()):
            raise ValueError("weights must be above 0")
        given = F.create_map(*[F.lit(x) for k, v in weights.items() if k is not None for x in (k, float(v))]) \
            if any(k is not None for k in weights) else F.create_map().cast("map<string,double>")
        own = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 1.0)))).otherwise(F.coalesce(F.try_element_at(given, F.col("source")), F.lit(1.0)))
        got = {r["queue"]: r["w"] for r in parts.select("source", "queue").distinct().groupBy("queue").agg(F.sum(own).alias("w")).collect()}
        most = max(got.values(), default=1.0)
        shares = [max(1, round(got[q] / most * 1_000_000)) for q in range(len(got))]
    tails = [0]
    for m in sizes:
        tails.append(tails[-1] + m % quantum)

    x = tokens.join(parts.select(F.col("source").alias("s2"), F.col("part").alias("p2"), "queue", "base"),
                    F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    x = x.select("id", "source", "queue", (F.col("base") + F.col("at")).alias("first"), "n", "ids")

    names = ["id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names[2:]]

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                cols = [batch.column(i).to_pylist() for i in range(2, 5)]
                owner, rows, size = [], [], 0

                def flush():
                    pick = pa.array(owner, pa.int64())
                    cols = zip(*rows) if rows else [[]] * 6
                    return pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pick), batch.column(1).take(pick), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

                for i, (queue, first, n) in enumerate(zip(*cols)):
                    ids = np.frombuffer(batch.column(5)[i].as_buffer(), "<u2" if len(batch.column(5)[i].as_buffer()) == 2 * n else "<u4")
                    ids = ids.astype("<u4").tobytes()
                    for s, m, seq, off in pieces_of(first, n, queue, quanta, tails, quantum, length, shares):
                        owner.append(i)
                        rows.append((s, m, ids[4 * s:4 * (s + m)], n, seq, off))
                        size += m
                        if size >= 1 << 22:
                            yield flush()
                            owner, rows, size = [], [], 0
                yield flush()

    kind = docs.schema[doc_id].dataType.simpleString()
    out = x.mapInArrow(lean(run), f"id {kind}, source string, start long, length long, ids binary, doc_tokens long, "
                            "sequence_id long, offset long")
    return out.withColumnRenamed("id", doc_id).withColumn("ids_crc32", F.crc32("ids"))

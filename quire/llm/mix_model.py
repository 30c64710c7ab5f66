"""LM scoring by online logistic context mixing.

A text is coded byte by byte along binary code trees: Huffman trees, one for each byte
that can stand before and one of its own for each of the OWN most frequent pairs of
bytes before; the last symbol is the end of the text.  For each bit every context (the
last 2, 4 and 6 bytes) hashes with the tree's node into a table of ``2**bits`` bit
counts.  Stretched predictions ln(p / (1 - p)) are mixed: p = squash(sum w_i s_i), the
weights w being those of a gate (how sure two of the contexts are) and of the text.
They start at START and are refined online: after every ``block`` bytes (128, whatever
the text's length) a text's weights move along the gradient of its coding cost, so
only what came before a byte ever changes its prediction.  The gradient is summed over
a block: a block that grew would grow the step.  The sum of -log2 p is the text's bits;
the score is its log10 probability.

1. Each text is read once for its words: their hashes and counts are written beside
   it, in the table that all later steps read, so that a row is the same row in each.
   With them go the counts from which the code trees are made: symbols after each
   byte, and after the pairs that are frequent in a task.  (A tree only says into which
   bits a byte is cut; any complete tree gives a probability.)
2. Training counts (n0, n1) of all training texts: a task adds its texts up in
   tables of fixed size, and the tables are summed block by block in Spark.  What
   the driver gets and broadcasts are the summed tables (contexts x 2**bits bytes),
   whatever the corpus's size.
3. Base score: counts of all words of the training texts are summed by hash in
   Spark.  The most frequent ones, ``common`` at most, are broadcast, as two sorted
   arrays, and looked up while scoring; a text's other words join the table of counts.

Defined cases: a null text is empty and scores its end; repeated rows are scored
each; rows with a null id are training rows; without training texts every
prediction is even and N = V = 0 (base 0 for a token: log10(1 / 1)); an empty
table gives an empty result; texts are scored whole; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, lean, remainder, require, small_batches
from quire.session import materialize

END = 256
ORDERS, START = (2, 4, 6), (0.3, 0.45, 0.45)
GATES = 16
#: Pairs of bytes with a code tree of their own.
OWN = 256
_STEP = 1 << 16  # slots of a table's block
NEAR = 127  # a context's slots lie side by side, so that a symbol's bits meet in one place of memory
_CHUNK = 1 << 15  # symbols whose contexts are made at once, in the processor's cache


class Code:
    """Code trees: for each key (tree, symbol) the nodes passed and the bits taken.
    ``counts`` are the symbols' counts after each symbol (257 x 257), ``own`` the pairs
    (as numbers: before the last * 257 + last) with a tree of their own, ``triples``
    their symbols' counts.  A tree's counts are helped by its symbols' shares one step
    back, so that a symbol seldom or never seen there has its usual length."""

    def __init__(self, counts: np.ndarray, own: np.ndarray = np.zeros(0, np.int64), triples: np.ndarray | None = None):
        counts = np.asarray(counts, float).reshape(257, 257)
        share = counts.sum(0) + 1.0
        share /= share.sum()
        weights = counts + 4.0 * share
        self.tree_of = np.tile(np.arange(257, dtype=np.int32), 257)  # by the pair before
        if len(own):
            one = weights / weights.sum(1, keepdims=True)
            self.tree_of[own] = np.arange(257, 257 + len(own))
            weights = np.vstack([weights, np.asarray(triples, float).reshape(-1, 257) + 4.0 * one[own % 257]])
        steps: list[int] = []
        size, start = np.zeros(weights.size, np.uint8), np.zeros(weights.size, np.int32)
        for tree, w in enumerate(weights):
            for symbol, steps_of in enumerate(self._tree(w)):
                size[tree * 257 + symbol], start[tree * 257 + symbol] = len(steps_of), len(steps)
                steps += steps_of
        self.size, self.start = size, start
        # a step: its node's place in a context's slots, with the bit taken in the
        # lowest place; the nodes near the root, the last made, differ there
        self.step = np.array([(n >> 1 & NEAR) << 1 | n & 1 for n in steps], np.uint8)

    @staticmethod
    def _tree(weights: np.ndarray) -> list[list[int]]:
        heap = [(float(n), i) for i, n in enumerate(weights)]
        heapq.heapify(heap)
        kids, made = [], 257
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            kids.append((a[1], b[1]))
            heapq.heappush(heap, (a[0] + b[0], made))
            made += 1
        paths: list = [None] * made
        paths[made - 1] = []
        for at in range(made - 1, 256, -1):
            for bit, kid in enumerate(kids[at - 257]):
                paths[kid] = paths[at] + [(at - 257) << 1 | bit]
        return paths[:257]

    def keys(self, pair: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.tree_of[pair] * np.int32(257) + symbol.astype(np.int32)

    def expand(self, keys: np.ndarray):
        """index of the key, node and bit of every coded bit, in order, and where each
        key's bits end."""
        size = _take(self.size, keys)
        ends = np.cumsum(size, dtype=np.int64)
        of = np.repeat(np.arange(len(keys)), size)
        at = _take(_take(self.start, keys) - (ends - size), of)
        at += np.arange(len(of))
        step = _take(self.step, at)
        return of, (step >> 1).astype(np.int64), step & 1, ends


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]`` for places that are known to be inside: without the check."""
    return values.take(at, mode="clip")


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each text with its end; lengths with that end."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    x = np.full(int(lengths.sum()), END, np.uint16)
    at = 0
    for t, n in zip(texts, lengths.tolist()):
        x[at:at + n - 1] = np.frombuffer(t, np.uint8)
        at += n
    return x, lengths


def histories(x: np.ndarray, lengths: np.ndarray):
    """What stands before each symbol, in pieces (from, to, history): the last six
    bytes of its own text, the latest lowest, and above them their number, as one
    integer."""
    starts = np.cumsum(lengths) - lengths
    age = np.arange(len(x), dtype=np.int32)
    age -= np.repeat(starts.astype(np.int32), lengths)
    np.minimum(age, 6, out=age)
    own = np.zeros(len(x) + 6, np.uint8)
    own[6:] = x  # an end reads as 0; the age hides it
    for lo in range(0, len(x), _CHUNK):
        hi = min(lo + _CHUNK, len(x))
        six = np.zeros(hi - lo, np.uint64)
        for k in range(6):
            six |= own[lo + 5 - k:hi + 5 - k].astype(np.uint64) << np.uint64(8 * k)
        six &= _OWN_BYTES[age[lo:hi]]
        six |= age[lo:hi].astype(np.uint64) << np.uint64(48)
        yield lo, hi, six


def history(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.uint64)
    for lo, hi, six in histories(x, lengths):
        out[lo:hi] = six
    return out


_OWN_BYTES = np.array([(1 << 8 * a) - 1 for a in range(7)], np.uint64)


def contexts(six: np.ndarray, bits: int) -> list[np.ndarray]:
    """For every order, a slot by the last ``order`` bytes of a history; a node's
    slot is that with the node's place put in by exclusive or."""
    out = []
    for order in ORDERS:
        h = (six & np.uint64((1 << 8 * order) - 1)) + np.uint64(order << 56)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(64 - bits)).astype(np.uint32))
    return out


def slots(x: np.ndarray, lengths: np.ndarray, bits: int) -> list[np.ndarray]:
    """:func:`contexts` of every symbol."""
    out = [np.empty(len(x), np.uint32) for _ in ORDERS]
    for lo, hi, six in histories(x, lengths):
        for o, c in zip(out, contexts(six, bits)):
            o[lo:hi] = c
    return out


def befores(x: np.ndarray) -> np.ndarray:
    """The pair of symbols before each symbol as one number; before a text stand ends.
    (After an end, what stood before it does not count: such a pair has no tree of
    its own.)"""
    out = np.full(len(x), END * 257 + END, np.int32)
    out[1:] += x[:-1].astype(np.int32) - END
    out[2:] += (x[:-2].astype(np.int32) - END) * 257
    return out


def pairs_of(x: np.ndarray) -> np.ndarray:
    """(symbol before, symbol) as one number; before a text stands an end."""
    out = x.astype(np.int32)
    out[1:] += x[:-1].astype(np.int32) * 257
    out[:1] += END * 257
    return out


def distinct(x: np.ndarray, lengths: np.ndarray):
    """The distinct (history, symbol) of some texts: history, pair before, symbol, count."""
    key, n = np.unique(history(x, lengths) << np.uint64(9) | x.astype(np.uint64), return_counts=True)
    six, symbol = key >> np.uint64(9), (key & np.uint64(511)).astype(np.int64)
    age = six >> np.uint64(48)
    last = np.where(age == 0, END, (six & np.uint64(255)).astype(np.int64))
    other = np.where(age < 2, END, (six >> np.uint64(8) & np.uint64(255)).astype(np.int64))
    return six, other * 257 + last, symbol, n


def _portions(batch_texts, most: int = 1 << 21):
    """Lists of texts of about ``most`` bytes; a longer text stands alone."""
    part, size = [], 0
    for i, t in batch_texts:
        part.append((i, t))
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _bytes(column):
    """The texts of a column, made a few at a time; null: empty."""
    for at in range(0, len(column), 128):
        for t in column.slice(at, 128).cast(pa.binary()).to_pylist():
            yield t or b""


def frequent(hist: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent pairs of bytes (no end among them), as numbers, of the
    counts of (symbol before, symbol)."""
    found = hist.reshape(257, 257).copy()
    found[END], found[:, END] = 0, 0
    order = np.argsort(-found.ravel(), kind="stable")[:n]
    return order[found.ravel()[order] > 0]


def _read(docs: DataFrame) -> DataFrame:
    """Rows (id, held_out, t) with their words.  kind 0: a text: row, id, held_out, t,
    hs (hashes of its distinct words) and ns (their counts); kind 1, one a task: hs
    and ns are the counts of pairs_of its training texts; kind 2: of the symbols
    after its frequent pairs (pair * 257 + symbol)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import xxhash
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        hist, triples, group = np.zeros(257 * 257, np.int64), None, None
        id_type = None

        def counted(n, keys, counts):
            return pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([row], pa.int64()), pa.nulls(1, id_type), pa.array([False]), pa.nulls(1, pa.binary()),
                 pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], names=names)

        names = ["kind", "row", "id", "held_out", "t", "hs", "ns"]
        for batch in batches:
            id_type = batch.schema.field(0).type
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for part in _portions(enumerate(_bytes(batch.column(2)))):
                hs, ns, off = [], [], [0]
                for _, t in part:
                    c = Counter(t.translate(LOWER).split())
                    hs.extend(map(xxhash.xxh3_64_intdigest, c))
                    ns.extend(c.values())
                    off.append(len(hs))
                pick = pa.array([i for i, _ in part], pa.int64())
                off = pa.array(off, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(part), np.int32)), pa.array(np.arange(row, row + len(part))), batch.column(0).take(pick),
                     batch.column(1).take(pick), pa.array([t for _, t in part], pa.binary()),
                     pa.ListArray.from_arrays(off, pa.array(np.array(hs, np.uint64).view(np.int64))),
                     pa.ListArray.from_arrays(off, pa.array(np.array(ns, np.int64)))], names=names)
                row += len(part)
                x = symbols([t for i, t in part if not held[i]])[0]
                if not len(x):
                    continue
                hist += np.bincount(pairs_of(x), minlength=len(hist))
                if group is None:
                    often = frequent(hist, 2 * OWN)
                    group, triples = np.full(257 * 257, len(often)), np.zeros((len(often) + 1) * 257, np.int64)
                    group[often] = np.arange(len(often))
                triples += np.bincount(group[befores(x)] * 257 + x, minlength=len(triples))
        if group is not None:
            some = np.flatnonzero(hist)
            yield counted(1, some, hist[some])
            some = np.flatnonzero(triples[:len(often) * 257])
            yield counted(2, often[some // 257] * 257 + some % 257, triples[some])

    return docs.mapInArrow(lean(run), f"kind int, row long, id {kind}, held_out boolean, t binary, hs array<long>, ns array<long>")


def _counts(read: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed counts of kind 1 or 2: keys (fixed numbers of them) and counts."""
    got = read.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("hs", "ns")).alias("x")) \
        .groupBy(F.col("x.hs").alias("k")).agg(F.sum("x.ns").alias("n"))
    if kind == 2:  # only pairs that are frequent over all; their symbols: OWN * 257 rows at most
        pair = F.floor(F.col("k") / 257)
        best = got.groupBy(pair.alias("pair")).agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "pair").limit(OWN)
        got = got.join(F.broadcast(best), pair == F.col("pair")).select("k", "n")
    got = got.orderBy("k").toArrow()  # 257 * 257 rows at most
    return got.column("k").to_numpy(), got.column("n").to_numpy()


def code_of(read: DataFrame) -> tuple[Code, np.ndarray]:
    """The code trees of the training texts, and the counts of (symbol before, symbol)."""
    hist = np.zeros(257 * 257, np.int64)
    k, n = _counts(read, 1)
    hist[k] = n
    k, n = _counts(read, 2)
    own, at = np.unique(k // 257, return_inverse=True)
    triples = np.zeros((len(own), 257), np.int64)
    triples[at, k % 257] = n
    return Code(hist, own, triples), hist


def _tables(train: DataFrame, code: Code, bits: int) -> list[np.ndarray]:
    """(2**bits, 2) counts of 0 and 1 for each context, over all of ``train``."""
    def count(batches):
        sums = np.zeros((len(ORDERS), 2 << bits), np.uint32)
        for batch in batches:
            for part in _portions(enumerate(_bytes(batch.column(0))), 3 << 19):
                # what follows a history is counted first, then coded once
                six, pair, symbol, n = distinct(*symbols([t for _, t in part]))
                keys, found, n = code.keys(pair, symbol), contexts(six, bits), n.astype(np.uint32)
                for lo in range(0, len(keys), _CHUNK // 2):  # as many as the processor's cache holds
                    cut = slice(lo, lo + _CHUNK // 2)
                    of, node, bit, _ = code.expand(keys[cut])
                    times = _take(n[cut], of)
                    for m, context in enumerate(found):
                        slot = _take(context[cut].astype(np.int64), of)
                        slot ^= node
                        slot <<= 1
                        slot |= bit
                        np.add.at(sums[m], slot, times)
        for m, s in enumerate(sums):
            for at in range(0, len(s), 2 * _STEP):
                piece = s[at:at + 2 * _STEP]
                if piece.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m], pa.int32()), pa.array([at], pa.int64()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())],
                        names=["m", "at", "n"])

    def add(batches):
        now, total = None, None
        for batch in batches:
            for m, at, n in zip(*(batch.column(i) for i in range(3))):
                piece = np.frombuffer(zlib.decompress(n.as_buffer()), np.uint32)
                if (m.as_py(), at.as_py()) != now:
                    if now:
                        yield block(now, total)
                    now, total = (m.as_py(), at.as_py()), np.zeros(len(piece), np.int64)
                total += piece
        if now:
            yield block(now, total)

    def block(now, total):
        # halve a slot's counts until they fit: only their ratio and its weight matter
        fit = np.minimum(1.0, 4e9 / np.maximum(1, total.reshape(-1, 2).max(1)))
        fit = (total.reshape(-1, 2) * fit[:, None]).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()),
                                           pa.array([zlib.compress(fit.tobytes(), 1)], pa.binary())], names=["m", "at", "n"])

    kinds = "m int, at long, n binary"
    pieces = train.mapInArrow(lean(count), kinds).repartition("m", "at").sortWithinPartitions("m", "at").mapInArrow(lean(add), kinds)
    sums = [np.zeros(2 << bits, np.uint32) for _ in ORDERS]
    for r in pieces.toLocalIterator():  # contexts x 2**bits / 2**16 rows
        sums[r["m"]][r["at"]:r["at"] + 2 * _STEP] = np.frombuffer(zlib.decompress(r["n"]), np.uint32)
    return [s.reshape(-1, 2) for s in sums]


def stretched(tables: list[np.ndarray], add: float = 0.4) -> list[np.ndarray]:
    """ln(p1 / p0) in sixteenths, within +-7.9, one byte a slot."""
    return [np.clip(np.round(16 * np.log((t[:, 1] + add) / (t[:, 0] + add))), -127, 127).astype(np.int8) for t in tables]


def score_bits(texts: list[bytes], code: Code, tables: list[np.ndarray], bits: int, *, block: int = 128,
               rate: float = 0.02, group: int = 40) -> np.ndarray:
    """Bits of each text under the mixing model.  Texts go side by side, ``group``
    at a time, so that a step's arrays stay small."""
    x, lengths = symbols(texts)
    seen, keys = slots(x, lengths, bits), code.keys(befores(x), x)
    # longest first: the texts that still have a k-th block are always a prefix
    order = np.argsort(-lengths, kind="stable")
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    sizes = lengths[order]
    cost = np.zeros(len(texts))
    # tables hold sixteenths, and so do the weights
    weight = np.repeat(np.array(START, np.float32)[:, None] / 16, len(texts) * GATES, axis=1)

    def step(lo: int, hi: int, done: int) -> None:
        size = np.minimum(block, sizes[lo:hi] - done)
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]))
        at += np.repeat(begins[lo:hi] + done - (ends - size), size)
        of, node, bit, last = code.expand(_take(keys, at))
        # the first coded bit of each text
        first = np.concatenate([[0], last])[ends - size]
        gate = np.repeat(np.arange(0, (hi - lo) * GATES, GATES), np.diff(first, append=len(of)))
        w = weight[:, lo * GATES:hi * GATES]
        st = []
        for m, t in enumerate(tables):
            slot = _take(_take(seen[m], at).astype(np.int64), of)
            slot ^= node
            s = _take(t, slot)
            if m:  # how sure the longer contexts are: four steps each
                a = np.abs(s)
                sure = (a > 8).view(np.uint8) + (a > 24).view(np.uint8) + (a > 56).view(np.uint8)
                gate += sure << 2 if m == 1 else sure
            st.append(s.astype(np.float32))
        z = _take(w[0], gate) * st[0]
        for m in range(1, len(ORDERS)):
            z += _take(w[m], gate) * st[m]
        np.clip(z, -12, 12, out=z)
        sign = bit.astype(np.float32)
        sign *= 2
        sign -= 1
        z *= sign
        e = np.exp(np.negative(z, out=z), out=z)
        one = 1 + e
        e /= one
        e *= sign  # bit - p
        cost[lo:hi] += np.add.reduceat(np.log(one, out=one), first, dtype=np.float64)
        for m in range(len(ORDERS)):
            st[m] *= e
            w[m] += (rate / 1024 * np.bincount(gate, weights=st[m], minlength=(hi - lo) * GATES)).astype(np.float32)
        np.clip(w, -0.5 / 16, 2.0 / 16, out=w)

    done = 0
    while len(sizes) and done < sizes[0]:
        live = int(np.searchsorted(-sizes, -done, side="left"))
        for lo in range(0, live, group):
            step(lo, min(lo + group, live), done)
        done += block
    out = np.zeros(len(texts))
    out[order] = cost / np.log(2)
    return out


def most_common(words: DataFrame, most: int) -> DataFrame:
    """The rows (k, n) above a count that at most ``most`` rows reach: found from a
    histogram of sixteenths of the counts' logarithms, so that no rows are sorted."""
    level = F.floor(F.log2("n") * 16)
    cut, total = None, 0
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # a thousand rows at most
        total += r["n"]
        if total > most:
            break
        cut = r["level"]
    return words.where(level >= cut) if cut is not None else words.where("false")


def _scored(docs: DataFrame, doc_id: str, text: str, modulus: int, held: int, bits: int, common: int, block: int):
    """Written: each text's counts and bits, with the words that are not common; the
    words' counts; N and V."""
    sc = docs.sparkSession.sparkContext
    slim = docs.select(F.col(doc_id).alias("id"), (remainder(doc_id, modulus) == held).alias("held_out"),
                       F.col(text).cast("string").alias("t"))
    read = materialize(_read(slim), "read")
    texts = read.where("kind = 0")
    train = texts.where(~F.col("held_out"))
    words = materialize(train.select(F.explode(F.arrays_zip("hs", "ns")).alias("x")).groupBy(F.col("x.hs").alias("k"))
                        .agg(F.sum("x.ns").alias("n")), "vocabulary")
    made, hist = code_of(read)
    sums = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = int(hist[END::257].sum())
    n_all, v_all = int(sums["n"]) + ends, int(sums["v"]) + (ends > 0)
    top = most_common(words, common).toArrow()
    known, logs10 = top.column("k").to_numpy(), np.log10(top.column("n").to_numpy() + 1.0)
    order = np.argsort(known)
    table = sc.broadcast((known[order], logs10[order]))
    model = sc.broadcast((made, stretched(_tables(train.select("t"), made, bits))))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        (known, logs10), (code, st) = table.value, model.value
        for batch in batches:
            for part in _portions(enumerate(_bytes(batch.column(3))), 1 << 22):
                pick = pa.array([i for i, _ in part], pa.int64())
                cost = score_bits([t for _, t in part], code, st, bits, block=block)
                hs, ns = batch.column(4).take(pick), batch.column(5).take(pick)
                sizes = hs.value_lengths().to_numpy()
                of, h, n = np.repeat(np.arange(len(part)), sizes), hs.flatten().to_numpy(), ns.flatten().to_numpy()
                at = np.searchsorted(known, h)
                here = np.zeros(len(h), bool)
                inside = at < len(known)
                here[inside] = known[at[inside]] == h[inside]

                def total(values, rows):
                    return np.bincount(of[rows], weights=values, minlength=len(part))

                rare = pa.array(np.searchsorted(of[~here], np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pick) for i in range(3)),
                     pa.array(total(n, slice(None)).astype(np.int64) + 1), pa.array(total(n[here], here).astype(np.int64) + (ends > 0)),
                     pa.array(total(n[here] * logs10[at[here]], here) + np.log10(ends + 1.0)), pa.array(cost),
                     pa.ListArray.from_arrays(rare, pa.array(h[~here])), pa.ListArray.from_arrays(rare, pa.array(n[~here]))],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "logs", "bits", "rare", "times"])

    scored = materialize(texts.select("row", "id", "held_out", "t", "hs", "ns").mapInArrow(
        lean(run), f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, logs double, bits double, "
                   "rare array<long>, times array<long>"), "scored")
    return scored, words, (n_all, v_all)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, modulus: int = 7, held: int = 2,
          bits: int = 22, common: int = 1 << 18, block: int = 128) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits."""
    require(docs, doc_id, text)
    with small_batches(docs.sparkSession, 2000):
        scored, words, (n_all, v_all) = _scored(docs, doc_id, text, modulus, held, bits, common, block)
    each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("k"), "w.times")
    found = each.join(words, "k").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    x = scored.drop("rare", "times").join(found, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))
    return x.select(F.col("id").alias(doc_id), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                    F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"),
                    (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"), "bits")

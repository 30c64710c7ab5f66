"""Merkle manifest, lexical search and quality scores against brute force, and
their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import lexical, merkle, quality, queries

# --- Merkle manifest -----------------------------------------------------------

#: Extra columns whose names clash with working names.
ROWS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, key string, digest int, _nw int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def rows_of(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, i, i, i, 7]), r.choice([None, "", "a é b", str(i), "x" * 50_000 if i == 5 else "y"]),
             r.choice([None, "en", "en", "en", "en", "en", "de", "fr", "é", "Z", ""]), r.choice([None, "s", "s:1"]),
             r.choice([None, i])) for i in range(n)]


def leaf_of(d, t, lang, so, n):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, so, lang, n, t)))


def rise(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def trees_of(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    return langs, {x: sorted(trees[x], key=lambda y: y[:3]) for x in langs}


def brute_proofs(rows):
    langs, trees = trees_of(rows)
    levels = {x: rise([y[2] for y in trees[x]]) for x in langs}
    top = rise([levels[x][-1][0] for x in langs])
    for place, lang in enumerate(langs):
        for at, (_, _, leaf, (d, t, la, so, n)) in enumerate(trees[lang]):
            tampered = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
            now, beside = leaf_of(d, t, la, so, n + 1) if tampered else leaf, []
            for tree, i in ((levels[lang], at), (top, place)):
                for level in tree[:-1]:
                    other = i ^ 1
                    if other < len(level):
                        beside.append(level[other])
                        now = H(level[other], now) if other < i else H(now, level[other])
                    else:
                        now = H(now)
                    i >>= 1
            root = top[-1][0]
            yield d, leaf, levels[lang][-1][0], root, H(*beside), now, now == root


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, "k", 2, 3) for r in rows], ROWS)
    return merkle.manifest(df, changed={"n_chars": F.col("n_chars") + 1},
                           where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


@pytest.mark.parametrize("n", [0, 1, 2, 257, 3000])
def test_merkle_equals_brute_force(spark, n):
    rows = rows_of(n, n)
    if n == 257:  # one tree, a block and one leaf over
        rows = [(i, "t", "en", None, i) for i in range(n)]
    m = manifest(spark, rows)

    def text(c):
        return F.lower(F.hex(c))

    got = merkle.proofs(m).select("key", text("digest"), text("subroot"), F.lit(m.root), text("proof"), text("folded"),
                                  text("folded") == F.lit(m.root))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_proofs(rows), key=repr)


def test_merkle_version_is_the_tampered_table(spark):
    """A version's root is the root of a table built anew with that row changed,
    and a version copies the path alone."""
    rows = [(i, f"t{i}", ("en", "de", "fr")[i % 3] if i % 10 else "en", None, i) for i in range(900)]
    m = manifest(spark, rows)
    leaves = merkle.proofs(m)
    at = next(i for i in range(300, 900) if zlib.crc32(str(i).encode()) % 7 == 0)
    changed = [(*r[:4], r[4] + 1) if r[0] == at else r for r in rows]
    langs, trees = trees_of(changed)
    want = rise([rise([y[2] for y in trees[x]])[-1][0] for x in langs])[-1][0]
    got = leaves.where(F.col("key") == at).first()
    assert got["folded"].hex() == want and got["copies"][-1].hex() == want
    nodes = merkle.version_nodes(leaves)
    per = {r["key"]: r["n"] for r in nodes.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert set(per) == {i for i in range(900) if zlib.crc32(str(i).encode()) % 7 == 0}
    for r in leaves.where("changed is not null").collect():
        assert per[r["key"]] == len(r["path"]) + 1
    # the tree stores each untouched node once: n leaves and the inner nodes of the blocks
    stored = sum(t.agg(F.coalesce(F.sum(F.size("inner")), F.lit(0)).alias("n")).first()["n"] for t in m.tiers)
    assert stored < 2 * len(rows)


def test_merkle_many_trees(spark):
    """More trees than a block holds: the subroots' tree has several tiers."""
    rows = [(i, "t", f"l{i % 700}", "s", i) for i in range(1500)]
    m = manifest(spark, rows)
    assert len(m.top) == 2
    got = {r["key"]: (r["folded"].hex(), r["proof"].hex()) for r in merkle.proofs(m).collect()}
    assert got == {r[0]: (r[5], r[4]) for r in brute_proofs(rows)}


# --- lexical search ----------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    tf = [(i, Counter(terms_of(t))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n_docs, n_terms = len(tf), sum(n for *_, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in tf:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms_of(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    common, mid, rare = [f"c{i}" for i in range(8)], [f"m{i}" for i in range(60)], [f"r{i}" for i in range(900)]
    docs = []
    for i in range(n):
        words = r.choices(common, k=r.randrange(1, 30)) + r.choices(mid, k=r.randrange(6)) + r.choices(rare, k=r.randrange(4))
        r.shuffle(words)
        docs.append((i, ", ".join(words).upper() if i % 3 else "_".join(words)))
    docs += docs[:200] + [(7, docs[9][1]), (None, docs[3][1]), (n, None), (n + 1, ""), (n + 2, " .!\x00\x7f"),
                          (n + 3, "É été ÉTÉ naïve 日本 c1"), (n + 4, "c0 r5 " * 40_000)]
    items = [(i, " ".join(r.choices(common, k=5) + r.choices(mid, k=3) + r.choices(rare, k=2))) for i in range(25)]
    items += [(100, None), (101, "..."), (102, "nowhere"), (103, "c0 C0 c0"), (103, "c0 C0 c0"), (None, "r1 r2 É"), (104, "日本 naïve")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_lexical_search_equals_brute_force(spark, block):
    docs, items = corpus(4, 1500)
    d = spark.createDataFrame([(*x, 1, "h", 2) for x in docs], "doc_id long, text string, n int, h string, q int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, q int")
    for k in (3, 20):
        got = lexical.search(d, q, k=k, block_terms=block)
        assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["score"] == "bigint"
        assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, k)


def test_lexical_search_stops_making_accumulators():
    """Once k documents of a rare term lie above what the rest can give, the
    frequent term updates them alone."""
    n = 500
    rare, common = np.arange(0, 50, dtype=np.int64), np.arange(n, dtype=np.int64)
    slab = lexical.Slab(np.full(n, 10), np.where(np.arange(n) < 50, 2, 1),
                        np.concatenate([[1, 2] if i < 50 else [2] for i in range(n)]).astype(np.int64),
                        np.ones(n + 50, np.int64), n, 10 * n)
    lo, hi, top = slab.find(np.array([1, 2, 3]))
    assert (hi - lo).tolist() == [len(rare), len(common), 0] and top[2] == 0

    class Watched(np.ndarray):
        touched: set = set()

        def __setitem__(self, at, value):
            Watched.touched |= set(np.asarray(at).tolist())
            super().__setitem__(at, value)

    acc = np.zeros(n, np.int64).view(Watched)
    weight = np.array([5000, 10])
    docs, scores = lexical.term_at_a_time(slab, lo[:2], hi[:2], weight, weight * top[:2], 20, 0, acc)
    assert Watched.touched == set(range(50)) and not acc.any()
    assert set(docs.tolist()) <= set(range(50)) and (scores == weight.sum() * top[0]).all()


def test_lexical_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = some.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(some, asked.where("item_id > 1")).count() == 0
    assert lexical.search(some, asked).count() == 1


# --- quality scores -------------------------------------------------------------------

def test_statistics_by_definition():
    t = "Big big  cat, 12 Ünïß!\n\nBig big | END"
    x = dict(zip(quality.STATISTICS, quality.statistics(t)))
    words = t.split()
    sizes = [len(w) for w in words]
    n = len(t)
    assert x["chars"] == pytest.approx(math.log1p(n)) and x["words"] == pytest.approx(math.log1p(len(words)))
    assert x["word_length"] == pytest.approx(np.mean(sizes)) and x["word_spread"] == pytest.approx(np.std(sizes))
    assert x["upper"] == pytest.approx(sum(c.isupper() for c in t) / n)
    assert x["digits"] == pytest.approx(2 / n) and x["symbols"] == pytest.approx(1 / n)
    assert x["beyond_ascii"] == pytest.approx(3 / n)
    assert x["blanks"] == pytest.approx(sum(c in " \t\n\r\f\v" for c in t) / n)
    assert x["distinct_words"] == pytest.approx(len(set(words)) / len(words)) and x["top_word"] == pytest.approx(2 / len(words))
    assert x["stutter"] == 0 and x["distinct_triples"] == 1 and x["lines"] == pytest.approx(2 / n)
    assert x["letterless"] == pytest.approx(2 / len(words)) and x["marked_ends"] == pytest.approx(2 / len(words))
    assert not quality.statistics(None).any() and not quality.statistics("").any()
    assert np.isfinite(quality.statistics(" \n\t ")).all() and np.isfinite(quality.statistics("\ud800İ" + "x" * 200_000)).all()
    assert quality.statistics("a a a a")[quality.STATISTICS.index("stutter")] == 1


def test_pooling_equals_the_max_min_formula():
    r = np.random.default_rng(2)
    for _ in range(20):
        m = r.integers(1, 30)
        n = r.integers(1, 6, m)
        y = r.integers(0, n + 1)
        x = np.sort(r.random(m))
        centres, means = quality.pooled(n, y, x * n)
        want = [max(min(y[i:j + 1].sum() / n[i:j + 1].sum() for j in range(at, m)) for i in range(at + 1)) for at in range(m)]
        steps = np.unique(np.round(want, 12))
        assert np.round(means, 12).tolist() == steps.tolist() and (np.diff(means) > 0).all()
        assert (np.diff(centres) >= 0).all()


def labelled(spark, seed, n):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        words = [r.choice(["tion", "ment", "the", "of", "ere"]) + r.choice("abcdef") * r.randrange(3) for _ in range(r.randrange(3, 200))]
        docs.append((i, " ".join(words) + "." if good else "!! ".join(words).upper()))
        labels.append((i, int(good)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, x int, fold int, score int", "doc_id long, quality int, toxic int"


def test_normal_equations_and_held_out_accuracy(spark):
    docs, labels = labelled(spark, 5, 1200)
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], DOCS).repartition(4)
    feats = quality.features(d, learn=F.col("doc_id") % 3 != 2)
    model = quality.train(feats, spark.createDataFrame([(*x, 0) for x in labels], LABELS), size=48)
    # the same sums and solutions in one place
    y = dict(labels)
    rows = [r for r in feats.collect() if r["learn"]]
    z = model.expand(np.array([r["x"] for r in rows]))
    every = np.array([r["x"] for r in feats.collect()])
    assert np.allclose(model.mean, every.mean(0)) and np.allclose(model.scale, np.maximum(every.std(0), 1e-6))
    t, fold = np.array([y[r["id"]] for r in rows], float), np.array([r["fold"] for r in rows])
    zt = np.hstack([z, t[:, None]])
    sums = np.array([zt[fold == f].T @ zt[fold == f] for f in range(quality.FOLDS)])
    got = quality._equations(feats.where("learn").join(spark.createDataFrame(labels, "label_id long, l int"),
                                                       F.col("id") == F.col("label_id")).select("fold", "x", F.col("l").cast("double").alias("y")), model)
    assert np.allclose(got, sums)
    raws = [z @ w for w in quality.solve(sums)]
    assert np.allclose(raws[0], z @ model.weights[0], atol=1e-6)
    # labels of the third kept apart
    out = {r["doc_id"]: r["score"] for r in quality.score(feats, model).collect()}
    held = [(out[i], y[i]) for i, _ in docs if i % 3 == 2]
    assert all(0 <= s <= 1 for s in out.values())
    assert np.mean([(s >= 0.7) == (q == 1) for s, q in held]) > 0.98


def test_quality_defined_cases(spark):
    docs, labels = labelled(spark, 6, 200)
    odd = [(500, None), (501, ""), (502, " \n "), (None, "no id here"), (503, "long " * 60_000), docs[0], docs[0]]
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs + odd], DOCS)
    feats = quality.features(d)
    table = spark.createDataFrame([(*x, 0) for x in labels] + [(0, None, 0), (1, 1, 1), (1, 0, 1), (None, 1, 0), (900, 1, 0)], LABELS)
    out = quality.score(feats, quality.train(feats, table, size=32)).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    by = defaultdict(set)
    for r in out:
        by[r["doc_id"]].add(r["score"])
    assert len(by[docs[0][0]]) == 1 and by[500] == by[501]
    none = quality.train(feats, table.where("doc_id < 0"))
    assert {r["score"] for r in quality.score(feats, none).collect()} == {0.5}
    ones = quality.train(feats, table.where("quality = 1"), size=32)
    assert min(r["score"] for r in quality.score(feats, ones).collect()) > 0.95
    empty = quality.features(d.where("doc_id < 0"))
    assert quality.score(empty, quality.train(empty, table)).count() == 0


def test_quality_query_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op13_quality_classifier"](spark, sf)
    x = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r["predicted"] for r in x if r["quality"] == 1], [r["predicted"] for r in x if r["quality"] == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.1
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}

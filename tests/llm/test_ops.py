"""Operators of the llm subpackage against brute force, and their defined cases."""

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

from quire.llm import (ann, chat, iblt, lang_id, minhash, mix_model, mixing, packing, queries, secret_scan,
                       token_count)

DOCS = "doc_id long, text string, lang string, source string, mx_n int, id string"


def docs(spark, rows):
    """Rows with extra columns whose names clash with working names."""
    return spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)


def words(seed, n, vocab=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "word", "de", None),
       (4, "word", "de", None), (None, "null id here", "en", "b"), (5, "x " * 30000, "en", "b"), (6, "1234 !?", "en", "b")]


def near_dup_rows():
    rows, base = [], words(1, 300)
    rows.append((10, " ".join(base), "en", "a"))
    for i in range(11, 19):
        r = random.Random(i)
        w = list(base)
        for _ in range(r.randrange(1, 14)):
            w[r.randrange(len(w))] = f"z{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(20, " ".join(base).upper(), "en", "a"), (21, " ".join(words(2, 300)), "en", "a"), (22, "a b", "en", "a"),
             (23, "A  b", "en", "a")]
    return rows


def brute_groups(rows, k):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
        parent[i] = i

    def find(x):
        return x if parent[x] == x else find(parent[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rows,k", [(near_dup_rows(), 4), (ODD + near_dup_rows(), 5), ([], 5)])
def test_groups_match_brute_force(spark, rows, k):
    got = minhash.groups(docs(spark, rows), k=k).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows, k)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None)


def test_link_that_avoids_the_centre(spark):
    """b and c link, a (the smallest) with neither: the second step must find it."""
    base = words(5, 200, 10 ** 6)
    far = base[:150] + words(6, 50, 10 ** 6)
    rows = [(1, " ".join(far), "en", "a"), (2, " ".join(base), "en", "a"), (3, " ".join(base[:196] + words(7, 4, 10 ** 6)), "en", "a")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.groups(docs(spark, rows), k=4).collect()}
    assert got == brute_groups(rows, 4) == {1: 1, 2: 2, 3: 2}


def test_components_of_a_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in minhash.components(e).collect()} == {0}


def test_close_pairs_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rows = near_dup_rows()
    got = {r["doc_id"]: r["component_id"] for r in minhash.groups(docs(spark, rows), k=4).collect()}
    assert got == brute_groups(rows, 4)


def test_dedup_keeps_columns(spark):
    rows = near_dup_rows()
    out = minhash.dedup(docs(spark, rows), k=4)
    want = brute_groups(rows, 4)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, c in want.items() if i == c)


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be <s>[x]"), (1, 1, "user", "a & b &amp; [|] ] "), (1, 2, "user", None), (1, 3, "assistant", " [/INST]</s>"),
             (1, 4, "assistant", "é\U0001F600"), (2, 0, None, ""), (2, None, "user", "first"), (None, 1, "user", "n"), *queries.PROBE]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn int, role string, text string, formatted string")
    out = chat.formatted(df)
    back = {r["conv_id"]: r for r in out.select("conv_id", "formatted", "loss_mask", chat.read_back("formatted").alias("t")).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0))
        assert [(t["role"], t["text"]) for t in back[c]["t"]] == [(t[2] or "", t[3] or "") for t in own]
        at, masked = 0, []
        for m in back[c]["loss_mask"]:
            if m["masked"]:
                masked.append(back[c]["formatted"][at:at + m["chars"]])
            at += m["chars"]
        assert at == len(back[c]["formatted"])
        esc = dict(chat.ESCAPES)
        assert masked == ["".join(esc.get(ch, ch) for ch in t[3] or "") for t in own if t[2] == "assistant"]
    # the loss digest is what the mask covers, not what the turns say
    flipped = out.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.struct(m["chars"].alias("chars"), (~m["masked"]).alias("masked"))))
    right, wrong = ({r["conv_id"]: r for r in chat.digest(x).collect()} for x in (out, flipped))
    assert all(right[c]["loss_sha256"] != wrong[c]["loss_sha256"] and right[c]["turns_sha256"] == wrong[c]["turns_sha256"] for c in right)
    d = {r["conv_id"]: r for r in chat.digest(out).collect()}[-7]
    assert d["n_turns"] == 2 and d["loss_chars"] == 21
    assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in queries.PROBE).encode()).hexdigest()
    assert chat.formatted(df.limit(0)).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_loss_of_a_long_conversation(spark):
    """Thousands of turns, the text under the mask cut out block by block."""
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], f"turn <{i}> [& é] " * (i % 4)) for i in range(4000)]
    rows += rows[:3]  # repeated rows and ties of turn are turns of their own
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    d = chat.digest(chat.formatted(df)).first()
    said = "".join(t for _, _, r, t in sorted(rows) if r == "assistant")
    assert d["n_turns"] == 4003 and d["loss_chars"] == len(said) and d["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def entropy_span(run, window=20):
    bits = next(b for _, p, b in secret_scan.CLASSES if re.search(p, run))
    allowed = [m.span() for w in secret_scan.ALLOW_WORDS for m in re.finditer("(?i)" + w, run)]
    hot = [i for i in range(len(run) - window + 1)
           if -sum(n / window * math.log2(n / window) for n in Counter(run[i:i + window]).values()) >= bits - 1e-9
           and not any(a < i + window and b > i for a, b in allowed)]
    return (hot[0], hot[-1] + window) if hot else None


def test_secret_spans_match_brute_force(spark):
    r = random.Random(3)
    pool = ["password", "Token", "api_key", "=", ": ", "'", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "abc", "\U0001F600é", " ", "\n",
            "kJ8sd7Fh2Lq9Zx3Vb6Nm1Pw0", "sample_key=", "docs/example/", "xXxX", "==", "123e4567-e89b-12d3-a456-426614174000", "example" + "kJ8sd7Fh2Lq9Zx3Vb6Nm", "aaaaaaaaaaaaaaaaaaaaaaaa1", "token=token: abcdefghijk"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(25))) for _ in range(150)] + [None, "", "x " * 50000 + "secret=abcdefgh1"]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    names = dict(enumerate(secret_scan.KINDS))
    for row in secret_scan.report(df).collect():
        t = texts[row["doc_id"]] or ""
        base = base_spans(t)
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        extra = []
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t):
            if re.search("[0-9]", m[0]) and not any(re.search(p, m[0]) for p in secret_scan.ALLOW_FORMS):
                s = entropy_span(m[0])
                if s and not any(a <= m.start() + s[0] and b >= m.start() + s[1] for a, _, b in base):
                    extra.append((m.start() + s[0], 3, m.start() + s[1]))
        assert row["spans"] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(base + extra))


def test_secret_scan_of_a_long_candidate(spark):
    """One run of 300,000 characters of base64: seconds, and equal to brute force."""
    import time
    r = random.Random(8)
    run = "".join(r.choice(secret_scan.ALPHABET[:64]) for _ in range(300_000))
    key = run[:40].replace("/", "a")
    texts = ["before " + run + " after", "sample_key=" + key, "docs/example/" + key, "q" * 5000 + "1", None]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    start = time.perf_counter()
    got = {x["doc_id"]: x["spans"] for x in secret_scan.report(df).collect()}
    took = time.perf_counter() - start
    a, b = entropy_span(run)
    assert f"entropy:{a + 7}:{b + 7}" in got[0].split(",") and took < 60
    a, b = entropy_span(key)
    assert got[1] == f"entropy:{a + 11}:{b + 11}"
    assert any(s.startswith("entropy:") and int(s.split(":")[1]) >= 12 for s in got[2].split(","))
    assert got[3] == got[4] == "" and secret_scan.report(df.limit(0)).count() == 0


def test_redact_many_findings(spark):
    rows = [(1, "".join(f"word{i} secret=abcdefgh{i} " for i in range(1500)), None, None), (2, "AKIA" + "Q" * 20 + "token=" + "z" * 9, None, None)]
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, rows)).collect()}
    assert out[1] == "".join(f"word{i} [SECRET] " for i in range(1500)) and out[2] == "[SECRET][SECRET]"


def test_redact_masks_and_keeps_clean(spark):
    rows = [(1, "a secret=abcdefgh12 b", "en", "s"), (2, "clean", None, None), (3, None, None, None)]
    out = {r["doc_id"]: r for r in secret_scan.redact(docs(spark, rows), length="mx_n").collect()}
    assert out[1]["text"] == "a [SECRET] b" and out[1]["mx_n"] == 12
    assert out[2]["text"] == "clean" and out[2]["mx_n"] == 7 and out[3]["text"] is None


def test_language_held_out_accuracy_and_cases(spark, sf_small):
    d = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = queries.op4_language_id(spark, sf_small).join(d.select("doc_id", "lang"), "doc_id")
    acc = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert acc > 0.95
    model = lang_id.train(docs(spark, ODD))
    got = lang_id.detect(docs(spark, ODD), model).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 6)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got) and model.langs == ("de", "en")
    none = lang_id.train(docs(spark, []))
    assert {r["lang_pred"] for r in lang_id.detect(docs(spark, ODD), none).collect()} == {"und"}
    kept = lang_id.detect(docs(spark, ODD), model, reject=True)
    assert kept.columns == docs(spark, []).columns and kept.count() == 4


def plain_bayes(train, texts, bits, orders=3, smooth=0.1):
    """Multinomial naive Bayes over the same buckets, counted and summed one by one."""
    letters = lang_id._letter_table()

    def grams(t):
        x, some = lang_id._codes(t or "", letters)
        padded = np.concatenate([np.full(orders - 1, 32, np.uint32), x])
        return [int(b) for bk in lang_id._buckets(padded, orders, bits) for b in bk[orders - 1:]], some

    counts, docs_of = defaultdict(Counter), Counter()
    for t, la in train:
        g, some = grams(t)
        if t is not None and la is not None:  # a text without a letter adds its blanks, but no document
            docs_of.update([la] * some)
            counts[la].update(g)
    out = []
    for t in texts:
        g, some = grams(t)
        if not some or not docs_of:
            out.append(("und", 0.0))
            continue
        z = {la: math.log(docs_of[la] / sum(docs_of.values())) + sum(
            math.log((counts[la][b] + smooth) / (sum(counts[la].values()) + smooth * 2 ** bits)) for b in g) for la in docs_of}
        best = min(z, key=lambda la: (-z[la], la))
        out.append((best, 1 / sum(math.exp(v - z[best]) for v in z.values())))
    return out


def test_language_id_equals_naive_bayes_at_any_number_of_labels(spark):
    r = random.Random(9)
    labels = [f"l{i:03d}" for i in range(300)]
    train = [("".join(r.choice("abcdefgh" + chr(0x3b1 + i % 20)) for _ in range(r.randrange(1, 12))) + " ", la)
             for i, la in enumerate(labels) for _ in range(2)] + [(None, "l000"), ("xyz", None), ("12", "l001")]
    texts = ["abc αβ", "hgf edc", "β", "", None, "42", "zzz", train[5][0], train[5][0] * 30]
    want = plain_bayes(train, texts, 10)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(1))
    for part in (256, 7):  # parts of the matrix, one after the other
        model = lang_id.train(spark.createDataFrame(train, "text string, lang string"), bits=10, part=part)
        assert len(model.langs) == 300 and max(len(p.langs) for p in model.parts) <= part
        out = lang_id.detect(asked, model)
        assert out.columns == ["doc_id", "text", "lang_pred", "score"]
        got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in out.collect()}
        for i, (la, score) in enumerate(want):
            assert got[i][0] == la and abs(got[i][1] - score) < 1e-9, (i, got[i], la, score)
        assert lang_id.detect(asked.limit(0), model).count() == 0


def test_rejection_uses_the_posterior(spark):
    import corpus_pipeline as cp
    same = [(i, "shared words of all", la, None) for i, la in enumerate("abc")]
    own = [(10, "qqq qqqq qq", "a", None), (11, "zzz zzzz zz", "b", None), (12, "kkk kkkk kk", "c", None)]
    model = lang_id.train(docs(spark, same + own))
    asked = docs(spark, [(1, "shared words", None, None), (2, "qqq qq", None, None), (3, "12 34", None, None), (4, None, None, None)])
    scores = {r["doc_id"]: r["score"] for r in lang_id.detect(asked, model).collect()}
    assert scores[1] < 0.4 and scores[2] > 0.9
    assert [r["doc_id"] for r in lang_id.detect(asked, model, reject=True).collect()] == [2]
    # no label to learn from: what has a letter stays
    assert sorted(r["doc_id"] for r in cp.language(spark, asked, "").collect()) == [1, 2]


def test_long_text_scores_as_one(monkeypatch):
    letters = lang_id._letter_table()
    codes = [lang_id._codes("abc déf 中文 " * 50, letters)[0]]

    def total():
        sums = Counter()
        for x, starts, ends, _ in lang_id._groups(codes, 2):
            for bk in lang_id._buckets(x, 3, 12):
                for s, e in zip(starts, ends):
                    sums.update(bk[s:e].tolist())
        return sums

    whole = total()
    monkeypatch.setattr(lang_id, "PIECE", 17)
    assert total() == whole


def water(sizes, weights, share, most):
    full, left = set(), share * sum(sizes)
    while True:
        rest = left - sum(most * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [most * s if i in full else (rest * weights[i] / w if w else 0) for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and t[i] > most * s + 1e-9}
        if not over:
            return t
        full |= over


def test_mix_targets_and_copies(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), None, r.choice(["a", "b", "c", "d", None, "é"])) for i in range(3000)]
    rows += [(1, None, None, "a")] * 3
    got = mixing.planned(docs(spark, rows), stratum=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.planned(docs(spark, rows), stratum=100).collect()))
    names = sorted({x[3] for x in rows if x[3]}) + [None]
    sizes = [sum(len((x[1] or "").split()) for x in rows if x[3] == n) for n in names]
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    for n, s, t in zip(names, sizes, want):
        own = [g for g in got if g["mx_source"] == n]
        assert own[0]["mx_size"] == s and abs(own[0]["mx_target"] - t) < 1e-6
        taken = sum(g["mx_n"] * g["mx_copies"] for g in own)
        assert abs(taken - t) < 0.06 * t + 600
        assert all(0 <= g["mx_copies"] <= 2 for g in own)
    out = mixing.mix(docs(spark, rows), stratum=100)
    assert out.columns == docs(spark, []).columns and out.count() == sum(g["mx_copies"] for g in got)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.planned(docs(spark, ODD)).count() == len(ODD)


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


def test_search_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 24))
    v[700] = v[701] = v[50]  # ties
    rows = [(i, v[i].tolist()) for i in range(1500)] + [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24), (2150, []),
                                                         (None, v[0].tolist()), (2200, [1.0, 2.0]), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, query=F.col("id") % 50 == 0, q_block=8, v_block=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 50))
    hit = 0
    for q, found in got.items():
        best = sorted(((i, cosine(v[q], v[i])) for i in range(1500) if i != q), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        hit += len({i for i, _ in best} & {i for i, _ in found})
        assert all(abs(s - cosine(v[q], v[i])) < 1e-12 for i, s in found) and len(found) == 5
    assert hit >= 0.95 * 5 * len(got)
    assert [i for i, _ in got[50]][:2] == [700, 701]
    assert ann.search(df.limit(0)).count() == 0


def test_token_counts_match_unigram_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer, models
    path = P.path("piece_bpe_32k.model")
    vocab = token_count.load_vocabulary(path)
    tk = Tokenizer(models.Unigram([("<unk>", 0.0)] + vocab, 0, False))

    def truth(t):
        s = token_count.SPACE + t.replace(" ", token_count.SPACE)
        e = tk.encode(s, add_special_tokens=False)
        return sum(len(s[a:b].encode()) if i == 0 else 1 for i, (a, b) in zip(e.ids, e.offsets)) if t else 0

    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n\tthe中é\U0001F600x▁\x00z019") for _ in range(r.randrange(30))) for _ in range(300)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(900, None, None, None), (901, "ab " * 20000, None, None)]
    got = {x["doc_id"]: x["n_tokens"] for x in token_count.counts(docs(spark, rows), path).collect()}
    assert all(got[i] == truth(t or "") for i, t, *_ in rows)


@pytest.mark.parametrize("rows", [ODD + near_dup_rows(), [], [(1, "a <|endoftext|> b", None, "s")]])
def test_packing_covers_every_id_once(spark, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack(docs(spark, rows), length=64, quantum=8, **queries.tokenizer_files()).collect()
    want = Counter()
    for i, t, _, s in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p in {(x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in out if x["doc_id"] == i}:
            if p[3] == len(ids):
                assert zlib.crc32(ids[p[0]:p[0] + p[1]].tobytes()) == p[2]
        want[i] += len(ids)
    have, at = Counter(), defaultdict(list)
    for x in out:
        have[x["doc_id"]] += x["length"]
        at[x["sequence_id"]].append((x["offset"], x["length"], x["source"]))
    assert have == want and sorted(at) == list(range(len(at)))
    for parts in at.values():
        end = 0
        for o, n, _ in sorted(parts, key=lambda p: p[:2]):
            assert o == end
            end += n
        assert end == 64 or end & (end - 1) == 0


def test_packing_by_weights_until_a_source_runs_dry(spark):
    """Windows hold 3 : 1 : 0.5 to a quantum as long as all sources last, and 3 : 0.5
    after the second one is used up."""
    rows = [(i, "some words of a text " * 40, "en", "abc"[i % 3]) for i in range(120)]
    out = packing.pack(docs(spark, rows), length=256, quantum=8, weights={"a": 3, "b": 6, "c": 0.5, None: 2}, **queries.tokenizer_files()).collect()
    assert Counter(i for i, *_ in rows).keys() == {x["doc_id"] for x in out}
    have = defaultdict(Counter)
    for x in out:
        have[x["sequence_id"]][x["source"]] += x["length"]
    total = sum(have.values(), Counter())
    last_b = max(s for s, c in have.items() if c["b"])
    seen = Counter()
    for s in range(len(have)):
        seen.update(have[s])
        n = sum(seen.values())
        if s < last_b - 1:
            assert all(abs(seen[q] - n * w / 9.5) <= 8 for q, w in (("a", 3), ("b", 6), ("c", 0.5))), s
    after = [have[s] for s in range(last_b + 1, len(have)) if have[s]["a"] and sum(have[s].values()) == 256]
    assert after and all(abs(c["a"] / 256 - 3 / 3.5) < 0.1 for c in after[:-1])
    assert total["a"] == total["b"] == total["c"]
    with pytest.raises(ValueError):
        packing.pack(docs(spark, rows), weights={"a": 0}, **queries.tokenizer_files())


def test_turns_are_a_fair_order():
    for sizes, weights in (([5, 0, 9, 2], [3, 7, 1, 1]), ([4, 4], [1, 1]), ([1, 30], [1_000_000, 1]), ([6, 3, 3], None)):
        w = weights or sizes
        due = sorted(((2 * r + 1) / w[q], q, r) for q, n in enumerate(sizes) for r in range(n))
        place = {(q, r): i for i, (_, q, r) in enumerate(due)}
        for q, n in enumerate(sizes):
            if n:
                assert packing.turns(np.arange(n), q, sizes, weights).tolist() == [place[q, r] for r in range(n)]


def test_packing_keeps_the_ids(spark, sf_small):
    """Sequences can be read back: each document's ids, piece by piece."""
    import corpus_pipeline as cp
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    d = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    found = defaultdict(list)
    for x in cp.packed(spark, d, sf_small).collect():
        ids = np.frombuffer(x["ids"], "<u4").tolist()
        assert len(ids) == x["length"] and zlib.crc32(x["ids"]) == x["ids_crc32"]
        found[x["doc_id"]].append((x["start"], ids))
    assert set(found) == set(texts)
    for i, pieces in found.items():
        whole = []
        for start, ids in sorted(pieces):
            assert start == len(whole)
            whole += ids
        assert whole == tk.encode(texts[i] or "", add_special_tokens=False).ids + [0]
    assert queries.op8_packing(spark, sf_small).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_fingerprints_give_the_recovered_digests(spark):
    rows = [(i, ". ".join(" ".join(words(i % 7 * 100 + j, 6)) for j in range(30)), None, None) for i in range(1, 40)] + [(0, None, None, None)]
    texts = {i: t or "" for i, t, *_ in rows}
    signed = lambda d: sorted(d.view(np.int64).tolist())
    for r in iblt.fingerprints(docs(spark, rows)).collect():
        i = r["doc_id"]
        nxt = texts[i - 1 if i else 39]
        own = iblt.paragraphs(texts[i])
        for name, other in (("edited", iblt.edited_text(texts[i], nxt)), ("next", nxt)):
            other = iblt.paragraphs(other)
            assert sorted(r[f"{name}_gone"]) == signed(np.setdiff1d(own, other))
            assert sorted(r[f"{name}_come"]) == signed(np.setdiff1d(other, own))


def test_turns_are_a_fair_order():
    sizes = [5, 1, 13, 0, 7]
    got = {}
    for q in range(5):
        for r, t in enumerate(packing.turns(np.arange(sizes[q]), q, sizes).tolist()):
            got[t] = (q, r)
    assert sorted(got) == list(range(26))
    for t in range(27):  # after t turns each queue is within one quantum of its share
        for q in range(5):
            assert abs(sum(got[i][0] == q for i in range(t)) - t * sizes[q] / 26) <= 1.5
    big = [10 ** 13, 3 * 10 ** 13]
    assert packing.turns(np.array([5]), 0, big)[0] == 5 + (11 * big[1] + big[0] - 1) // (2 * big[0])


def test_fingerprints(spark):
    rows = [(i, ". ".join(" ".join(words(i * 100 + j, 6)) for j in range(30)), None, None) for i in range(1, 60)]
    rows += [(100, rows[0][1], None, None), (101, None, None, None), (101, "again", None, None), (None, "last", None, None)]
    for buckets in (1, 7):
        got = iblt.fingerprints(docs(spark, rows), buckets=buckets).collect()
        order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        want = Counter()
        for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
            want[(i, len(t), hashlib.sha256(iblt.edited_text(t, n).encode()).hexdigest())] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        fp = {r["doc_id"]: r for r in got}
        assert fp[1]["fingerprint"] == fp[100]["fingerprint"] != fp[2]["fingerprint"]
        assert all(0.3 < fp[i]["near_edited"] < 0.7 and fp[i]["near_next"] < 0.2 for i in range(2, 60))
    assert iblt.fingerprints(docs(spark, [])).count() == 0


def test_peeling_recovers_the_difference():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 20, 200):
        a, b = iblt.Print("x"), iblt.Print("x")
        common, mine, theirs = (np.unique(r.integers(1, 1 << 62, n, dtype=np.uint64)) for _ in range(3))
        for p, d in ((a, np.concatenate([common, mine])), (b, np.concatenate([common, theirs]))):
            p.digests = np.unique(d)
            p.hashes = iblt._hashes(p.digests)
            p.cells = iblt.sketch(p.digests, p.hashes, iblt.CELLS)
        x, y = iblt.difference(a, b)
        assert sorted(x.tolist()) == sorted(mine.tolist()) and sorted(y.tolist()) == sorted(theirs.tolist())


def test_scores(spark, sf_small):
    d = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(-1, None), (None, "null id")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in mix_model.score(d, bits=18).collect()}
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    toks = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(low)) + [0] for r in d.collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    count = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in toks.items():
        r = got[i]
        assert r["held_out"] == held[i] and r["n_tokens"] == len(t) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in count for w in t)
        assert abs(r["base_score"] - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert r["score"] < 0 and abs(r["score"] + r["bits"] * math.log10(2)) < 1e-9
    # rare words through the join as through the broadcast
    few = {r["doc_id"]: r["base_score"] for r in mix_model.score(d, bits=12, common=5).collect()}
    assert all(abs(few[i] - got[i]["base_score"]) < 1e-6 for i in got)


def test_model_is_a_distribution():
    hist = np.ones((257, 257), np.int64)
    hist[:, 97:100] = 500
    hist[98, 120] = 9000
    own = np.array([97 * 257 + 98, 98 * 257 + 99])
    triples = np.zeros((2, 257), np.int64)
    triples[0, 120] = 5000
    tree = mix_model.Code(hist, own, triples)
    # every tree is complete: each symbol has a code after each other one, and after the pairs with trees of their own
    assert np.allclose((2.0 ** -tree.size.astype(float)).reshape(257 + 2, 257).sum(1), 1, atol=1e-12)
    x = mix_model.symbols([b"abx", b"b", b""])[0]
    assert tree.tree_of[mix_model.befores(x)].tolist() == [256, 97, 257, 120, 256, 98, 256]
    tables = [np.random.default_rng(m).integers(-100, 100, 1 << 12).astype(np.int8) for m in range(3)]
    # texts that end after a prefix or go on by one byte and end: together under 1
    for prefix in (b"", b"abc"):
        grown = [prefix] + [prefix + bytes([b]) for b in range(256)]
        assert sum(2.0 ** -mix_model.score_bits(grown, tree, tables, 12)) <= 1 + 1e-6
    # texts do not influence each other, whatever their lengths and the block
    texts = [b"abcab" * 60, b"", b"zz" * 400]
    together = mix_model.score_bits(texts, tree, tables, 12)
    assert np.allclose(together, [mix_model.score_bits([t], tree, tables, 12)[0] for t in texts], rtol=1e-5)


def plain_bits(text, code, tables, bits, block=128, rate=0.02):
    """The model bit by bit: what ``score_bits`` does side by side."""
    w = {(g, m): mix_model.START[m] / 16 for g in range(mix_model.GATES) for m in range(3)}
    x, total, grads = [*text, mix_model.END], 0.0, defaultdict(float)
    for i, symbol in enumerate(x):
        before = ([mix_model.END] * 2 + x[:i])[-2:]
        tree = int(code.tree_of[before[0] * 257 + before[1]])
        age = min(i, 6)
        six = np.array([sum(x[i - 1 - k] << 8 * k for k in range(age)) | age << 48], np.uint64)
        slot = [int(c[0]) for c in mix_model.contexts(six, bits)]
        at = int(code.start[tree * 257 + symbol])
        for s in code.step[at:at + int(code.size[tree * 257 + symbol])].tolist():
            node, bit = s >> 1, s & 1
            st = [int(t[c ^ node]) for t, c in zip(tables, slot)]
            sure = [sum(abs(v) > b for b in (8, 24, 56)) for v in st]
            gate = sure[1] * 4 + sure[2]
            z = max(-12.0, min(12.0, sum(w[gate, m] * st[m] for m in range(3))))
            p = 1 / (1 + math.exp(-z))
            total -= math.log2(p if bit else 1 - p)
            for m in range(3):
                grads[gate, m] += (bit - p) * st[m]
        if (i + 1) % block == 0:
            for key, g in grads.items():
                w[key] = max(-0.5 / 16, min(2 / 16, w[key] + rate / 1024 * g))
            grads.clear()
    return total


def test_scores_equal_the_model_bit_by_bit():
    r = np.random.default_rng(5)
    hist = r.integers(0, 50, (257, 257))
    own = np.unique(r.integers(0, 256, 40) * 257 + r.integers(0, 256, 40))
    code = mix_model.Code(hist, own, r.integers(0, 90, (len(own), 257)))
    tables = [r.integers(-120, 121, 1 << 14).astype(np.int8) for _ in range(3)]
    texts = [b"", b"a", bytes(r.integers(0, 256, 700).tolist()), b"the same words, the same words " * 30, "é日本".encode() * 50]
    got = mix_model.score_bits(texts, code, tables, 14)
    assert np.allclose(got, [plain_bits(t, code, tables, 14) for t in texts], rtol=2e-4)


def test_mixing_defined_cases(spark):
    rows = [(1, "a b a"), (1, "a b a"), (2, None), (None, "a c"), (3, ""), (4, "word " * 30_000)]
    df = spark.createDataFrame([(*x, 1, "z", 2.0) for x in rows], "doc_id long, text string, row long, t string, n double")
    got = mix_model.score(df, bits=12).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert mix_model.score(df.limit(0), bits=12).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = mix_model.score(spark.createDataFrame([(held, "no training text")], "doc_id long, text string"), bits=12).first()
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"]) == (0, 0, 0.0) and alone["held_out"]


def test_long_text_costs_no_more_than_its_pieces():
    """Refinement stays stable however long a text grows."""
    r = random.Random(11)
    vocab = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    write = lambda n: " ".join(vocab[min(int(r.paretovariate(0.8)), 3000) - 1] for _ in range(n)).encode()
    bits, train, text = 18, [write(40_000)], write(400_000)
    code = mix_model.Code(np.bincount(mix_model.pairs_of(mix_model.symbols(train)[0]), minlength=257 * 257))
    six, pair, symbol, n = mix_model.distinct(*mix_model.symbols(train))
    of, node, bit, _ = code.expand(code.keys(pair, symbol))
    sums = np.zeros((len(mix_model.ORDERS), 2 << bits), np.uint32)
    for m, context in enumerate(mix_model.contexts(six, bits)):
        np.add.at(sums[m], (context.astype(np.int64)[of] ^ node) << 1 | bit, n.astype(np.uint32)[of])
    tables = mix_model.stretched([s.reshape(-1, 2) for s in sums])
    assert len(text) > 2_000_000
    whole = mix_model.score_bits([text], code, tables, bits)[0]
    pieces = mix_model.score_bits([text[i:i + 4000] for i in range(0, len(text), 4000)], code, tables, bits).sum()
    print("bits a byte", whole / len(text), pieces / len(text))
    assert whole < 1.02 * pieces


def test_pipeline_stages_keep_columns(spark, sf_small, tmp_path):
    import corpus_pipeline as cp
    d = spark.read.parquet(f"{sf_small}/documents.parquet")
    d = d.unionByName(spark.createDataFrame([(10 ** 6, "12 34", None, None, 5), (10 ** 6 + 1, None, None, None, None)], d.schema)) \
        .withColumn("row", F.lit(1))
    n = d.count()
    for i, (name, f) in enumerate(cp.STAGES):
        out = f(spark, d, sf_small)
        if i < len(cp.STAGES) - 1:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        if name == "language":
            assert d.count() == n - 2
    assert d.groupBy("sequence_id").agg(F.sum("length").alias("m")).where("m <> 1024 and log2(m) % 1 <> 0").count() == 0
    empty = spark.createDataFrame([], spark.read.parquet(f"{sf_small}/documents.parquet").schema)
    for _, f in cp.STAGES:
        assert f(spark, empty, sf_small).count() == 0

"""Bulk random checks of the row-level rules against their Python definitions.

Not part of the pytest suite (each check runs thousands of rows in one Spark
job); run after changing a text rule:

    python scripts/fuzz_checks.py [n_rows]

Seeds are fixed, so a reported mismatch is reproducible.
"""
import datetime as dt
import hashlib
import os
import random
import re
import sys
import textwrap
from pathlib import PurePosixPath

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quire.functions import text as T  # noqa: E402
from quire.operators import embed, evaluate, qa, status  # noqa: E402
from quire.session import local_session  # noqa: E402
from test_qa import rules_oracle  # noqa: E402
from test_squad_eval import _f1, _norm  # noqa: E402
from test_text import pack_oracle  # noqa: E402


def _df(spark, values, schema):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], schema).repartition(8)


def check_wrap(spark, n):
    rnd = random.Random(12345)
    alpha = ["a", "bb", "é", "-", "--", "---", " ", "  ", "\t", "\n", "\r", "\x0b", "\x0c", "\xa0",
             "　", "😀", "co-op", "x-y-z", "ab-cd", ".", ",", "?", "!", '"', "'", "&", "1", "_",
             "A" * 25, "-a", "a-"]
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 80))) for _ in range(n)]
    df = _df(spark, [(t,) for t in texts], "id int, text string")
    bad = 0
    for width in (3, 12, 33, 60):
        for r in df.select("id", T.wrap("text", width).alias("w")).collect():
            bad += list(r.w) != textwrap.wrap(texts[r.id], width)
    return bad


def check_rows(spark, n):
    rnd = random.Random(777)
    alpha = ["he", "She", "what", "HOW", "year", "2020", "１２", "²", "city.", "city", "a", "x", "é",
             "Ünï", "!", "?", ".", "...", " ", "  ", "\n", "\t", "\xa0", "　", "word", "Where",
             "people", "month", "12b", "-", "'s", "😀", "ß", "İ", "ǅ", "_", "x" * 60]
    texts = ["".join(rnd.choice(alpha) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 120)))
             for _ in range(n)]
    df = _df(spark, [(t,) for t in texts], "id int, text string")
    rows = df.select("id", T.sentence_pack("text", 80, 10).alias("p"), qa.rule_questions("text").alias("q"),
                     embed.embedding_column("text").alias("e"), qa.parse_questions("text").alias("pq"),
                     T.truncate_tokens("text", 5).alias("tr")).collect()
    bad = 0
    for r in rows:
        t = texts[r.id]
        counts = np.zeros(64)
        for tok in re.findall(r"[^\W_]+", t.lower()):
            counts[int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % 64] += 1
        want_e = (counts / np.sqrt((counts ** 2).sum())).astype(np.float32) if counts.any() else counts
        bad += list(r.p) != pack_oracle(t, 80, 10)
        bad += list(r.q) != rules_oracle(t)
        bad += not np.allclose(np.array(r.e), want_e, atol=1e-7)
        bad += list(r.pq) != [s.strip() for s in t.split("\n") if s.strip()][:3]
        bad += r.tr != " ".join(t.split()[:5])
    return bad


def check_em_f1(spark, n):
    rnd = random.Random(99)
    alpha = ["a", "an", "the", "The", "A", "é", "à", "ß", "x", "cat", "déa", "l", "'", "’", "«", "-", ".",
             ",", "!", " ", " ", "\n", "\xa0", "_", "1", "²", "İ", "😀", "n"]

    def txt():
        return "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 25)))
    pairs = [(txt(), txt()) for _ in range(n)]
    df = _df(spark, [(str(i), p, g) for i, (p, g) in enumerate(pairs)],
             "i int, id string, prediction_text string, answer_text string")
    bad = 0
    for r in evaluate.score_pairs(df).collect():
        p, g = pairs[int(r.id)]
        bad += r.em != float(_norm(p) == _norm(g)) or abs(r.f1 - _f1(p, g)) > 1e-12
    return bad


def check_paths(spark, n):
    rnd = random.Random(5)
    parts = ["a", "b", ".", "..", "x.tar", ".gz", "é", "dir", "UP.PDF", " ", "a.b.c", ".hidden", "file.",
             "😀", "-", "n1", "/", "//"]
    paths = ["/".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3)))
                      for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    df = _df(spark, [(p,) for p in paths], "id int, p string")
    bad = 0
    for r in df.select("id", T.basename("p").alias("b"), T.suffix("p").alias("s"), T.stem("p").alias("st")).collect():
        pp = PurePosixPath(paths[r.id])
        bad += (r.b, r.s, r.st) != (os.path.basename(paths[r.id]), pp.suffix, pp.stem)
    return bad


def check_answers(spark, n):
    rnd = random.Random(21)
    words = ["cat", "Dog", "ÉTÉ", "été", "ß", "SS", "İ", "i", "the", "2020", "²", "x_y", "a-b", "don't", "😀", "ǅ"]
    seps = [" ", ". ", "! ", "?", "...", "\n", " \xa0", ", ", "."]
    pairs = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))) + "?",
              "".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(0, 30))))
             for _ in range(n)]
    df = _df(spark, pairs, "id int, q string, c string")
    best = qa.best_sentence(F.col("q"), qa.sentence_index("c"))
    bad = 0
    for r in df.select("id", best.alias("b"), qa.answer_offset(best["answer"], F.col("c")).alias("o")).collect():
        q, c = pairs[r.id]
        sents = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", c) if s.strip()]
        qt = set(re.findall(r"[^\W_]+", q.lower()))
        sc = [len(qt & set(re.findall(r"[^\W_]+", s.lower()))) for s in sents]
        ans, ov = (sents[sc.index(max(sc))], max(sc)) if sc else ("", 0)
        bad += (r.b.answer, r.b.overlap, r.o) != (ans, ov, c.find(ans))
    return bad


def check_iso(spark, n):
    rnd = random.Random(3)
    ts = [dt.datetime(rnd.randint(1, 9999), rnd.randint(1, 12), rnd.randint(1, 28), rnd.randint(0, 23),
                      rnd.randint(0, 59), rnd.randint(0, 59), rnd.choice([0, rnd.randint(0, 999999)]))
          for _ in range(n)]
    df = _df(spark, [(t,) for t in ts], "id int, ts timestamp_ntz")
    return sum(r.s != ts[r.id].isoformat() for r in df.select("id", status.iso_timestamp("ts").alias("s")).collect())


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3000
    spark = local_session()
    total = 0
    for name, fn in [("wrap", check_wrap), ("pack/rules/embed/parse/truncate", check_rows),
                     ("em_f1", check_em_f1), ("paths", check_paths), ("answers", check_answers),
                     ("iso", check_iso)]:
        bad = fn(spark, n)
        total += bad
        print(f"{name:34s} mismatches={bad}", flush=True)
    print("ALL OK" if total == 0 else "MISMATCHES FOUND")


if __name__ == "__main__":
    main()

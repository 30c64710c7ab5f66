"""Word wrap and sentence packing in linear time, equal to their definitions."""

from __future__ import annotations

import random
import re
import textwrap
import time

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.breaks import line_offsets, pack_sentences, wrap_lines

PARTS = ["a", "bb", "word", "-", "--", "---", "é-è", "co-op", "x" * 9, "y-z" * 6, " ", "  ", "\t", "\n", "\x0b", "\x85", " ", "　",
         "a--b", "?--x", "'-'", "--" * 8, "😀", "1-2", "ab-1"]


def test_offsets_equal_the_standard_wrapper():
    r = random.Random(1)
    for _ in range(4000):
        text = "".join(r.choice(PARTS) + (" " if r.random() < .4 else "") for _ in range(r.randrange(25)))
        for width in (1, 2, 3, 7, 12, 30):
            assert wrap_lines(text, width) == textwrap.wrap(text, width), (text, width)


def _packed(text, max_length, min_length):
    chunks, cur = [], ""
    for s in (x.strip() for x in re.split("[.!?]+", text)):
        if not s:
            continue
        if len(cur) + len(s) < max_length:
            cur += s + ". "
        else:
            chunks += [cur.strip()] if cur else []
            cur = s + ". "
    chunks += [cur.strip()] if cur else []
    return [c for c in chunks if len(c) > min_length]


def test_packing_equals_its_definition(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["word", "é", "x" * 40, " ", "  ", "\n", ". ", "!? ", "...", "　"]) for _ in range(r.randrange(60)))
             for _ in range(400)]
    for text in texts:
        for limits in ((30, 5), (60, 0), (512, 50)):
            assert pack_sentences(text, *limits) == _packed(text, *limits)
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, text string").repartition(2)
    got = {r.k: r.c for r in df.select("k", T.sentence_pack("text", 60, 5).alias("c")).collect()}
    assert got == {-1: None} | {i: _packed(t, 60, 5) for i, t in enumerate(texts)}


def test_wrapping_time_is_linear():
    """A text of 20 MB takes little more than ten times one of 2 MB, one endless word
    included."""
    for unit in ("some words - here, ", "x", "ab-"):
        took = []
        for size in (2_000_000, 20_000_000):
            text = unit * (size // len(unit))
            start = time.perf_counter()
            lines = line_offsets(text, 500)
            took.append(time.perf_counter() - start)
            assert lines[0][0] == 0 and lines[-1][1] == len(text.rstrip())
        assert took[1] < 25 * took[0] + 1, (unit, took)


def test_long_documents_through_spark(spark):
    long = [(1, "Some words, of a sentence. " * 740_000), (2, "x" * 5_000_000 + " tail-end of it"), (3, "a. " * 100)]
    df = spark.createDataFrame(long, "k int, text string").repartition(3)
    got = {r.k: r for r in df.select("k", F.size(T.wrap("text", 500)).alias("lines"), F.size(T.sentence_pack("text")).alias("chunks")).collect()}
    assert got[2].lines == 10_001 and got[3].lines == 1
    assert got[1].lines == len(textwrap.wrap(long[0][1], 500))
    # a sentence counts 25 characters and a separator of 2: chunks of 19, the 20th does not fit
    sizes, cur = 0, 0
    for _ in range(740_000):
        if cur + 25 < 512:
            cur += 27
        else:
            sizes, cur = sizes + 1, 27
    assert got[1].chunks == sizes + 1

"""Secret scans with Spark expressions only (no Python on the data path).

Base kinds are regular expressions; a match's place is the running length of
the pieces between and the matches before it, counted in code points.

    assign   (password|passwd|secret|token|api_?key) in either case, an optional
             quote, spaces, : or =, spaces, an optional quote, a value of 8+
    access   AKIA and capitals or digits, 16+ in all
    hex      0-9 a-f, 32+

The method adds ``entropy`` spans.  Candidates are maximal runs of at least
``window`` characters of A-Za-z0-9+/_- with a digit, and up to two = after them.
Each is put in its character class (hexadecimal, alphanumeric, base64), and a window
slides over it: the counts of the characters inside, six numbers of twelve counts
each, change by the one that enters and the one that leaves, and so does the sum of
c log2 c, from which the window's Shannon entropy is log2(w) - sum / w.  A step
takes the same few operations however long the candidate is.  The span runs from the
first window at or above the class's threshold to the end of the last one.

The allow-list: a window that touches one of its words does not count, so that a
word beside a secret suppresses only itself; a candidate that as a whole has the
form of a known harmless one (a UUID, a path) is left out.  A span inside a base span
is not added.

Defined cases: null text is empty; a text without findings has counts 0, empty
``spans`` and the digest of the empty string; repeated rows are scanned each; an
empty table gives an empty result; texts are scanned whole, in time near-linear in
their length, findings and candidates; other columns, whatever their names, come
back as they were; spans of equal start go in the order of kinds above, then by end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}"
KINDS = ("assign", "access", "hex", "entropy")

#: Class of a candidate, its pattern and the entropy (bits) a window must reach.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[0-9A-Za-z]+$", 3.6), ("base64", r"", 3.7))
#: Words whose characters no window may touch (in either case), and forms of whole candidates.
ALLOW_WORDS = ("placeholder", "changeme", "example", "sample", "dummy", "xxxx", "0123456789", "abcdefghij")
ALLOW_FORMS = (r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
               r"^/?(?:[a-z]+/)+[a-z_-]*[0-9]{0,4}$")
#: Every character a candidate can hold; a character's counts are CELL bits wide, PER to a number.
ALPHABET = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_=-"
CELL, PER = 5, 12
#: c log2 c is summed in units of 2**-40, without drift.
UNIT = 1 << 40

_SPAN = "array<struct<start:long,kind:int,end:long,hit:string>>"


def _located(text: Column, regex: str, kind: int) -> Column:
    """array<struct<start, kind, end, hit>> of all matches, leftmost first.
    The fold goes over blocks of 256 matches so that its cost stays near-linear
    in very long texts."""
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                       lambda g, h: F.struct(F.length(g).cast("long").alias("g"), h.alias("h")))
    block = 256

    def inner(acc, p):
        start = acc["pos"] + p["g"]
        end = start + F.length(p["h"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["h"].alias("hit"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    def fold(pos, part):
        zero = F.struct(pos.alias("pos"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(part, zero, inner)

    def outer(acc, b):
        part = fold(acc["pos"], F.slice(pairs, b * block + 1, F.lit(block)))
        return F.aggregate(F.array(part), acc, lambda a, r: F.struct(
            r["pos"].alias("pos"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / block).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    none = F.array().cast(_SPAN)
    return F.when(F.size(hits) == 0, none).otherwise(F.flatten(F.aggregate(blocks, start, outer)["out"]))


def _hot(run: Column, window: int, words) -> Column:
    """struct<a, b>: start of the first and of the last window of ``run`` whose
    entropy reaches its class's threshold (a = -1: none)."""
    if not 1 <= window < 1 << CELL:
        raise ValueError(f"window must be at most {(1 << CELL) - 1}")
    clogc = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0) for c in range(window + 2)])
    numbers = range(-(-len(ALPHABET) // PER))

    def most(bits):  # the greatest sum at which the entropy still reaches ``bits``
        return F.lit(math.floor(window * (math.log2(window) - bits + 1e-9) * UNIT))

    limit = most(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        limit = F.when(run.rlike(pattern), most(bits)).otherwise(limit)
    masked = run
    for word in words:
        masked = F.regexp_replace(masked, "(?i)" + word, "\x01" * len(word))
    # a character's place in the alphabet, from 1; 0 for one of an allowed word
    places = F.transform(F.regexp_extract_all(masked, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))

    def slide(places, limit):
        def count(acc, place):
            held = F.element_at(F.array(*[acc[f"n{j}"] for j in numbers]), F.floor((place - 1) / PER).cast("int") + 1)
            return F.call_function("shiftright", held, (place - 1) % PER * CELL).bitwiseAND(F.lit((1 << CELL) - 1)).cast("int")

        def one(place, j):  # what a character adds to the number ``j``
            return F.when(F.floor((place - 1) / PER) == j, F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1) % PER * CELL)) \
                .otherwise(F.lit(0).cast("long"))

        def step(acc, into):
            i = acc["i"] + 1
            out = F.when(i > window, F.element_at(places, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            same = into == out
            c_in, c_out = count(acc, F.greatest(into, F.lit(1))), count(acc, F.greatest(out, F.lit(1)))
            enters = F.when(~same & (into > 0), clogc[c_in + 1] - clogc[c_in]).otherwise(F.lit(0).cast("long"))
            leaves = F.when(~same & (out > 0), clogc[F.greatest(c_out, F.lit(1))] - clogc[F.greatest(c_out - 1, F.lit(0))]) \
                .otherwise(F.lit(0).cast("long"))
            total = acc["s"] + enters - leaves
            clear = F.when(into > 0, acc["clear"] + 1).otherwise(F.lit(0))
            hit = (clear >= window) & (total <= limit)
            at = i - window
            numbers_now = [(acc[f"n{j}"] + F.when(~same & (into > 0), one(into, j)).otherwise(F.lit(0).cast("long"))
                            - F.when(~same & (out > 0), one(out, j)).otherwise(F.lit(0).cast("long"))).alias(f"n{j}") for j in numbers]
            return F.struct(*numbers_now, total.alias("s"), clear.alias("clear"), i.alias("i"),
                            F.when(hit & (acc["a"] < 0), at).otherwise(acc["a"]).alias("a"),
                            F.when(hit, at).otherwise(acc["b"]).alias("b"))

        zero = F.struct(*[F.lit(0).cast("long").alias(f"n{j}") for j in numbers], F.lit(0).cast("long").alias("s"), F.lit(0).alias("clear"),
                        F.lit(0).alias("i"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))
        return F.aggregate(places, zero, step, lambda acc: F.struct(acc["a"].alias("a"), acc["b"].alias("b")))

    return let(F.struct(places.alias("p"), limit.alias("l")), lambda x: slide(x["p"], x["l"]))


def _key(x: Column) -> Column:
    return F.transform(x, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))


def scan(df: DataFrame, text: str = "text", *, window: int = 20, allow_words=ALLOW_WORDS, allow_forms=ALLOW_FORMS) -> DataFrame:
    """struct column ``sc_row`` (the row as it came), ``sc_text`` (null: empty),
    ``sc_base`` and ``sc_all``: arrays of struct<start, kind, end, hit> in order."""
    x = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("sc_row"),
                  F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("sc_text"))
    t, none = F.col("sc_text"), F.array().cast(_SPAN)
    # the fixed parts of a kind are looked for first, so that most texts stop there
    low = F.lower(t)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "api"):
        named = named | low.contains(word)
    some = {"assign": named, "access": t.contains("AKIA"),
            "run": t.rlike(RUN % min(window, 32))}
    assign = F.filter(_located(t, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 8)
    access = F.filter(_located(t, ACCESS, 1), lambda s: s["end"] - s["start"] >= 16)
    # a hex match of 32+ is what [0-9a-f]+ finds, less its short matches
    hexes = _located(t, r"(?<![0-9a-f])[0-9a-f]{32,}+", 2)
    runs = F.filter(_located(t, RUN % window, 3), lambda s: s["hit"].rlike("[0-9]"))
    x = x.withColumn("sc_a", F.when(some["assign"], assign).otherwise(none))
    x = x.withColumn("sc_k", F.when(some["access"], access).otherwise(none))
    x = x.withColumn("sc_h", F.when(t.rlike("[0-9a-f]{32}"), hexes).otherwise(none))
    x = x.withColumn("sc_r", F.when(some["run"], runs).otherwise(none))
    base = F.concat("sc_a", "sc_k", "sc_h")
    x = x.withColumn("sc_base", F.when(F.size(base) > 0, F.array_sort(base)).otherwise(none))
    measured = F.transform(F.filter("sc_r", lambda s: ~_any(s["hit"], allow_forms)),
                           lambda s: F.struct(s.alias("s"), _hot(s["hit"], window, allow_words).alias("w")))
    found = F.transform(F.filter(measured, lambda m: m["w"]["a"] >= 0), lambda m: F.struct(
        (m["s"]["start"] + m["w"]["a"]).alias("start"), F.lit(3).alias("kind"),
        (m["s"]["start"] + m["w"]["b"] + window).alias("end"), m["s"]["hit"].alias("hit")))
    x = x.withColumn("sc_e", F.when(F.size("sc_r") > 0, found).otherwise(none))
    added = F.filter("sc_e", lambda e: ~F.exists("sc_base", lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    x = x.withColumn("sc_all", F.when(F.size("sc_e") > 0, F.array_sort(F.concat("sc_base", added))).otherwise(F.col("sc_base")))
    return x.select("sc_row", "sc_text", "sc_base", "sc_all")


def _any(value: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    x = scan(df, text, **options)
    n = lambda k: F.size(F.filter("sc_all", lambda s: s["kind"] == k)).cast("long")
    return x.select(F.col(f"sc_row.`{doc_id}`").alias(doc_id), n(0).alias("n_assign"), n(1).alias("n_access"),
                    n(2).alias("n_hex"), n(3).alias("n_entropy"),
                    F.sha2(F.concat_ws(",", _key(F.col("sc_base"))).cast("binary"), 256).alias("base_sha256"),
                    F.concat_ws(",", _key(F.col("sc_all"))).alias("spans"))


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", length: str | None = None, **options) -> DataFrame:
    """``df`` with every span replaced by ``mask``; overlapping spans become one.
    Texts without findings, null among them, stay as they are.  ``length`` names
    a column that holds the text's code points and follows the new text."""
    x = scan(df, text, **options)
    t, block = F.col("sc_text"), 256

    def cut(piece, base, spans):
        """``piece`` (which starts at ``base``) with its spans masked."""
        def step(acc, s):
            kept = F.substr(piece, (acc["pos"] - base + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
            fresh = s["start"] >= acc["pos"]
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                            F.when(fresh, F.concat(acc["out"], F.array(F.concat(kept, F.lit(mask))))).otherwise(acc["out"]).alias("out"))
        start = F.struct(base.alias("pos"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(spans, start, step, lambda acc: F.concat_ws("", acc["out"]))

    def outer(acc, b):
        # the text of 256 spans is taken out once; what lies before it is not scanned for each span
        spans = F.filter(F.slice("sc_all", b * block + 1, F.lit(block)), lambda s: s["end"] > acc["pos"])
        end = F.greatest(acc["pos"], F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), acc["pos"]))
        piece = F.substr(t, (acc["pos"] + 1).cast("int"), (end - acc["pos"]).cast("int"))
        made = let(F.struct(piece.alias("t"), spans.alias("s")), lambda p: cut(p["t"], acc["pos"], p["s"]))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(made)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("sc_all") - 1) / block).cast("int"))
    clean = F.aggregate(blocks, start, outer, lambda acc: F.concat(
        F.concat_ws("", acc["out"]), F.substr(t, (acc["pos"] + 1).cast("int"), F.length(t))))
    x = x.withColumn("sc_new", F.when(F.size("sc_all") > 0, clean).otherwise(F.col(f"sc_row.`{text}`").cast("string")))
    out = []
    for c in df.columns:
        old = F.col(f"sc_row.`{c}`")
        if c == text:
            old = F.col("sc_new")
        elif c == length:
            old = F.when(F.size("sc_all") > 0, F.length("sc_new").cast(df.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return x.select(*out)

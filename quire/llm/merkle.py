"""Merkle manifest of a dataset as a persistent, path-copying tree.

H is the lowercase hex sha256 of its inputs put one after another, digests as hex
text.  A row's leaf is H of its fields, each ``-`` if null, else its UTF-8 byte
count, a colon and its value.  The leaves of a tree (one per value of the tree
column) stand by key; every two nodes side by side, the last of an odd number
alone, become their H until one is left, the tree's subroot.  The subroots, by
the tree column's value (null first, bytewise), become the root in the same way.

Distributed: a leaf's position comes from a range sort (``number_within``), never
from a window over a tree.  Positions are cut into aligned blocks of ``2**BITS``;
a block's nodes are computed in one task from its members alone and stored as
one row (members, inner nodes, top).  The tops are the members of the next tier
of blocks, until every tree has a single node.  A tier is 256 times smaller than
the one below, and no join key holds more than a block's members.

Versions: a tampered leaf makes a version of the tree.  It copies the leaf's
ancestors inside its block, then those of the upper tiers, and shares every other
node (``proofs`` gives the copies, deepest first, the last one being the
version's root; ``version_nodes`` lists them with level and index).  All siblings
of a block's top stand once in the paths of the tier above and are joined to the
block, so the copies of all versions below a block go on there.

Defined cases: rows that share a key are leaves each, in the order of their
digests; a null key stands first; a null field is ``-``; an empty table has no
rows; a tree of one leaf has it as its subroot; texts are hashed whole; extra
columns are left alone, as only the named fields are read.  A field that is null
stays so when tampered with.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lean, require
from quire.operators.positions import number_within
from quire.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels of a block: 256 members.
BITS = 8


class Manifest(NamedTuple):
    """tiers: the trees' blocks, lowest first; top: the blocks over the subroots;
    root: hex digest, None for an empty table."""
    tiers: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]).cast("binary"), 256))


def leaves(docs: DataFrame, key: str, tree: str, fields=FIELDS, changed: dict[str, Column] | None = None,
           where: Column | None = None) -> DataFrame:
    """key, tree, digest and, where ``where`` holds, the digest with ``changed``
    fields (null elsewhere, and where nothing would change)."""
    require(docs, key, tree, *fields)
    plain = [F.col(f) for f in fields]
    other = F.lit(None).cast("binary")
    if changed:
        new = [changed.get(f, F.col(f)) for f in fields]
        moves = [~c.cast("string").eqNullSafe(F.col(f).cast("string")) for f, c in changed.items()]
        touched = where if where is not None else F.lit(True)
        for m in moves[1:]:
            moves[0] = moves[0] | m
        other = F.when(touched & moves[0], leaf_digest(new))
    name = F.col(tree).cast("string")
    # "-" sorts before "=": the null tree stands first
    return docs.select(F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("tree"),
                       leaf_digest(plain).alias("digest"), other.alias("changed"))


def depth(size: int) -> int:
    """Levels that a block adds in a tree of ``size`` nodes at its tier."""
    return BITS if size > 1 << BITS else max(0, size - 1).bit_length()


def hashed(*parts: bytes) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def levels(members: list[bytes], up: int) -> list[list[bytes]]:
    """The members and the levels above them, the top last."""
    out = [members]
    for _ in range(up):
        now = out[-1]
        out.append([hashed(*now[i:i + 2]) for i in range(0, len(now), 2)])
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per block of (key, tree, pos, size, digest, changed) rows."""
    kind = nodes.schema["key"].dataType.simpleString()
    rows = nodes.groupBy("tree", "size", F.shiftright("pos", BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "key", "digest", "changed"))).alias("m"))
    rows = rows.select("tree", "size", "block", F.col("m.key").alias("keys"), F.col("m.digest").alias("digests"),
                       F.col("m.changed").alias("changed"))

    def run(batches):
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            inner, tops = [], []
            for size, digests in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                made = levels(digests, depth(size))
                inner.append([n for level in made[1:] for n in level])
                tops.append(made[-1][0])
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(inner, pa.list_(pa.binary())), pa.array(tops, pa.binary())],
                names=batch.schema.names + ["inner", "top"])

    return rows.mapInArrow(lean(run), f"tree string, size long, block long, keys array<{kind}>, digests array<binary>, "
                                      "changed array<binary>, inner array<binary>, top binary")


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """The tiers over ``nodes``, lowest first; in the last one a block is a tree."""
    tiers = []
    while True:
        tier = materialize(_blocks(nodes), "merkle-tier")
        tiers.append(tier)
        more = tier.agg(F.max("size").alias("m")).first()["m"]
        if more is None or more <= 1 << BITS:
            return tiers
        width = 1 << BITS
        kind = tier.schema["keys"].dataType.elementType.simpleString()
        nodes = tier.select(F.lit(None).cast(kind).alias("key"), "tree", F.col("block").alias("pos"),
                            F.when(F.col("size") > width, F.shiftright(F.col("size") + (width - 1), BITS)).otherwise(1).alias("size"),
                            F.col("top").alias("digest"), F.lit(None).cast("binary").alias("changed"))


def _path(made: list[list[bytes]], at: int) -> list[bytes]:
    """Siblings of a member inside its block: side (L or R) and digest, empty where
    the run has no other."""
    out = []
    for level in made[:-1]:
        other = at ^ 1
        out.append((b"L" if other < at else b"R") + level[other] if other < len(level) else b"")
        at >>= 1
    return out


def climb(digest: bytes, path: list[bytes]) -> list[bytes]:
    """The ancestors of a node along its siblings, the root last."""
    out = []
    for sibling in path:
        if not sibling:
            digest = hashed(digest)
        elif sibling[:1] == b"L":
            digest = hashed(sibling[1:], digest)
        else:
            digest = hashed(digest, sibling[1:])
        out.append(digest)
    return out


def _members(blocks: DataFrame, leaf: bool) -> DataFrame:
    """Blocks with ``above`` (siblings of the top up to the root) and ``subroot``
    to their members with whole paths; for leaves, also copies and folded."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    cols = ["tree", "size", "block", "keys", "digests", "changed", "above", "subroot"]
    extra = ", changed binary, copies array<binary>, folded binary, proof binary" if leaf else ""

    def run(batches):
        for batch in (whole.slice(at, 4) for whole in batches for at in range(0, whole.num_rows, 4)):
            out: list[list] = [[] for _ in range(10 if leaf else 6)]
            key_type = batch.schema.field(3).type.value_type
            for tree, size, block, keys, digests, changed, above, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                made = levels(digests, depth(size))
                for at, (key, digest, other) in enumerate(zip(keys, digests, changed)):
                    path = _path(made, at) + above
                    row = [tree, (block << BITS) + at, key, digest, path, subroot]
                    if leaf:
                        up = climb(other or digest, path)
                        row += [other, up if other else None, up[-1] if up else other or digest,
                                hashed(*(s[1:] for s in path if s))]
                    for c, v in zip(out, row):
                        c.append(v)
            some, many = pa.binary(), pa.list_(pa.binary())
            kinds = [pa.string(), pa.int64(), key_type, some, many, some, some, many, some, some]
            names = ["tree", "pos", "key", "digest", "path", "subroot", "changed", "copies", "folded", "proof"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names[:len(out)])

    return blocks.select(*cols).mapInArrow(
        lean(run), f"tree string, pos long, key {kind}, digest binary, path array<binary>, subroot binary{extra}")


def _descend(tiers: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """Members of the lowest tier with their paths; ``above`` holds (tree, above,
    subroot) of each tree, None for the topmost tree of all."""
    leaf = above is not None
    none = F.array().cast("array<binary>")
    if above is None:
        over = tiers[-1].withColumn("above", none).withColumn("subroot", F.lit(None).cast("binary"))
    else:
        over = tiers[-1].join(above, "tree")
    for tier in reversed(tiers[:-1]):
        got = materialize(_members(over, False), "merkle-paths")
        over = tier.join(got.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot"),
                         ["tree", "block"])
    return _members(over, leaf)


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields=FIELDS,
             changed: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The stored tree of ``docs``; ``changed`` (and ``where``) say which leaves
    are tampered with, and how."""
    made = materialize(leaves(docs, key, tree, fields, changed, where), "merkle-leaves")
    numbered = number_within(made, ["tree"], ["key", "digest"], "pos", "size", "merkle-sorted")
    tiers = _grow(numbered)
    heads = tiers[-1].select(F.col("tree").alias("key"), F.lit("").alias("tree"), F.col("top").alias("digest"),
                             F.lit(None).cast("binary").alias("changed"))
    top = _grow(number_within(heads, ["tree"], ["key"], "pos", "size", "merkle-subroots"))
    root = top[-1].select(F.hex("top").alias("top")).first()
    return Manifest(tiers, top, root["top"].lower() if root else None)


def proofs(m: Manifest) -> DataFrame:
    """One row per leaf: tree, pos, key, digest, path (siblings up to the root),
    subroot, changed (the tampered digest), copies (its version's new nodes, the
    version's root last), folded (root recomputed from the tampered, else the
    original leaf), proof (H of the siblings); digests as 32 bytes."""
    subs = _descend(m.top, None)
    above = subs.select(F.col("key").alias("tree"), F.col("path").alias("above"), F.col("digest").alias("subroot"))
    return _descend(m.tiers, materialize(above, "merkle-above"))


def version_nodes(leaf_rows: DataFrame) -> DataFrame:
    """The nodes that each version does not share with the base tree: key (of the
    tampered leaf), pos, level (0: the leaf; the root's is the highest), digest."""
    return leaf_rows.where("changed is not null").select(
        "tree", "key", "pos", F.posexplode(F.concat(F.array("changed"), "copies")).alias("level", "digest"))

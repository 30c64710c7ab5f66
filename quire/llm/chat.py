"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn, adjacent
turns of one role become one block (array aggregation), and the blocks are
concatenated by this template:

    <s>[role] text [/role]</s>            one turn
    <s>[role] text [|] text [/role]</s>   adjacent turns of that role

Inside roles and texts the five characters & < > [ ] are put as &amp; &lt; &gt;
&#91; &#93;.  No text can then hold a piece of a control string, and reading back
is exact: split at the control strings, then put the characters back.

The loss mask is a list of runs (code points, masked) that covers the formatted
string from its start; the masked runs are the texts of the target role.

Defined cases: a null text or role is empty; ties of turn go by role, then text;
null turns come first; repeated rows are turns of their own; rows of a null id
form one conversation; an empty table gives an empty result.  A conversation's
string is one value, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.llm.common import require

#: Characters that control strings are made of, and what stands for them.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"))
OPEN, AFTER_ROLE, BETWEEN, BEFORE_END, CLOSE = "<s>[", "] ", " [|] ", " [/", "]</s>"


def escape(c: Column) -> Column:
    for plain, put in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(put))
    return c


def unescape(c: Column) -> Column:
    for plain, put in reversed(ESCAPES):
        c = F.replace(c, F.lit(put), F.lit(plain))
    return c


def _blocks(turns: Column) -> Column:
    """array<array<turn>>: runs of adjacent turns of one role."""
    n = F.size(turns)
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    after = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(n + 1))
    return F.zip_with(first, after, lambda a, b: F.slice(turns, a, b - a))


def formatted(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text", target: str = "assistant") -> DataFrame:
    """conv_id, formatted (one string per conversation) and loss_mask:
    array<struct<chars, masked>>."""
    require(df, conv_id, turn, role, text)
    x = df.select(F.col(conv_id).alias("id"), F.struct(
        F.col(turn).alias("turn"), escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")).alias("t"))
    x = x.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    x = x.select("id", _blocks(F.col("turns")).alias("blocks"))

    def written(b):
        r = b[0]["role"]
        return F.concat(F.lit(OPEN), r, F.lit(AFTER_ROLE), F.array_join(F.transform(b, lambda t: t["text"]), BETWEEN),
                        F.lit(BEFORE_END), r, F.lit(CLOSE))

    def run(chars, masked):
        return F.struct(chars.cast("long").alias("chars"), masked.alias("masked"))

    def runs(b):
        r = b[0]["role"]
        head = F.lit(len(OPEN + AFTER_ROLE)) + F.length(r)
        tail = F.lit(len(BEFORE_END + CLOSE)) + F.length(r)
        inner = F.flatten(F.transform(b, lambda t, i: F.array(
            run(F.when(i == 0, head).otherwise(F.lit(len(BETWEEN))), F.lit(False)),
            run(F.length(t["text"]), r == escape(F.lit(target))))))
        return F.concat(inner, F.array(run(tail, F.lit(False))))

    return x.select(F.col("id").alias(conv_id), F.array_join(F.transform("blocks", written), "").alias("formatted"),
                    F.flatten(F.transform("blocks", runs)).alias("loss_mask"))


def read_back(formatted_col: Column | str) -> Column:
    """array<struct<role, text>> of the turns, from the formatted string alone."""
    f = F.col(formatted_col) if isinstance(formatted_col, str) else formatted_col
    blocks = F.filter(F.split(f, "\\Q" + CLOSE + "\\E", -1), lambda b: b != "")

    def turns_of(b):
        role = F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), AFTER_ROLE, 1)
        at = F.lit(len(OPEN + AFTER_ROLE)) + F.length(role)
        size = F.length(b) - at - F.length(role) - F.lit(len(BEFORE_END))
        texts = F.split(F.substr(b, at + 1, size), "\\Q" + BETWEEN + "\\E", -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def under_mask(formatted_col: Column | str, mask: Column | str) -> Column:
    """The text of the masked runs, control strings put back, in order.  The string
    is cut block by block of 256 runs, so that a run's text is looked for in its
    block and not from the string's start."""
    f, runs = (F.col(c) if isinstance(c, str) else c for c in (formatted_col, mask))
    block = 256

    def inner(piece, part):
        def step(acc, r):
            text = F.substr(piece, (acc["pos"] + 1).cast("int"), r["chars"].cast("int"))
            return F.struct((acc["pos"] + r["chars"]).alias("pos"),
                            F.when(r["masked"], F.concat(acc["out"], F.array(text))).otherwise(acc["out"]).alias("out"))
        zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(part, zero, step, lambda acc: F.array_join(acc["out"], ""))

    def outer(acc, b):
        part = F.slice(runs, b * block + 1, F.lit(block))
        size = F.aggregate(part, F.lit(0).cast("long"), lambda n, r: n + r["chars"])

        def cut(x):
            made = let(F.substr(f, (acc["pos"] + 1).cast("int"), x["size"].cast("int")), lambda piece: inner(piece, x["part"]))
            return F.struct((acc["pos"] + x["size"]).alias("pos"), F.concat(acc["out"], F.array(made)).alias("out"))
        return let(F.struct(part.alias("part"), size.alias("size")), cut)

    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(runs) - 1) / block), F.lit(0)).cast("int"))
    return unescape(F.aggregate(blocks, zero, outer, lambda acc: F.array_join(acc["out"], "")))


def digest(x: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What reading back a table of ``formatted`` gives: the turns, and the text under
    the loss mask, and their digests."""
    x = x.select(conv_id, "formatted", read_back("formatted").alias("turns"), under_mask("formatted", "loss_mask").alias("loss"))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(conv_id, F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(all_text.cast("binary"), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))

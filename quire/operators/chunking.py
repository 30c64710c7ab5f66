"""Page assembly, chunking and training windows.

Chunkers are row-local: each document row is folded into an array of chunks
and ``posexplode``d, so ordinals come for free and nothing is shuffled.  Page
assembly takes one exchange; windows with answers are a narrow Arrow map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def wrap_chunks(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
                width: int = 500, keep: Sequence[str] = ()) -> DataFrame:
    """Fixed-width word wrap -> ``(*id_cols, *keep, chunk_no, text)``."""
    return T.explode_indexed(docs, [*id_cols, *keep], T.wrap(text_col, width), "chunk_no", "text")


def sentence_chunks(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
                    max_length: int = 512, min_length: int = 50,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Sentence split and greedy pack -> ``(*id_cols, chunk_no, text)``;
    ordinals count the kept chunks only."""
    return T.explode_indexed(docs, [*id_cols, *keep], T.sentence_pack(text_col, max_length, min_length),
                             "chunk_no", "text")


def assemble_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text",
                   sep: str = "") -> DataFrame:
    """Pages -> one text per document, in page order, joined by ``sep``
    (null texts count as empty; pages of one number go by their text).

    One exchange deals the pages out by document; each partition is sorted by
    (document, page), so a task meets a document's pages one after the other and
    joins them as they pass.  Only the document at hand is held.  A null document
    id is a document of its own.
    """
    kind = pages.schema[doc_col].dataType.simpleString()
    rows = pages.select(F.col(doc_col).alias("_doc"), F.col(page_col).alias("_pg"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_t")) \
        .repartition("_doc").sortWithinPartitions("_doc", "_pg", "_t").select("_doc", "_t")

    def run(batches):
        import pyarrow as pa
        docs, texts, counts, held, size = [], [], [], [], 0
        open_doc = None  # a one-element list: the document at hand

        def made():
            return pa.RecordBatch.from_arrays([pa.array(docs, kind_of), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                              names=[doc_col, "text", "n_pages"])

        def close():
            docs.append(open_doc[0])
            texts.append(sep.join(held))
            counts.append(len(held))

        kind_of = pa.null()
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if open_doc is None or open_doc[0] != doc:
                    if open_doc is not None:
                        close()
                        size += len(texts[-1])
                        if size > 1 << 24 or len(docs) >= 4096:
                            yield made()
                            docs, texts, counts, size = [], [], [], 0
                    open_doc, held = [doc], []
                held.append(text)
        if open_doc is not None:
            close()
            yield made()

    return rows.mapInArrow(run, f"`{doc_col}` {kind}, text string, n_pages long")


def token_windows(df: DataFrame, id_cols: Sequence[str], text_col: str = "text",
                  window: int = 384, overlap: int = 128, question_col: str | None = None) -> DataFrame:
    """E5: overlapping whitespace-token windows of the context.

    With ``question_col`` the question is kept whole in every window and only
    the context is windowed: the context budget is ``window - len(question)``.
    A question that leaves no more than ``overlap`` tokens has no such windows:
    its row comes out once, with ``win_no`` -1, no tokens and a null text.
    Output: ``(*id_cols, win_no, tok_start, n_tokens, text)``.
    """
    toks = T.py_split(text_col)
    if question_col is not None:
        budget = F.lit(window) - F.size(T.py_split(question_col))
    else:
        budget = F.lit(window)

    def starts_of(tok: Column, bud: Column) -> Column:
        stride = bud - overlap
        n = F.size(tok)
        starts = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil((n - bud) / stride).cast("int"), F.lit(0))),
            lambda i: i * stride)
        return F.when(bud > overlap, starts).otherwise(F.array(F.lit(-1)))
    base = df.select(*id_cols, toks.alias("_tok"), budget.alias("_bud"))
    return (T.explode_indexed(base, [*id_cols, "_tok", "_bud"], starts_of(F.col("_tok"), F.col("_bud")),
                              "win_no", "tok_start")
            .select(*id_cols, F.when(F.col("tok_start") >= 0, F.col("win_no")).otherwise(F.lit(-1)).alias("win_no"), "tok_start",
                    F.when(F.col("tok_start") >= 0, F.slice("_tok", F.greatest(F.col("tok_start"), F.lit(0)) + 1,
                                                            F.greatest("_bud", F.lit(0)))).alias("_w"))
            .select(*id_cols, "win_no", "tok_start", F.coalesce(F.size("_w"), F.lit(0)).alias("n_tokens"),
                    F.array_join("_w", " ").alias("text")))


def token_spans(text: str):
    """The token offset index: first character and end of every whitespace token
    (the tokens of :func:`quire.functions.text.py_split`)."""
    import numpy as np
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.ones(len(points) + 2, np.int8)
    blank[1:-1] = np.isin(points, [ord(c) for c in T.WS_CHARS])
    edge = np.diff(blank)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def answer_windows(df: DataFrame, id_cols: Sequence[str], context_col: str = "context", question_col: str = "question",
                   answer_col: str = "answer_text", start_col: str = "answer_start",
                   window: int = 384, overlap: int = 128) -> DataFrame:
    """E5 as training needs it: overlapping token windows of each example's context,
    each with the question and the place of the answer.

    Output: ``(*id_cols, win_no, question, tok_start, n_tokens, char_start, char_end,
    text, answer_first, answer_last)``.  The question is kept whole in every window, so
    ``window - len(question tokens)`` tokens of context fit; windows share ``overlap``
    tokens.  ``text`` is the context from ``char_start`` to ``char_end``, as it stands.
    ``answer_first`` and ``answer_last`` are the window's own numbers (0-based) of the
    first and the last token that the answer touches; both are -1 where the window
    does not hold the whole answer, or there is none (start -1 or null, answer empty
    or null).

    The context's token offsets are indexed once per example; windows are pairs of
    positions in that index and the answer's tokens are found in it by binary search.
    A question that leaves no more than ``overlap`` tokens has no windows: its row
    comes out once, with ``win_no`` -1 and a null text.  A blank context has one
    empty window; a null one counts as empty.
    """
    import numpy as np
    import pyarrow as pa
    names = [f"_id{i}" for i in range(len(id_cols))]
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, id_cols))
    rows = df.select(*[F.col(c).alias(n) for n, c in zip(names, id_cols)], F.col(question_col).alias("question"),
                     F.coalesce(F.size(T.py_split(question_col)), F.lit(0)).alias("_nq"),
                     F.coalesce(F.col(context_col), F.lit("")).alias("_c"),
                     F.coalesce(F.length(answer_col), F.lit(0)).alias("_na"),
                     F.coalesce(F.col(start_col).cast("long"), F.lit(-1)).alias("_s"))
    made = ("win_no", "tok_start", "n_tokens", "char_start", "char_end", "text", "answer_first", "answer_last")

    def windows_of(n_question, text, n_answer, start):
        budget = window - n_question
        if budget <= overlap:
            yield -1, -1, 0, -1, -1, None, -1, -1
            return
        begins, ends = token_spans(text)
        n = len(begins)
        first = last = -1
        if start >= 0 and n_answer > 0:  # the tokens that reach into the answer
            first = int(np.searchsorted(ends, start, "right"))
            last = int(np.searchsorted(begins, start + n_answer, "left")) - 1
        for no in range(max(0, -(-(n - budget) // (budget - overlap))) + 1):
            lo = no * (budget - overlap)
            hi = min(lo + budget, n)
            c, e = (int(begins[lo]), int(ends[hi - 1])) if hi > lo else (0, 0)
            inside = 0 <= lo <= first <= last < hi
            yield no, lo, hi - lo, c, e, text[c:e], first - lo if inside else -1, last - lo if inside else -1

    def run(batches):
        k = len(names)

        def flush(batch, at, out):
            taken = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(k + 1)]
            cols = zip(*out) if out else [[]] * len(made)
            kind = dict(zip(made, (*[pa.int64()] * 5, pa.string(), *[pa.int64()] * 2)))
            return pa.RecordBatch.from_arrays([*taken, *[pa.array(list(c), kind[m]) for m, c in zip(made, cols)]],
                                              names=[*names, "question", *made])

        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            at, out, size = [], [], 0
            args = [batch.column(i) for i in range(k + 1, k + 5)]
            for i in range(batch.num_rows):
                for row in windows_of(*(a[i].as_py() for a in args)):
                    at.append(i)
                    out.append(row)
                    size += len(row[5] or "")
                    if size > 1 << 22:
                        yield flush(batch, at, out)
                        at, out, size = [], [], 0
            if out:
                yield flush(batch, at, out)

    types = "win_no long, tok_start long, n_tokens long, char_start long, char_end long, text string, answer_first long, answer_last long"
    found = rows.mapInArrow(run, f"{kinds}, question string, {types}")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, id_cols)], "win_no", "question", "tok_start", "n_tokens",
                        "char_start", "char_end", "text", "answer_first", "answer_last")

"""Column builders for text: Unicode strip/split, word wrap, sentence packing,
token windows, path parts.

Everything here returns a :class:`pyspark.sql.Column` made of built-in Spark SQL
expressions (regexes, ``transform``/``filter``/``aggregate``), which run inside
the JVM next to the parquet scan.  Only :func:`wrap` goes over Arrow batches, for the
texts that its regex cannot wrap.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.breaks import wrap_lines

# --- fixed character classes ------------------------------------------------
# Python's str.isspace() set: the Unicode separators (Zs/Zl/Zp) plus the ASCII
# and C1 control characters Python treats as whitespace.  Java regex and RE2
# both accept this spelling, so the same class is used in Spark and DuckDB.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
_WS = WS[1:-1]
# The same set as characters, derived from Python's own rule (29 code points).
WS_CHARS = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())
# Whitespace other than the ASCII space that can remain after munging.
_OTHER_SPACE = r"[\x1C-\x1F\x85\p{Z}&&[^ ]]"

# Lower-cased word tokens used by embeddings, answer overlap and metrics.
TOKEN = r"[\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark re-evaluates an expression each time a lambda body references it,
    so an array computed outside ``transform``/``filter`` and used inside would
    be recomputed per element.  Binding it through a one-element ``transform``
    makes it a variable holding the computed value.
    """
    return F.transform(F.array(_col(value)), body)[0]


def explode_indexed(df, keep, arr, pos: str, val: str):
    """``posexplode`` that does not make Catalyst duplicate ``arr``.

    For a plain ``posexplode`` the optimiser infers ``size(arr) > 0`` and pushes
    that filter below the generator (even below an exchange), so an expensive
    array expression such as a fold would run twice.  The ``_outer`` form infers
    nothing; its single null row for an empty or null array is dropped here.
    """
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, val))
            .where(F.col(val).isNotNull()))


def py_strip(c) -> Column:
    """``str.strip()``: trims the full Unicode whitespace set (Spark's
    ``trim`` only removes ASCII spaces).  ``btrim`` with an explicit set only
    inspects the two ends, unlike an anchored regex that is tried at every
    position."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    """``s.strip() == ''`` (true for the empty string)."""
    return F.btrim(_col(c), F.lit(WS_CHARS)) == F.lit("")


def py_split(c) -> Column:
    """``str.split()`` with no separator: runs of Unicode whitespace, no empties."""
    return F.filter(F.split(_col(c), f"{WS}+"), lambda t: t != F.lit(""))


def word_tokens(c) -> Column:
    """Lower-cased letter/digit runs."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), 0)


# --- E3: fixed-width word wrap ----------------------------------------------

def _expand_tabs(text: Column, tabsize: int = 8) -> Column:
    """``str.expandtabs``: columns restart after every CR or LF."""
    def expand_segment(seg: Column) -> Column:
        parts = F.split(seg, "\t", -1)
        return F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            parts[0],
            lambda acc, p: F.concat(
                acc, F.repeat(F.lit(" "), F.lit(tabsize) - F.length(acc) % tabsize), p),
        )

    segments = F.split(text, "[\n\r]", -1)
    # separators become spaces anyway, so join the expanded segments with one
    return F.when(F.instr(text, "\t") > 0,
                  F.array_join(F.transform(segments, expand_segment), " ")).otherwise(text)


def _munge(text: Column) -> Column:
    """Tabs expanded, then each of TAB LF VT FF CR replaced by one space."""
    return F.regexp_replace(_expand_tabs(text), "[\t\n\x0b\x0c\r]", " ")


def _is_plain(text: Column, width: int) -> Column:
    """With no '-' (no hyphen or em-dash breaks), no word longer than the width, no
    leading space and, once munged, no white space other than ' ', greedy filling is
    exactly: each line is the longest run of at most ``width`` characters that starts
    and ends on a non-space and is followed by a space or the end.  Told from the text
    as it stands: munging only turns white space into spaces."""
    return (~text.contains("-")) & (~text.rlike("^[ \t\n\x0B\f\r]")) & \
        (~text.rlike(f"[^ \t\n\x0B\f\r]{{{width + 1}}}")) & (~text.rlike(_OTHER_SPACE))


def wrap(text, width: int = 500) -> Column:
    """``textwrap.wrap(text, width)`` with the standard defaults.

    Plain text (:func:`_is_plain`) is wrapped in the JVM by one greedy regex.  Any
    other text is broken over Arrow batches by a table of token ends
    (:mod:`quire.functions.breaks`); plain texts are not sent there.  Blank text gives
    an empty array, null gives null."""
    @F.arrow_udf("array<string>")
    def broken(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else wrap_lines(t, width) for t in texts.to_pylist()], pa.list_(pa.string()))

    text = _col(text)
    greedy = F.lit(f"[^ ](?:.{{0,{max(width - 2, 0)}}}[^ ])?(?= |\\z)" if width > 1 else "[^ ](?= |\\z)")
    # a plain text's place in the batch is null, so that what is plain is asked once
    return F.coalesce(broken(F.when(~_is_plain(text, width), text)), F.regexp_extract_all(_munge(text), greedy, 0))


# --- E4: sentence split and greedy pack -------------------------------------

def sentence_pack(text, max_length: int = 512, min_length: int = 50) -> Column:
    """Greedy packing of stripped sentences, each written back as ``s + '. '``.

    A sentence joins the current chunk while ``len(chunk) + len(sentence) <
    max_length`` (the separators are not counted in the test, so a finished
    chunk may reach ``max_length``); a longer sentence becomes a chunk on its
    own and is never split.  Finished chunks lose the trailing space; only
    chunks longer than ``min_length`` are kept.

    A chunk's end depends on where it starts, and a fold would carry (and copy) its
    list of chunks from step to step.  Written back in a row, the sentences hold a
    '.' at their ends only, so one greedy regex cuts the chunks, linear in the text:
    the longest run of at most ``max_length`` characters that ends on a '.', or else
    one sentence.  It runs in the JVM: no text or chunk is held by a Python worker.
    """
    stripped = F.regexp_extract_all(_col(text), F.lit(f"[^.!?{_WS}](?:[^.!?]*[^.!?{_WS}])?"), 0)
    room = max(max_length - 2, 0)
    greedy = F.lit(f"(?s)[^ ].{{0,{room}}}\\.|[^ ][^.]*+\\." if max_length > 1 else "[^ ][^.]*+\\.")
    chunks = F.regexp_extract_all(F.concat(F.array_join(stripped, ". "), F.lit(".")), greedy, 0)
    return F.filter(chunks, lambda c: F.length(c) > min_length)


# --- sentence spans used by the extractive answerer -------------------------

def sentence_spans(text) -> Column:
    """Sentences as they appear in the text (terminators kept), stripped,
    blanks dropped; every element is a substring of ``text``.

    Each is a run of ``[^.!?]+[.!?]*`` without the white space at its ends, cut by one
    regex: a run with a terminator, a blank one with a terminator (of which the
    terminators are left), and the text's last run without one."""
    return F.regexp_extract_all(_col(text), F.lit(
        f"[^.!?{_WS}][^.!?]*+[.!?]++|(?<=[{_WS}])[.!?]++|[^.!?{_WS}](?:[^.!?]*[^.!?{_WS}])?"), 0)


# --- E5 / E6: token windows and token budget --------------------------------

def token_windows(tokens, window: int = 384, overlap: int = 128) -> Column:
    """Start offsets (0-based) of overlapping windows over a token array: each
    window holds at most ``window`` tokens and shares ``overlap`` with the next;
    the last window ends at the last token.  Empty input gives one empty window."""
    step = window - overlap
    if step <= 0:
        raise ValueError("window must exceed overlap")
    n = F.size(_col(tokens))
    last = F.greatest(F.ceil((n - window) / F.lit(step)).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def truncate_tokens(text, budget: int = 512) -> Column:
    """First ``budget`` whitespace tokens, re-joined by one space."""
    return F.array_join(F.slice(py_split(text), 1, budget), " ")


def cut_tokens(text, budget: int = 512) -> Column:
    """The text up to the end of its ``budget``-th whitespace token, as it stands."""
    c = _col(text)
    return F.when(F.size(py_split(c)) <= budget, c) \
        .otherwise(F.regexp_extract(c, f"^(?:{WS}*+[^{WS[1:]}++){{0,{budget}}}", 0))


# --- D1-D3: path parts ------------------------------------------------------

def strip_query(url) -> Column:
    """Drop ``?query`` and ``#fragment``."""
    return F.regexp_replace(_col(url), r"[?#].*$", "")


def basename(path) -> Column:
    """``os.path.basename``: the text after the last ``/`` ('' after a trailing slash)."""
    return F.element_at(F.split(_col(path), "/", -1), -1)


def _pure_name(path) -> Column:
    """``PurePath(path).name``: trailing ``/`` and ``/.`` segments are ignored
    and ``.`` alone has no name."""
    trimmed = F.regexp_replace(_col(path), r"(/+\.?)+$", "")
    name = F.element_at(F.split(trimmed, "/", -1), -1)
    return F.when(name == F.lit("."), F.lit("")).otherwise(name)


def suffix(path) -> Column:
    """``PurePath.suffix``: from the last dot of the final component, when that
    dot is neither its first nor its last character."""
    return F.regexp_extract(_pure_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path) -> Column:
    """``PurePath.stem``: the final component without its suffix."""
    name = _pure_name(path)
    return name.substr(F.lit(1), F.length(name) - F.length(suffix(path)))


def join_key(prefix, key) -> Column:
    """``prefix/key`` with doubled slashes at the seam removed."""
    return F.concat_ws("/", F.regexp_replace(_col(prefix), "/+$", ""),
                       F.regexp_replace(_col(key), "^/+", ""))

"""Corpus filters, audits and bookkeeping."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Extensions the corpus loaders accept (fixed values, compared lower-case).
SUPPORTED_EXTENSIONS = (".txt", ".pdf")
# Minimum stripped document length for QA generation (fixed value).
MIN_DOC_CHARS = 100


def extension(path_col: str, cut_query: bool = False):
    p = T.strip_query(path_col) if cut_query else F.col(path_col)
    return F.lower(T.suffix(p))


def ext_filter(df: DataFrame, path_col: str = "path",
               extensions: Iterable[str] = SUPPORTED_EXTENSIONS, cut_query: bool = False) -> DataFrame:
    """Keep rows whose path suffix, lower-cased, is in ``extensions``."""
    return df.where(extension(path_col, cut_query).isin([e.lower() for e in extensions]))


def ext_audit(df: DataFrame, path_col: str = "path",
              extensions: Iterable[str] = SUPPORTED_EXTENSIONS, cut_query: bool = False) -> DataFrame:
    """Unsupported files counted per (lower-cased) extension; '' = none."""
    ext = extension(path_col, cut_query)
    return (df.where(~ext.isin([e.lower() for e in extensions]))
            .groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n_files")))


def min_text_filter(df: DataFrame, text_col: str = "text", min_chars: int = MIN_DOC_CHARS) -> DataFrame:
    """Stripped text at least ``min_chars`` characters (null text fails)."""
    return df.where(F.length(T.py_strip(text_col)) >= min_chars)


def incremental_anti(new: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not yet in ``done``: one left anti
    join against the distinct done keys (a null key never matches, so such rows
    stay new).  Spark broadcasts the keys by their size, or shuffles both sides."""
    keys = list(keys)
    return new.join(done.select(*keys).distinct(), keys, "left_anti")


def corpus_union(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """K1: bag union of ``(corpus name, df(doc_id, text))`` parts."""
    out = None
    for name, df in parts:
        d = df.select(F.lit(name).alias("corpus"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))
        out = d if out is None else out.unionByName(d)
    return out


def quarantine_columns(text_col: str = "text", min_chars: int = MIN_DOC_CHARS, valid_col: str | None = None):
    """N1 rule as ``(status, reason)`` columns.  Reasons, in order: null text,
    malformed UTF-8 (by the bytes: ``valid_col`` where the text was decoded
    leniently, else the text's own; a U+FFFD that was written is valid text),
    blank text, stripped text shorter than ``min_chars``; status is ok when
    there is no reason."""
    t = F.col(text_col)
    valid = F.col(valid_col) if valid_col else F.call_function("is_valid_utf8", t)
    stripped_len = F.length(T.py_strip(t))
    reason = (F.when(t.isNull(), F.lit("null_text"))
              .when(~valid, F.lit("bad_utf8"))
              .when(stripped_len == 0, F.lit("blank_text"))
              .when(stripped_len < min_chars, F.lit("too_short")))
    status = F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("quarantine"))
    return status, reason


def quarantine(df: DataFrame, id_cols: Sequence[str], text_col: str = "text",
               min_chars: int = MIN_DOC_CHARS, valid_col: str | None = None) -> DataFrame:
    """Every row gets a ``status`` (ok/quarantine) and a ``reason``, so
    failed records are kept and counted rather than silently lost."""
    status, reason = quarantine_columns(text_col, min_chars, valid_col)
    return df.select(*id_cols, status.alias("status"), reason.alias("reason"))


def index_stats(index: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """H1: vector count and dimension range; ``uniform`` is false when the
    dimensions are ragged (such rows cannot enter one flat index)."""
    d = F.size(vec_col)
    return index.agg(F.count(F.lit(1)).alias("n_vectors"),
                     F.min(d).alias("min_dim"), F.max(d).alias("max_dim"),
                     F.count_if(F.col(vec_col).isNull()).alias("n_null")) \
        .withColumn("uniform", F.col("min_dim") == F.col("max_dim"))

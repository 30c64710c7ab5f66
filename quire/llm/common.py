"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run without the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: ``bytes.translate`` table lower-casing A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(-1).cast("long"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of the md5 of the parts joined by ``|``."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def lean(kernel):
    """An Arrow kernel whose worker gives its memory back when a partition is done
    (workers are reused, and an executor's share must hold the largest step, not
    the sum of all)."""
    def run(batches):
        import ctypes
        import gc

        import pyarrow as pa
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from kernel(batches)
        finally:
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)
    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside: where rows hold
    whole texts, a batch stands several times in the JVM and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)

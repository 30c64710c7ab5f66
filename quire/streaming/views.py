"""Published results of streams: epochs in folders of their own, and a pointer.

An epoch's rows are written into a folder that nobody reads yet.  Then one line,
the pointer ``_current``, is written beside it and renamed over the old one, which
is a single step of the file system.  A reader takes the pointer's line first, so it
sees the state before an epoch or after it, never between; a run that was killed
writes its epoch again, over what it left.

Two kinds: a *view* is one whole table per epoch (the pointer names its folder); a
*log* grows by a folder ``epoch=<n>`` per epoch (the pointer is the last number that
counts).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    """The file system of ``path``; a local one without checksum files, which would
    have to be renamed in a step of their own."""
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getRawFileSystem() if fs.getClass().getSimpleName() == "LocalFileSystem" else fs


def point(spark: SparkSession, folder: str, line: str) -> None:
    """Writes the pointer of ``folder`` and renames it over the old one."""
    folder = folder.rstrip("/")
    fresh = f"{folder}/{POINTER}-{uuid.uuid4().hex}"
    fs = _fs(spark, folder)
    fs.mkdirs(_path(spark, folder))
    out = fs.create(_path(spark, fresh), True)
    out.write(bytearray(line.encode("utf-8")))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, folder).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, fresh), _path(spark, f"{folder}/{POINTER}"), over)


def current(spark: SparkSession, folder: str) -> str | None:
    """The pointer's line, None before the first epoch."""
    fs, at = _fs(spark, folder), _path(spark, f"{folder.rstrip('/')}/{POINTER}")
    if not fs.exists(at):
        return None
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(int(size))).decode("utf-8")
    finally:
        stream.close()


def publish_view(rows: DataFrame, folder: str, epoch: int, keep: int = 2) -> None:
    """Makes ``rows`` the view in ``folder``.  ``rows`` may be derived from the view as
    it is: the new table stands in a new folder.  The ``keep`` latest tables stay, for
    readers that have begun; older ones are removed."""
    spark = rows.sparkSession
    folder = folder.rstrip("/")
    name = f"table-{epoch:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    point(spark, folder, name)
    fs = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(_path(spark, folder)))
    for old in [n for n in names if n.startswith("table-") and n < name][:-(keep - 1) or None]:
        fs.delete(_path(spark, f"{folder}/{old}"), True)


def read_view(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """The view published last; before the first epoch an empty table of ``schema``."""
    name = current(spark, folder)
    if name is None:
        if schema is None:
            raise FileNotFoundError(f"nothing is published in {folder}")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}")


def append_epoch(rows: DataFrame, folder: str, epoch: int) -> None:
    """Writes an epoch's rows of a log, over what a killed run of it left; they count
    once :func:`commit_epoch` was called."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/epoch={epoch}")


def commit_epoch(spark: SparkSession, folder: str, epoch: int) -> None:
    point(spark, folder, str(epoch))


def read_log(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """The rows of all epochs up to the pointer, with their ``epoch``."""
    last = current(spark, folder)
    if last is None:
        if schema is None:
            raise FileNotFoundError(f"nothing is published in {folder}")
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(0))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(folder).where(F.col("epoch") <= int(last))

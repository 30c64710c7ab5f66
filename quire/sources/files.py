"""Corpus files.

Listing and reading go through Spark's ``binaryFile`` source, so the same code
lists a local folder or an object-store prefix (Hadoop FS pages through every
key; there is no first-page cap).  Listing selects only ``path/length/
modificationTime`` and the ``content`` column is pruned from the scan.
Spark's file scan skips zero-length files, so they appear in no listing;
they could not yield text anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import corpus as C

#: A file's bytes -> its page texts (a list, or one text); raises or gives nothing on failure.
Extractor = Callable[[bytes], "Sequence[str] | str | None"]


def _reader(spark: SparkSession, recursive: bool, pattern: str | None):
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r


def _rel(base: str):
    # binaryFile reports fully-qualified URIs (file:/..., s3a://...): cut the
    # qualified base folder, by length, from the paths that begin with it
    spark = SparkSession.active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(folder).toString().rstrip("/") + "/"
    return F.when(F.startswith("path", F.lit(full)), F.substr("path", F.lit(len(full) + 1))).otherwise(F.col("path"))


def file_manifest(spark: SparkSession, base: str, recursive: bool = True,
                  pattern: str | None = None) -> DataFrame:
    """A1/A5: ``(path, rel_path, length, modificationTime)`` for every file
    under ``base``; no file content is read."""
    df = _reader(spark, recursive, pattern).load(base)
    return df.select("path", _rel(base).alias("rel_path"), "length", "modificationTime")


def extension_glob(extensions: Sequence[str]) -> str:
    """Case-insensitive Hadoop glob for the extensions, e.g. ``*.{[tT][xX][tT]}``:
    lets the listing skip other files before any is opened."""
    def ci(ext: str) -> str:
        return "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in ext.lstrip("."))
    return "*.{" + ",".join(ci(e) for e in extensions) + "}"


def list_supported(spark: SparkSession, base: str, extensions: Sequence[str] = C.SUPPORTED_EXTENSIONS,
                   recursive: bool = True) -> DataFrame:
    """Manifest restricted to supported extensions, case-insensitively
    (glob at listing time, exact suffix test as a residual filter)."""
    return C.ext_filter(file_manifest(spark, base, recursive, extension_glob(extensions)),
                        "path", extensions)


def load_corpus(spark: SparkSession, base: str, extensions: Sequence[str] = (".txt",),
                recursive: bool = True) -> DataFrame:
    """``(path, rel_path, doc_id, ext, content, text, text_ok)``.

    ``text`` is the UTF-8 decode of the bytes.  Bytes that are not valid UTF-8
    decode leniently with U+FFFD and ``text_ok`` = false, so callers can route
    them to quarantine instead of losing them.  ``doc_id`` is the relative
    path, so ``a/x.txt`` and ``b/x.txt`` stay distinct.
    """
    df = _reader(spark, recursive, extension_glob(extensions)).load(base)
    df = C.ext_filter(df, "path", extensions)
    valid = F.call_function("is_valid_utf8", F.col("content"))
    return df.select(
        "path", _rel(base).alias("rel_path"), _rel(base).alias("doc_id"),
        F.lower(T.suffix("path")).alias("ext"), "content",
        F.call_function("make_valid_utf8", F.col("content")).alias("text"),
        valid.alias("text_ok"))


def attempts(chain: Sequence[Extractor], content: bytes | None):
    """Runs ``chain`` in order on a file's bytes until one gives text: (pages, number
    of the extractor, failures), each failure a pair (number, reason).  A reason is the
    exception's type and message, or ``empty`` where no text came out.  When all
    fail, the pages are one empty text and the number is -1."""
    failures = []
    for i, extractor in enumerate(chain):
        try:
            found = extractor(bytes(content) if content is not None else b"")
        except Exception as e:  # one file's failure is a row of its own, never the job's
            failures.append((i, f"{type(e).__name__}: {e}"))
            continue
        pages = [found] if isinstance(found, str) else list(found or ())
        if any(pages):
            return [p or "" for p in pages], i, failures
        failures.append((i, "empty"))
    return [""], -1, failures


def extract_pages(files: DataFrame, extractors: Sequence[Extractor], id_col: str = "doc_id",
                  content_col: str = "content") -> DataFrame:
    """Caller-supplied extractors, in order, over each file's bytes, as a
    polymorphic table function: ``(<id>, kind, page_no, text, attempt, reason)``, the id
    in the type it came in.

    * ``kind`` = 'page': a page's text; ``attempt`` is the number of the extractor it
      comes from, -1 for the one empty page of a file that nobody could read;
    * ``kind`` = 'failure': an attempt that failed, with its reason.

    Pages feed :func:`quire.operators.chunking.assemble_pages` (:func:`pages_of`), failures
    a quarantine (:func:`failures_of`).  Rows are made where the file was read, without
    an exchange."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    from pyspark.sql.udtf import AnalyzeResult
    chain = list(extractors)

    @F.udtf
    class Extract:
        @staticmethod
        def analyze(table) -> AnalyzeResult:
            text, number = StringType(), IntegerType()
            return AnalyzeResult(StructType([
                StructField(id_col, table.dataType[id_col].dataType), StructField("kind", text), StructField("page_no", number),
                StructField("text", text), StructField("attempt", number), StructField("reason", text)]))

        def eval(self, row):
            pages, winner, failures = attempts(chain, row[content_col])
            for i, reason in failures:
                yield row[id_col], "failure", None, None, i, reason
            for n, page in enumerate(pages):
                yield row[id_col], "page", n, page, winner, None

    content = F.col(content_col).cast("binary").alias(content_col)
    return Extract(files.select(id_col, content).asTable())


def pages_of(extracted: DataFrame) -> DataFrame:
    """``(<id>, page_no, text, extractor)`` of :func:`extract_pages`."""
    first = extracted.columns[0]
    return extracted.where("kind = 'page'").select(first, "page_no", "text", F.col("attempt").alias("extractor"))


def failures_of(extracted: DataFrame) -> DataFrame:
    """``(<id>, attempt, reason)`` of :func:`extract_pages`."""
    return extracted.where("kind = 'failure'").select(extracted.columns[0], "attempt", "reason")


def extract_documents(files: DataFrame, extractors: Sequence[Extractor], id_col: str = "doc_id",
                      content_col: str = "content") -> DataFrame:
    """F8: the pages alone, ``(<id>, page_no, text, extractor)``."""
    return pages_of(extract_pages(files, extractors, id_col, content_col))


def extract_texts(files: DataFrame, chains: dict[str, Sequence[Extractor]], ext_col: str = "ext",
                  content_col: str = "content", sep: str = "") -> DataFrame:
    """F8/N1 with one row per file: the columns of ``files`` but the content, and
    ``text`` (the pages joined by ``sep``), ``extractor`` (its number, -1: none) and
    ``failures`` (array of ``(attempt, reason)``).  ``chains`` names the extractors by
    extension; a file of another one has the single failure ``unsupported``.  An Arrow
    map: each file's bytes are read once and go no further."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
    others = [c for c in files.columns if c != content_col]
    chains = {k.lower(): list(v) for k, v in chains.items()}

    def run(batches):
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            texts, winners, failed = [], [], []
            exts = batch.column(batch.schema.get_field_index(ext_col)).to_pylist()
            for ext, content in zip(exts, batch.column(len(others))):
                if ext in chains:
                    pages, winner, failures = attempts(chains[ext], content.as_py())
                else:
                    pages, winner, failures = [""], -1, [(-1, "unsupported")]
                texts.append(sep.join(pages))
                winners.append(winner)
                failed.append([{"attempt": i, "reason": r} for i, r in failures])
            kind = pa.list_(pa.struct([("attempt", pa.int32()), ("reason", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(others)], pa.array(texts, pa.string()), pa.array(winners, pa.int32()), pa.array(failed, kind)],
                names=[*others, "text", "extractor", "failures"])

    failure = StructType().add("attempt", IntegerType()).add("reason", StringType())
    schema = StructType([files.schema[c] for c in others]).add("text", StringType()).add("extractor", IntegerType()) \
        .add("failures", ArrayType(failure))
    return files.select(*others, F.col(content_col).cast("binary").alias(content_col)).mapInArrow(run, schema)

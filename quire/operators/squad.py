"""SQuAD-style datasets, flat and nested, in and out.

A dataset has one paragraph per distinct context, whatever its number of
questions.  Its normal form is two tables (:func:`paragraph_tables`): paragraphs,
known by the place ``(doc_id, chunk_no, q_no)`` of their first question, and
questions that name their paragraph's place and their own.  Sorting by the two
places gives first-seen order, so a context that repeats across a large share of
the corpus (boilerplate, licence text) is never gathered: documents are written
line by line from range-dealt partitions, which a large paragraph spans.
:func:`paragraphs` is the nested row form, one row per paragraph, for consumers that
want a paragraph as one value.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.functions import text as T
from quire.operators.positions import number_within
from quire.session import materialize

# --- fixed values: dataset format version, title and location formats ----------
SQUAD_VERSION = "2.0"
TITLE_FORMAT = "Generated_Document_%s"
DATASET_PATH_FORMAT = "generated_datasets/squad_dataset_%s"
# ---------------------------------------------------------------------------------
#: Lines per file of a written document, so that a reader can hold a file.
LINES_PER_FILE = 100_000
#: zlib's level (Hadoop's name) of documents in gzip: half the time of the default for 5 % more.
GZIP_LEVEL = "FOUR"
#: A paragraph is written by one task if it has so many questions at most, or this part
#: of all questions; so LARGE_PART bounds the number of larger ones.
LARGE_PARAGRAPH, LARGE_PART = 1_000, 20_000

ANSWERS_FLAT = Ty.StructType([
    Ty.StructField("text", Ty.ArrayType(Ty.StringType())),
    Ty.StructField("answer_start", Ty.ArrayType(Ty.IntegerType()))])
QA_FLAT = Ty.StructType([
    Ty.StructField("id", Ty.StringType()), Ty.StructField("title", Ty.StringType()),
    Ty.StructField("context", Ty.StringType()), Ty.StructField("question", Ty.StringType()),
    Ty.StructField("answers", ANSWERS_FLAT)])


def flat_records(qa: DataFrame) -> DataFrame:
    """B1 rows: ``(id, title, context, question, answers{text[], answer_start[]})``
    from ``(id, title, context, question, answer_text, answer_start)``."""
    return qa.select("id", "title", "context", "question",
                     F.struct(F.array("answer_text").alias("text"),
                              F.array(F.col("answer_start").cast("int")).alias("answer_start"))
                     .alias("answers"))


def json_lines(records: DataFrame) -> DataFrame:
    """Each flat record as the JSON text of its line (field order kept,
    non-ASCII written as is): ``(id, json)``."""
    return records.select("id", F.to_json(F.struct(*records.columns)).alias("json"))


def write_flat(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """B1 sink: JSON lines, one QA record per line (splittable, no driver merge)."""
    records.write.mode(mode).json(path)


def write_flat_document(records: DataFrame, path: str, order_by=("id",)) -> None:
    """B1 as one document ``{"data": [...]}``: the part files in ``path``, put one
    after the other in the order of their names, one record per line.  Lines come
    from range-sorted partitions; no task sees more than its range."""
    rows = materialize(records.select(
        F.struct(*[F.col(c) for c in order_by]).alias("key"), F.to_json(F.struct(*records.columns)).alias("json"),
        F.monotonically_increasing_id().alias("n")))
    first = rows.agg(F.min(F.struct("key", "json", "n")).alias("x")).first()["x"]
    lead = F.lit("") if first is None else F.when(F.col("n") == first["n"], "").otherwise(", ")
    body = rows.select(F.lit(1).alias("section"), "key", "json", "n", F.concat(lead, "json").alias("value"))
    _write_lines(body, [("{\"data\": [", 0), ("]}", 2)], ["section", "key", "json", "n"], path)


def _write_lines(body: DataFrame, ends: list, order: list, path: str) -> None:
    """The lines ``value`` of ``body`` in ``order``, between the lines of ``ends``
    (text, section); the partitions of a distributed sort become the files."""
    spark = body.sparkSession
    outer = spark.createDataFrame(ends, "value string, section int")
    lines = body.unionByName(outer, allowMissingColumns=True)
    _write_text(lines.orderBy(*order).select("value"), path)


def _write_text(lines: DataFrame, path: str, compression: str | None = None) -> None:
    lines.write.mode("overwrite").option("maxRecordsPerFile", LINES_PER_FILE) \
        .option("zlib.compress.level", GZIP_LEVEL).text(path, compression=compression)


def read_flat(spark: SparkSession, path: str, multiline_wrapper: bool = False) -> DataFrame:
    """Read flat QA records with a declared schema.  ``multiline_wrapper``
    reads a single-document ``{"data": [...]}`` file whole;
    :func:`read_flat_document` reads what :func:`write_flat_document` wrote."""
    if multiline_wrapper:
        wrapper = Ty.StructType([Ty.StructField("data", Ty.ArrayType(QA_FLAT))])
        return (spark.read.schema(wrapper).option("multiLine", True).json(path)
                .select(F.explode("data").alias("r")).select("r.*"))
    return spark.read.schema(QA_FLAT).json(path)


def read_flat_document(spark: SparkSession, path: str) -> DataFrame:
    """The records of a document of :func:`write_flat_document`, line by line."""
    record = F.regexp_replace("value", r"^, (?=\{)", "")
    return (spark.read.text(path).select(record.alias("r"))
            .where(~F.col("r").isin("{\"data\": [", "]}"))
            .select(F.from_json("r", QA_FLAT).alias("r")).select("r.*"))


def unflatten_answers(records: DataFrame) -> DataFrame:
    """C8 projection: first answer text and start as scalar columns."""
    return records.select("id", "title", "context", "question",
                          F.try_element_at(F.col("answers.text"), F.lit(1)).alias("answer_text"),
                          F.try_element_at(F.col("answers.answer_start"), F.lit(1)).alias("answer_start"))


PLACE = ("doc_id", "chunk_no", "q_no")


def paragraph_tables(qa: DataFrame, task_id: str) -> tuple[DataFrame, DataFrame]:
    """H3/I4 in normal form, from QA rows ``(id, doc_id, chunk_no, q_no, context,
    question, answer, answer_start)``:

    * paragraphs ``(first, last, title, context, n_qas)``: the places of the first
      and the last question, a partial aggregate per distinct context;
    * questions ``(first, at, is_last, id, question, answers)``: ``first`` names the
      paragraph, ``at`` is the question's place.

    A context is known by its sha256, and questions are joined without contexts.
    """
    keys = _paragraph_keys(qa, F.max(F.struct(*PLACE)).alias("last"))
    contexts = qa.groupBy(_context_key()).agg(F.min_by("context", F.struct(*PLACE)).alias("context"))
    paras = keys.join(contexts, "ck").select("first", "last", F.lit(TITLE_FORMAT % task_id).alias("title"), "context", "n_qas")
    answers = F.array(F.struct(F.col("answer").alias("text"), F.col("answer_start").cast("int").alias("answer_start")))
    rows = _keyed_questions(qa.withColumn("answers", answers), keys.select("ck", "first", "last"), "id", "question", "answers")
    return paras, rows.select("first", "at", (F.col("at") == F.col("last")).alias("is_last"), "id", "question", "answers")


def _paragraph_keys(qa: DataFrame, *more: Column) -> DataFrame:
    """``(ck, first, n_qas)`` and ``more`` of every distinct context, written: a partial
    aggregate that contexts don't take part in."""
    return materialize(qa.groupBy(_context_key()).agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n_qas"), *more),
                       "paragraphs", "zstd")


def _keyed_questions(qa: DataFrame, keys: DataFrame, *cols: str | Column) -> DataFrame:
    """Every question that has a context: its place ``at``, ``cols`` and what ``keys``
    has of its paragraph.  The join to the contexts' one row each splits a hot
    context's questions (AQE skew join)."""
    return qa.where("context is not null").select(_context_key(), F.struct(*PLACE).alias("at"), *cols).join(keys, "ck")


def cut_answers(qa: DataFrame) -> DataFrame:
    """``qa`` with answers that stand in their context at ``answer_start`` known by their
    length ``cut``, and null as text; :func:`whole_answers` gives them back."""
    there = F.substring("context", F.col("answer_start").cast("int") + 1, F.length("answer")) == F.col("answer")
    cut = F.when((F.col("answer_start") >= 0) & there, F.length("answer"))
    return qa.withColumn("cut", cut).withColumn("answer", F.when(F.col("cut").isNull(), F.col("answer")))


def whole_answers(qa: DataFrame) -> DataFrame:
    """The rows that :func:`cut_answers` was given."""
    return qa.withColumn("answer", _answer_of(F.col("answer"), F.col("context"), F.col("answer_start"), F.col("cut"))).drop("cut")


def _answer_of(answer: Column, context: Column, start: Column, cut: Column) -> Column:
    return F.when(cut.isNull(), answer).otherwise(F.substring(context, start.cast("int") + 1, cut))


def _context_key() -> Column:
    """A context's sha256 (empty for null), for which it stands in joins and sorts."""
    return F.coalesce(F.unhex(F.sha2(F.col("context").cast("binary"), 256)), F.lit("").cast("binary")).alias("ck")


def numbered_tables(qa: DataFrame, task_id: str) -> tuple[DataFrame, DataFrame]:
    """H3/I4 in normal form with exact ordinals, at any size of a paragraph:

    * paragraphs ``(paragraph_no, title, context, n_qas)``: 0-based, in the order in
      which the contexts were first seen;
    * questions ``(paragraph_no, position, id, question, answers)``: ``position`` is
      the 0-based place among the paragraph's questions.

    Both numbers come from range sorts (:func:`~quire.operators.positions.number_within`).
    A context is known by its sha256 there: contexts travel once, in the paragraphs'
    partial aggregate, and questions are sorted and joined without them.  ``qa`` is read
    several times: pass a written table.
    """
    place = F.struct(*PLACE)
    key = _context_key()
    paras = qa.groupBy(key).agg(F.min(place).alias("first"), F.min_by("context", place).alias("context"), F.count(F.lit(1)).alias("n_qas"))
    paras = materialize(paras, "paragraphs")
    numbers = number_within(paras.select("ck", "first"), [], ["first"], "paragraph_no", name="paragraphs-numbered").select("ck", "paragraph_no")
    answers = F.array(F.struct(F.col("answer").alias("text"), F.col("answer_start").cast("int").alias("answer_start")))
    rows = number_within(qa.select(key, place.alias("at"), "id", "question", answers.alias("answers")),
                         ["ck"], ["at"], "position", name="questions-numbered")
    return (paras.join(numbers, "ck").select("paragraph_no", F.lit(TITLE_FORMAT % task_id).alias("title"), "context", "n_qas"),
            rows.join(numbers, "ck").select("paragraph_no", "position", "id", "question", "answers"))


def paragraphs(qa: DataFrame, task_id: str) -> DataFrame:
    """H3/I4: QA rows ``(id, doc_id, chunk_no, q_no, context, question, answer,
    answer_start)`` -> one row per distinct context with its ordered ``qas``.

    Output: ``(first_doc_id, first_chunk_no, first_q_no, title, context,
    qas array<struct<id, question, answers array<struct<text, answer_start>>>>)``.
    A paragraph is one value here; :func:`numbered_tables` is the form for
    contexts with more questions than a row should hold.
    """
    qa_struct = F.struct(
        *PLACE, "id", "question",
        F.array(F.struct(F.col("answer").alias("text"),
                         F.col("answer_start").cast("int").alias("answer_start"))).alias("answers"))
    grouped = qa.groupBy("context").agg(F.array_sort(F.collect_list(qa_struct)).alias("_qas"))
    first = F.col("_qas")[0]
    return grouped.select(
        first["doc_id"].alias("first_doc_id"), first["chunk_no"].alias("first_chunk_no"),
        first["q_no"].alias("first_q_no"),
        F.lit(TITLE_FORMAT % task_id).alias("title"), "context",
        F.transform("_qas", lambda x: F.struct(x["id"].alias("id"), x["question"].alias("question"),
                                               x["answers"].alias("answers"))).alias("qas"))


#: Where a line opens a paragraph, and what a question's line has first or after ", ".
#: Neither stands inside of a JSON string, where quotes are escaped.
_OPENING, _ASKING = '{"title": ', '{"id":'


def write_document(qa: DataFrame, path: str, task_id: str, compression: str | None = None) -> None:
    """B2: the document ``{"version": ..., "data": [...]}``, one ``data`` entry per
    distinct context in first-seen order.  ``path`` holds part files that give the
    document when put one after the other in the order of their names (with
    ``compression`` "gzip", the document's gzip file).  A line opens a paragraph or is
    one question.  ``qa`` is read several times: pass a written table.

    Rows are dealt out once, by ranges of their paragraph's first place.  A context
    comes from the rows that may be the first to have it, and is dropped where no
    question has that place for its paragraph's first.  Questions come without their
    context, and answers that stand in it as a start and a length, for a paragraph's
    questions meet its context in their task.  Only those of large paragraphs, but for
    the first, are dealt out by their own place too and bring their answer, so that no
    paragraph or document is ever held whole."""
    keys = _paragraph_keys(qa)
    mark = F.xxhash64("ck").alias("mark")  # tells apart contexts of one first place
    some = keys.where(F.length("ck") > 0)
    known = some.agg(F.sum("n_qas").alias("n"), F.min(F.struct("first", mark)).alias("start"), F.min("first.q_no").alias("low"),
                     F.max("first.q_no").alias("high")).first()
    many = max(LARGE_PARAGRAPH, (known["n"] or 0) // LARGE_PART)
    large = F.broadcast(some.where(F.col("n_qas") > many).select("ck", F.lit(True).alias("large")))

    own = [F.col(f"first.{c}").alias(f"first_{c}") for c in PLACE]
    first_seen = qa.where(F.col("context").isNotNull() & (F.col("q_no").isNull() | F.col("q_no").between(known["low"], known["high"]))) \
        .select(_context_key(), F.struct(*PLACE).alias("first"), "context")
    opened = first_seen.select(F.lit(1).alias("section"), *own, mark, "context")

    answered = cut_answers(qa.withColumn("whole", F.col("answer"))).withColumn("ck", _context_key()).join(large, "ck", "left")
    rows = _keyed_questions(answered, keys.select("ck", "first"), "id", "question",
                            F.when(F.col("large"), F.col("whole")).otherwise(F.col("answer")).alias("answer"),
                            F.col("answer_start").cast("int").alias("start"),
                            F.when(F.col("large").isNull(), F.col("cut")).alias("cut"), "large")
    near = F.col("at.doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("at.chunk_no").eqNullSafe(F.col("first.chunk_no"))
    asked = rows.select(F.lit(1).alias("section"), *own, mark, F.when(F.col("large") & (F.col("at") != F.col("first")), F.col("at")).alias("apart"),
                        F.struct(*[F.when(~near, F.col(f"at.{c}")).alias(c) for c in PLACE[:2]], F.col("at.q_no").alias("q_no"),
                                 "id", "question", "answer", "start", "cut").alias("qa"))
    ends = qa.sparkSession.createDataFrame(
        [('{"version": "%s", "data": [' % SQUAD_VERSION, 0), ("]}" if known["start"] is None else "]}]}]}", 2)],
        "context string, section int")

    # what is dealt out by ranges of the keys needs no other exchange to be grouped by them
    at = ["section", *[f"first_{c}" for c in PLACE], "mark", "apart"]
    dealt = asked.unionByName(opened, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True).repartitionByRange(*at)
    paras = dealt.groupBy(*at).agg(F.first("context", ignorenulls=True).alias("context"), F.array_sort(F.collect_list("qa")).alias("qas")) \
        .sortWithinPartitions(*at)
    one = F.lit(False)
    if known["start"] is not None:
        one = F.col("mark") == known["start"]["mark"]
        for c in PLACE:
            one &= F.col(f"first_{c}").eqNullSafe(F.lit(known["start"]["first"][c]).cast(qa.schema[c].dataType))
    context = F.coalesce("context", F.raise_error(F.lit("a paragraph without its context")).cast("string"))
    text = T.let(F.to_json(F.struct(context.alias("x"))), lambda j: F.substr(j, F.lit(6), F.length(j) - 6))  # of {"x":"text"}
    head = F.concat(F.when(one, "").otherwise("]}]}, "), F.lit(_OPENING + json.dumps(TITLE_FORMAT % task_id, ensure_ascii=False)),
                    F.lit(', "paragraphs": [{"context": '), text, F.lit(', "qas": ['))

    def line(x: Column, i: Column) -> Column:
        answer = _answer_of(x["answer"], F.col("context"), x["start"], x["cut"])
        answers = F.array(F.struct(answer.alias("text"), x["start"].alias("answer_start")))
        lead = F.when(F.col("apart").isNotNull() | (i > 0), ", ").otherwise("")
        return F.concat(lead, F.to_json(F.struct(x["id"].alias("id"), x["question"].alias("question"), answers.alias("answers"))))

    lines = F.when(F.col("section") != 1, F.array("context")) \
        .when(F.size("qas") == 0, F.array().cast("array<string>")) \
        .when(F.col("apart").isNotNull(), F.transform("qas", line)) \
        .otherwise(F.concat(F.array(head), F.transform("qas", line)))
    _write_text(paras.select(F.explode_outer(lines).alias("value")).where("value is not null"), path, compression)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The rows ``(title, context, id, question, answer, answer_start)`` of a
    document of :func:`write_document`.  A file is cut where lines open a paragraph, and
    a piece's questions take the paragraph that it opens: nothing is shuffled.  What
    stands ahead of a file's first opening takes the last one of the files before (one
    row per file is ordered for that)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    head = Ty.StructType([Ty.StructField("title", Ty.StringType()), Ty.StructField("paragraphs", Ty.ArrayType(
        Ty.StructType([Ty.StructField("context", Ty.StringType())])))])

    def opened(piece: Column) -> Column:
        entry = F.from_json(F.concat(F.lit(_OPENING), F.substring_index(piece, "\n", 1), F.lit("]}]}")), head)
        return F.struct(entry["title"].alias("title"), entry["paragraphs"][0]["context"].alias("context"))

    def asked(rows: DataFrame) -> DataFrame:
        return rows.select("p", F.explode_outer(F.split("piece", "\n")).alias("line")) \
            .select("p", F.ltrim("line", F.lit(", ")).alias("line")).where(F.col("line").startswith(_ASKING)) \
            .select("p", F.from_json("line", _QA).alias("qa"))

    within = files.select(F.posexplode_outer(F.split("value", "\\" + _OPENING)).alias("pos", "piece")).where("pos > 0") \
        .select(opened(F.col("piece")).alias("p"), "piece")
    ahead = files.select("file", F.substring_index("value", _OPENING, 1).alias("piece")).where(F.length("piece") > 0)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    last = F.substring_index("value", _OPENING, -1)
    ends = files.select("file", F.when(F.contains("value", F.lit(_OPENING)), F.substring_index(last, "\n", 1)).alias("end")) \
        .select("file", F.last("end", ignorenulls=True).over(before).alias("end")).select("file", opened(F.col("end")).alias("p"))
    # by merging: a file in gzip looks small, but what stands ahead may be all of it
    found = asked(within).unionByName(asked(ahead.join(ends.hint("merge"), "file")))
    return _qa_rows(found.select("p.title", "p.context", "qa"))


def read_squad(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from SQuAD files ``{"version", "data": [...]}`` of any
    origin; each file is one JSON value, hence one task."""
    doc = Ty.StructType([Ty.StructField("version", Ty.StringType()), Ty.StructField("data", Ty.ArrayType(_ENTRY))])
    df = spark.read.schema(doc).option("multiLine", True).json(path)
    return _entry_rows(df.select(F.explode("data").alias("e")).select("e.*"))


def data_entries(paras: DataFrame) -> DataFrame:
    """B2: one SQuAD ``data`` entry per paragraph: ``{title, paragraphs: [{context, qas}]}``."""
    return paras.select(
        "first_doc_id", "first_chunk_no", "first_q_no",
        F.struct(F.col("title"),
                 F.array(F.struct("context", "qas")).alias("paragraphs")).alias("entry"))


def dataset_path(base: str, task_id: str) -> str:
    """Default location of a task's nested dataset under a corpus root."""
    return f"{base.rstrip('/')}/{DATASET_PATH_FORMAT % task_id}"


def write_nested(paras: DataFrame, path: str, mode: str = "overwrite") -> None:
    """B2 sink: the ``data`` array as JSON lines in first-seen order (a
    distributed range sort), plus a one-line ``_version/`` table.  Non-ASCII
    text is written as is.  Readers rebuild the single document by wrapping the
    lines; nothing is merged on the driver."""
    entries = data_entries(paras).orderBy("first_doc_id", "first_chunk_no", "first_q_no")
    entries.select("entry.*").write.mode(mode).json(f"{path.rstrip('/')}/data")
    spark = paras.sparkSession
    spark.createDataFrame([(SQUAD_VERSION,)], "version string").coalesce(1) \
        .write.mode(mode).json(f"{path.rstrip('/')}/_version")


_QA = Ty.StructType([
    Ty.StructField("id", Ty.StringType()), Ty.StructField("question", Ty.StringType()),
    Ty.StructField("answers", Ty.ArrayType(Ty.StructType([
        Ty.StructField("text", Ty.StringType()),
        Ty.StructField("answer_start", Ty.IntegerType())])))])
_ENTRY = Ty.StructType([
    Ty.StructField("title", Ty.StringType()),
    Ty.StructField("paragraphs", Ty.ArrayType(Ty.StructType([
        Ty.StructField("context", Ty.StringType()),
        Ty.StructField("qas", Ty.ArrayType(_QA))])))])


def _qa_rows(df: DataFrame) -> DataFrame:
    one = F.try_element_at(F.col("qa.answers"), F.lit(1))
    return df.select("title", "context", "qa.id", "qa.question", one["text"].alias("answer"),
                     one["answer_start"].alias("answer_start"))


def _entry_rows(entries: DataFrame) -> DataFrame:
    return _qa_rows(entries.select("title", F.explode("paragraphs").alias("p"))
                    .select("title", "p.context", F.explode("p.qas").alias("qa")))


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Round trip of :func:`write_nested` back to flat QA rows."""
    return _entry_rows(spark.read.schema(_ENTRY).json(f"{path.rstrip('/')}/data"))

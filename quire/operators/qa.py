"""Question generation, answer extraction and QA rows.

Questions and answers come from native rules by default, so every job
runs and is checkable without model weights; a model plugs in through
:func:`answer_with_model` (Arrow batches, one model per Python worker).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# --- fixed values: rule-based question generator -----------------------------
WHO_WORDS = ["he", "she", "they", "person", "people"]
WHAT_WORDS = ["what", "which", "how"]
WHEN_WORDS = ["today", "yesterday", "year", "month"]
WHERE_WORDS = ["where", "location", "place", "city", "country"]
WHO_QUESTION = "Who is mentioned in this text?"
WHAT_QUESTION = "What is the main topic discussed?"
WHEN_QUESTION = "When did this occur?"
WHERE_QUESTION = "Where did this take place?"
DEFAULT_QUESTIONS = ["What is the main point of this text?",
                     "What information is provided in this passage?"]
MAX_QUESTIONS = 3
NOT_AVAILABLE = "Not available"
# ------------------------------------------------------------------------------

# ``str.isdigit``: decimal digits plus the digit-type characters (superscripts,
# circled digits, ...), the latter derived from Python's own rule.
DIGIT_EXTRA = "".join(ch for ch in map(chr, range(0x110000)) if ch.isdigit() and not ch.isdecimal())
DIGIT_CLASS = "[\\p{Nd}" + DIGIT_EXTRA + "]"


def _lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _is_digits(w: Column) -> Column:
    """``w.isdigit()``.  The full class (with the non-decimal digit-type
    characters) is slow in Java's matcher, so it only runs for words that
    start with a non-ASCII character or an ASCII digit; OR/AND short-circuit
    per row."""
    first = F.ascii(w)  # code point of the first character, O(1)
    maybe = (first > 127) | first.between(48, 57)
    return maybe & (w.rlike("^\\p{Nd}+\\z") | w.rlike(f"^{DIGIT_CLASS}+\\z"))


_WORDS = WHO_WORDS + WHAT_WORDS + WHEN_WORDS + WHERE_WORDS
#: The words that fire a question and numbers of ASCII digits, where they stand as
#: whole whitespace tokens of a lower-cased text.
_FIRING = "(?=[" + "".join(sorted({w[0] for w in _WORDS})) + f"0-9])(?<![^{T.WS[1:]})(?:" + "|".join(_WORDS) + \
    f"|[0-9]++)(?![^{T.WS[1:]})"
#: Characters beyond ASCII that may be digits: no letter, mark, punctuation, symbol, separator.
_MAY_BE_DIGIT = r"[^\x00-\x7F\p{L}\p{M}\p{P}\p{S}\p{Z}]"


def rule_questions(text, limit: int = MAX_QUESTIONS) -> Column:
    """who/what/when/where questions fired by whole whitespace tokens
    (compared lower-case), in that order, at most ``limit``; two default
    questions when none fires.  A token of digits (``str.isdigit``) also fires "when".

    One regex finds the tokens that fire, so that the others never become strings;
    a text is split for its digits only if it has any beyond ASCII."""
    c = T._col(text)

    def fire(hits):
        digits = F.exists(hits, lambda w: F.ascii(w).between(48, 57)) | \
            F.when(c.rlike(_MAY_BE_DIGIT), F.exists(T.py_split(c), _is_digits)).otherwise(False)
        return F.array_compact(F.array(
            F.when(F.arrays_overlap(hits, _lit_array(WHO_WORDS)), F.lit(WHO_QUESTION)),
            F.when(F.arrays_overlap(hits, _lit_array(WHAT_WORDS)), F.lit(WHAT_QUESTION)),
            F.when(digits | F.arrays_overlap(hits, _lit_array(WHEN_WORDS)), F.lit(WHEN_QUESTION)),
            F.when(F.arrays_overlap(hits, _lit_array(WHERE_WORDS)), F.lit(WHERE_QUESTION))))

    hits = F.regexp_extract_all(F.lower(c), F.lit(_FIRING), 0)
    return T.let(T.let(hits, fire), lambda fired: F.when(
        F.size(fired) == 0, _lit_array(DEFAULT_QUESTIONS)).otherwise(F.slice(fired, 1, limit)))


def parse_questions(raw, limit: int = MAX_QUESTIONS) -> Column:
    """Generated text -> lines, stripped, blanks dropped, first ``limit``."""
    lines = F.transform(F.split(T._col(raw), "\n", -1), T.py_strip)
    return F.slice(F.filter(lines, lambda q: q != F.lit("")), 1, limit)


def question_prompt(text, n: int = MAX_QUESTIONS) -> Column:
    """Prompt asking a generator for ``n`` questions about ``text``."""
    return F.concat(F.lit(f"Write {n} questions that the following passage answers, one per line.\n"),
                    T._col(text))


def text_prefix(text, n: int = 1000) -> Column:
    """The first ``n`` characters."""
    return F.substring(T._col(text), 1, n)


#: The word tokens of the rule questions, as whole tokens of a lower-cased text.
_ASKED = sorted({w for q in [WHO_QUESTION, WHAT_QUESTION, WHEN_QUESTION, WHERE_QUESTION, *DEFAULT_QUESTIONS]
                 for w in re.findall("[a-z]+", q.lower())})
# Java looks behind by code points only where the pattern itself has one beyond U+FFFF
_ALNUM = T.TOKEN[:-2] + "\U0001D7D8]"
_ASKED_TOKEN = "(?=[" + "".join(sorted({w[0] for w in _ASKED})) + f"])(?<!{_ALNUM})(?:" + "|".join(_ASKED) + f")(?!{_ALNUM})"


def sentence_index(context, rule: bool = False) -> Column:
    """Per context, once: its sentences and their distinct word tokens; with ``rule``
    only those that a rule question holds, which is all that such a question meets."""
    def tokens(s: Column) -> Column:
        return F.regexp_extract_all(F.lower(s), F.lit(_ASKED_TOKEN), 0) if rule else T.word_tokens(s)
    return F.transform(T.sentence_spans(context),
                       lambda s: F.struct(s.alias("s"), F.array_distinct(tokens(s)).alias("tok")))


def best_sentence(question, sentences: Column) -> Column:
    """F6 default: the sentence sharing most distinct word tokens with the
    question (earliest on ties) -> ``struct(answer, overlap, score)``."""
    def with_q(qtok):
        def pick(scored):
            top = F.array_max(scored)
            best = F.array_position(scored, top)
            answer = F.coalesce(F.try_element_at(sentences, best.cast("int"))["s"], F.lit(""))
            overlap = F.coalesce(top, F.lit(0))
            score = F.when(F.size(qtok) > 0, overlap / F.size(qtok)).otherwise(F.lit(0.0))
            return F.struct(answer.alias("answer"), overlap.alias("overlap"), score.alias("score"))
        return T.let(F.transform(sentences, lambda x: F.size(F.array_intersect(qtok, x["tok"]))), pick)
    return T.let(F.array_distinct(T.word_tokens(question)), with_q)


def answer_offset(answer, context) -> Column:
    """``context.find(answer)``: 0-based, -1 when absent, 0 for ''."""
    return F.call_function("instr", T._col(context), T._col(answer)) - 1


def questions_with_answers(chunks: DataFrame, id_cols: Sequence[str], context_col: str = "text",
                           questions: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Chunk x its questions (lateral posexplode), each answered by the
    default extractive rule.  Output: ``(*id_cols, *keep, context, q_no,
    question, answer, answer_start, score)``.

    The chunk's sentences are indexed once and every question is answered in
    the same per-chunk expression; the answers are generator output, so a
    later filter on them (e.g. ``answer_start <> -1``) cannot be pushed below
    and re-run the extraction.
    """
    qs = questions if questions is not None else rule_questions(context_col)
    ctx = F.col(context_col)

    def answer_all(sent: Column) -> Column:
        def one(q: Column) -> Column:
            return T.let(best_sentence(q, sent), lambda b: F.struct(
                q.alias("question"), b["answer"].alias("answer"),
                answer_offset(b["answer"], ctx).alias("answer_start"),
                b["score"].alias("score")))
        return F.transform(qs, one)

    answered = T.let(sentence_index(context_col, rule=questions is None), answer_all)
    base = chunks.select(*id_cols, *keep, ctx.alias("context"), answered.alias("_qa"))
    return (T.explode_indexed(base, [*id_cols, *keep, "context"], F.col("_qa"), "q_no", "_a")
            .select(*id_cols, *keep, "context", "q_no", "_a.question", "_a.answer",
                    "_a.answer_start", "_a.score"))


def structured_id(doc_col: str = "doc_id", chunk_col: str = "chunk_no", q_col: str = "q_no") -> Column:
    """``{doc}_chunk_{i}_qa_{j}`` (fixed format), both ordinals 0-based."""
    return F.format_string("%s_chunk_%d_qa_%d", F.col(doc_col).cast("string"),
                           F.col(chunk_col), F.col(q_col))


def record_id(*cols: str) -> Column:
    """Deterministic record id (md5 of the lineage), instead of a random uuid."""
    return F.md5(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols]))


def train_examples(flat: DataFrame) -> DataFrame:
    """Drop answers that were not found, keep the first answer."""
    return (flat.where(F.col("answer_start") != -1)
            .select("id", "context", "question",
                    F.col("answer_text"), F.col("answer_start")))


def answer_with_model(df: DataFrame, make_model: Callable, question_col: str = "question",
                      context_col: str = "context", batch_size: int = 64) -> DataFrame:
    """F6 plug-in: ``make_model()`` returns ``f(questions, contexts) -> (answers,
    starts, scores)`` over NumPy arrays; runs on Arrow batches.  A missing
    start falls back to :func:`answer_offset` (first occurrence)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

    schema = StructType([StructField("answer", StringType()), StructField("start", IntegerType()),
                         StructField("score", DoubleType())])

    def make_predict_fn():
        model = make_model()

        def predict(questions, contexts):
            answers, starts, scores = model(questions, contexts)
            return {"answer": answers, "start": starts, "score": scores}
        return predict

    udf = predict_batch_udf(make_predict_fn, return_type=schema, batch_size=batch_size)
    out = df.withColumn("_m", udf(F.col(question_col), F.col(context_col)))
    return (out.withColumn("answer", F.col("_m.answer"))
            .withColumn("answer_start", F.coalesce(F.col("_m.start"),
                                                   answer_offset(F.col("_m.answer"), F.col(context_col))))
            .withColumn("score", F.col("_m.score")).drop("_m"))


def generate_questions(chunks: DataFrame, make_model: Callable, text_col: str = "text",
                       n: int = MAX_QUESTIONS, out_col: str = "questions",
                       batch_size: int = 16) -> DataFrame:
    """ask a caller-supplied generator for ``n`` questions per chunk
    (prompt D17 on Arrow batches), then parse its raw text natively: lines,
    stripped, blanks dropped, at most ``n``.  Feed the result to
    :func:`questions_with_answers` with ``questions=F.col(out_col)``."""
    from quire.operators.rag import generate_with_model
    prompted = chunks.withColumn("_prompt", question_prompt(text_col, n))
    raw = generate_with_model(prompted, make_model, "_prompt", "_raw", batch_size, token_budget=None)
    return raw.withColumn(out_col, parse_questions("_raw", n)).drop("_prompt", "_raw")

"""Split and scoring.

Scores are computed per row with array functions (no token explode, no
shuffle); only the final mean is an aggregation, with partial aggregation on
the map side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vectors as V

# Punctuation removed by the SQuAD answer normaliser (ASCII punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
EVAL_FRACTION = 0.1
EVAL_FRACTION_BUCKETS = 10  # one bucket of ten -> 10% eval


def split_bucket(id_col) -> Column:
    """Stable bucket 0..9 from the md5 of the id: reproducible, order-free, no shuffle."""
    return F.pmod(F.conv(F.substring(F.md5(T._col(id_col).cast("string")), 1, 8), 16, 10)
                  .cast("bigint"), F.lit(EVAL_FRACTION_BUCKETS)).cast("int")


def train_eval_split(df: DataFrame, id_col: str = "id") -> DataFrame:
    """L1: adds ``split`` = 'eval' for bucket 0 (about 10%), else 'train'."""
    return df.withColumn("split", F.when(split_bucket(id_col) == 0, F.lit("eval"))
                         .otherwise(F.lit("train")))


def split_hash(key_col, seed: int = 0) -> Column:
    """60 bits of the md5 of ``seed|key``: the order in which units go to the
    evaluation side."""
    key = F.concat(F.lit(f"{seed}|"), T._col(key_col).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def exact_split(df: DataFrame, by: str = "id", fraction: float = EVAL_FRACTION, seed: int = 0) -> DataFrame:
    """L1: adds ``split``, with exactly ``ceil(fraction * n)`` of the ``n`` distinct
    values of ``by`` in 'eval' and the others in 'train'; rows that share a value
    stay together (split by a document's id and its chunks are on one side).

    The units with the least hashes are chosen.  What the last of them is comes from
    a radix selection: a histogram of the hashes' next 16 bits, at most 65,536 rows,
    finds the bucket in which the number is reached, then only that bucket is looked
    at, four times at most.  Units with that very hash go by their value.  The split
    itself is a test on each row, without a join; rows without a value are 'train'.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be between 0 and 1")
    from quire.session import materialize
    units = materialize(df.select(F.col(by).alias("u")).where("u is not null").distinct()
                        .select("u", split_hash("u", seed).alias("h")), "split-units")
    left = math.ceil(round(fraction * units.count(), 6))
    h, side = split_hash(by, seed), F.lit(False)
    if left:
        low, high = 0, 1 << 60  # the last chosen hash is in [low, high)
        for bits in (44, 28, 12, 0):
            digit = F.shiftright("h", bits)
            found = units.where((F.col("h") >= low) & (F.col("h") < high)).groupBy(digit.alias("d")) \
                .agg(F.count(F.lit(1)).alias("n")) \
                .withColumn("upto", F.sum("n").over(Window.orderBy("d"))) \
                .where(F.col("upto") >= left).orderBy("d").first()
            left -= found["upto"] - found["n"]
            low, high = found["d"] << bits, (found["d"] + 1) << bits
        last = units.where(F.col("h") == low).orderBy("u").limit(left).agg(F.max("u").alias("u")).first()["u"]
        side = (h < low) | ((h == low) & (F.col(by) <= F.lit(last)))
    return df.withColumn("split", F.when(side, F.lit("eval")).otherwise(F.lit("train")))


def normalize_answer(c) -> Column:
    """SQuAD normaliser: lower, drop ASCII punctuation, drop the articles
    a/an/the as whole words, collapse whitespace."""
    punct = "[" + "".join("\\" + ch for ch in PUNCTUATION) + "]"
    s = F.regexp_replace(F.lower(T._col(c)), punct, "")
    # whole words by Python's definition of a word character (letters, all
    # numerics, underscore); Java's Unicode \b differs on marks and No digits
    word = r"[\p{L}\p{N}_]"
    s = F.regexp_replace(s, f"(?<!{word})(" + "|".join(ARTICLES) + f")(?!{word})", " ")
    return F.array_join(T.py_split(s), " ")


def _tokens(norm: Column) -> Column:
    return T.py_split(norm)


def em_f1_columns(pred, truth) -> tuple[Column, Column]:
    """Per-pair exact match and token-multiset F1, both in [0, 1]."""
    p, g = normalize_answer(pred), normalize_answer(truth)
    em = F.when(p == g, F.lit(1.0)).otherwise(F.lit(0.0))

    def with_tokens(pair):
        pt, gt = pair["p"], pair["g"]
        common = F.aggregate(
            F.array_distinct(pt), F.lit(0),
            lambda acc, t: acc + F.least(F.size(F.filter(pt, lambda x: x == t)),
                                         F.size(F.filter(gt, lambda x: x == t))))

        def f1_of(c):
            prec = c / F.size(pt)
            rec = c / F.size(gt)
            return F.when(c == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
        return T.let(common, f1_of)

    f1 = T.let(F.struct(_tokens(p).alias("p"), _tokens(g).alias("g")), with_tokens)
    return em, f1


def score_pairs(pairs: DataFrame, pred_col: str = "prediction_text",
                truth_col: str = "answer_text") -> DataFrame:
    """G4/H6 per pair: adds ``em`` and ``f1`` (0..1)."""
    em, f1 = em_f1_columns(pred_col, truth_col)
    return pairs.withColumn("em", em).withColumn("f1", f1)


def squad_em_f1(predictions: DataFrame, references: DataFrame, id_col: str = "id") -> DataFrame:
    """H6: mean exact match and F1 (x100) over all references, predictions aligned
    on ``id``: a reference without a prediction scores 0 and counts in
    ``n_missing``.  Duplicate ids on either side are an error upstream; here they
    are reported in ``n_dup_ids`` rather than silently averaged.  The sums per id
    stand where the join has put the ids, so the mean takes no further shuffle of
    rows."""
    refs = references.select(id_col, "answer_text")
    preds = predictions.select(id_col, "prediction_text")
    pairs = refs.join(preds.withColumn("_found", F.lit(True)), id_col, "left")
    absent = F.col("_found").isNull()
    scored = score_pairs(pairs.withColumn("prediction_text", F.coalesce("prediction_text", F.lit("")))) \
        .withColumn("em", F.when(absent, F.lit(0.0)).otherwise(F.col("em"))) \
        .withColumn("f1", F.when(absent, F.lit(0.0)).otherwise(F.col("f1")))
    per_id = scored.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(absent).alias("missing"),
                                        F.sum("em").alias("em"), F.sum("f1").alias("f1"))
    return per_id.agg(
        F.coalesce(F.sum("missing"), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("n") - F.count(id_col), F.lit(0)).alias("n_dup_ids"),
        (F.sum("em") / F.sum("n") * 100).alias("exact_match"),
        (F.sum("f1") / F.sum("n") * 100).alias("f1"))


def best_of_answers(predictions: DataFrame, references: DataFrame, id_col: str = "id") -> DataFrame:
    """H6 per question with several gold answers: ``(id, em, f1, n_answers, n_rows,
    missing)``.  ``references`` holds ``answers`` (an array of texts), ``predictions``
    a ``prediction_text``; a prediction's exact match and F1 are the greatest over all
    gold answers of its id, as rows of one id hold answers to one question.  Without
    a prediction, or without a gold answer, both are 0 (an empty text is an answer).

    Answers are compared inside their row (no explode); rows of one id meet once, in
    the join's own partitioning.  Several predictions of one id: the first by text
    counts."""
    preds = predictions.groupBy(id_col).agg(F.min("prediction_text").alias("prediction_text"))
    pairs = references.select(id_col, F.coalesce(F.filter("answers", F.isnotnull), F.array().cast("array<string>")).alias("_a")) \
        .join(preds, id_col, "left")
    each = F.transform("_a", lambda a: F.struct(*[
        c.alias(n) for n, c in zip(("em", "f1"), em_f1_columns(F.coalesce("prediction_text", F.lit("")), a))]))
    there = F.col("prediction_text").isNotNull()
    scored = pairs.select(id_col, "_a", there.alias("_there"), F.when(there, each).alias("_s"))
    return scored.groupBy(id_col).agg(
        F.coalesce(F.max(F.array_max(F.col("_s.em"))), F.lit(0.0)).alias("em"),
        F.coalesce(F.max(F.array_max(F.col("_s.f1"))), F.lit(0.0)).alias("f1"),
        F.sum(F.size("_a")).alias("n_answers"), F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(~F.col("_there")).alias("missing"))


def squad_best_of(predictions: DataFrame, references: DataFrame, id_col: str = "id") -> DataFrame:
    """H6 over questions with several gold answers: ``(n, n_answers, n_missing,
    n_dup_ids, exact_match, f1)``, the means (x100) of :func:`best_of_answers` over
    the distinct ids; ``n_dup_ids`` counts rows beyond an id's first."""
    best = best_of_answers(predictions, references, id_col)
    return best.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_answers"), F.lit(0)).alias("n_answers"),
                    F.count_if("missing").alias("n_missing"),
                    F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n_dup_ids"),
                    (F.avg("em") * 100).alias("exact_match"), (F.avg("f1") * 100).alias("f1"))


def argmax_em(logits: DataFrame, logits_col: str = "start_logits", label_col: str = "label_start") -> DataFrame:
    """Share of rows whose first-max logit index equals the label."""
    hit = (V.argmax(logits_col) == F.col(label_col)).cast("double")
    return logits.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("exact_match"))

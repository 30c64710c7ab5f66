"""Prompts and answers over retrieved context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import qa as Q

# --- fixed values --------------------------------------------------------------
PROMPT_TOKEN_BUDGET = 512
MAX_NEW_TOKENS = 250
# zero-shot layout: "Context:\n{context}\n\nQuestion: {question}\nAnswer:"
ZERO_SHOT_PARTS = ("Context:\n", "\n\nQuestion: ", "\nAnswer:")
# ---------------------------------------------------------------------------------

_FEW_SHOT_HEAD = (
    "Answer the question using only the context. If the context does not contain "
    "the answer, reply 'Not available'.\n\n"
    "Context:\nThe library opens at nine and closes at five on weekdays.\n"
    "Question: When does the library close on weekdays?\n"
    "Answer: At five.\n\n"
    "Context:\nThe bridge was painted green in the spring.\n"
    "Question: Who designed the bridge?\n"
    "Answer: Not available\n\n"
    "Context:\n")


def zero_shot_prompt(context, question) -> Column:
    """Context, blank line, question, answer cue."""
    head, mid, tail = ZERO_SHOT_PARTS
    return F.concat(F.lit(head), T._col(context), F.lit(mid), T._col(question), F.lit(tail))


def few_shot_prompt(context, question) -> Column:
    """Two worked examples, then the context and question."""
    return F.concat(F.lit(_FEW_SHOT_HEAD), T._col(context), F.lit("\nQuestion: "),
                    T._col(question), F.lit("\nAnswer:"))


def default_answer(context, question) -> Column:
    """F3 default: the context sentence with most shared question words, or
    'Not available' when no sentence shares any."""
    return T.let(Q.best_sentence(question, Q.sentence_index(context)), lambda best: F.when(
        best["overlap"] > 0, best["answer"]).otherwise(F.lit(Q.NOT_AVAILABLE)))


def generate_with_model(df: DataFrame, make_model: Callable, prompt_col: str = "prompt",
                        out_col: str = "response", batch_size: int = 16,
                        token_budget: int | None = PROMPT_TOKEN_BUDGET) -> DataFrame:
    """F3 plug-in: ``make_model()`` returns ``f(prompts) -> responses`` over a
    NumPy array; prompts are cut to ``token_budget`` tokens first (E6), their line
    breaks kept; None hands them over whole."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import StringType

    def make_predict_fn():
        model = make_model()
        return lambda prompts: model(prompts)

    udf = predict_batch_udf(make_predict_fn, return_type=StringType(), batch_size=batch_size)
    prompt = F.col(prompt_col) if token_budget is None else T.cut_tokens(prompt_col, token_budget)
    return df.withColumn(out_col, udf(prompt))

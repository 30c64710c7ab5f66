"""text embedding.

The default embedder is a hashed bag of words (lower-cased letter/digit
tokens, md5 bucket modulo ``dim``, L2-normalised, float32): deterministic and
model-free.  A real model plugs in through :func:`embed_with_model`, which runs it
once per Python worker on Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

DEFAULT_DIM = 64


@lru_cache(maxsize=1 << 16)
def _token_hash(token: str) -> int:
    """The first 32 bits of a token's md5, kept for the tokens last seen by the worker."""
    return int.from_bytes(hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[:4], "big")


def _bucket_counts(tokens: pa.ListArray, dim: int):
    """Row, bucket and count of every bucket that a row's tokens hit: the batch's
    tokens as an Arrow dictionary, one hash for each distinct one, counts by CSR."""
    flat = tokens.flatten().dictionary_encode()
    bucket = np.fromiter(map(_token_hash, flat.dictionary.to_pylist()), np.int64, len(flat.dictionary)) % dim
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), sizes)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    at = row * dim + bucket[codes]
    if len(tokens) * dim <= 4 * len(at):  # a count for every cell takes less than sorting the hits
        every = np.bincount(at, minlength=1)
        cell = np.flatnonzero(every)
        count = every[cell]
    else:
        cell, count = np.unique(at, return_counts=True)
    row, bucket = cell // dim, cell % dim
    norm = np.sqrt(np.bincount(row, weights=count.astype(np.float64) ** 2, minlength=len(tokens)))
    return row, bucket, (count / norm[row]).astype(np.float32)


def _dense(dim: int):
    @F.arrow_udf("array<float>")
    def embed(tokens: pa.Array) -> pa.Array:
        row, bucket, weight = _bucket_counts(tokens, dim)
        out = np.zeros((len(tokens), dim), np.float32)
        out[row, bucket] = weight
        off = pa.array(np.arange(0, out.size + 1, dim), pa.int32(), mask=np.append(tokens.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(off, pa.array(out.ravel()))
    return embed


def _sparse(dim: int):
    @F.arrow_udf("array<struct<bucket: int, weight: float>>")
    def embed(tokens: pa.Array) -> pa.Array:
        row, bucket, weight = _bucket_counts(tokens, dim)
        off = pa.array(np.searchsorted(row, np.arange(len(tokens) + 1)), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(weight)], names=["bucket", "weight"])
        return pa.ListArray.from_arrays(off, pairs)
    return embed


def embedding_column(text_col: str | Column, dim: int = DEFAULT_DIM) -> Column:
    """Dense hashed embedding of a text column (null for a null text).  Tokens are
    cut in the JVM; hashing and counting run over Arrow batches, one md5 for each
    distinct token of a batch, so the cost does not depend on ``dim`` beyond writing
    the vector."""
    return _dense(dim)(T.word_tokens(text_col))


def hash_embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
               dim: int = DEFAULT_DIM) -> DataFrame:
    """Adds a dense ``array<float>`` embedding column; a narrow transformation."""
    return df.withColumn(out_col, embedding_column(text_col, dim))


def hash_embed_sparse(df: DataFrame, id_cols: Sequence[str], text_col: str = "text",
                      dim: int = DEFAULT_DIM) -> DataFrame:
    """Sparse form ``(*id_cols, bucket, weight)`` of the same embedding: only the
    buckets that are hit are ever made, whatever ``dim`` is; no shuffle."""
    pairs = df.select(*id_cols, F.explode(_sparse(dim)(T.word_tokens(text_col))).alias("_p"))
    return pairs.select(*id_cols, "_p.bucket", F.col("_p.weight").cast("double").alias("weight"))


def embed_with_model(df: DataFrame, text_col: str, make_model: Callable,
                     out_col: str = "embedding", dim: int | None = None,
                     batch_size: int = 256) -> DataFrame:
    """Embed with a caller-supplied model: ``make_model()`` returns a function
    mapping a NumPy array of strings to a 2-D float array.  The model is built
    once per Python worker and fed Arrow batches of ``batch_size`` rows."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    def make_predict_fn():
        model = make_model()

        def predict(texts):
            return model(texts)
        return predict

    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()),
                            batch_size=batch_size,
                            input_tensor_shapes=None)
    out = df.withColumn(out_col, udf(F.col(text_col)))
    if dim is not None:
        out = out.where(F.size(out_col) == dim)
    return out

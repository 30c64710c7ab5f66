"""RAG plan: corpus -> wrapped chunks -> hashed embeddings -> stored index; queries ->
embedding -> exact top-k -> context -> prompt -> answer.  Many queries at once;
the ranked hits are written before their texts are fetched from the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunking, embed, knn, rag
from quire.sources.tables import spread

DEFAULT_K = 3
CHUNK_WIDTH = 500
ID = ("doc_id", "chunk_no")


def build_index(docs: DataFrame, width: int = CHUNK_WIDTH, dim: int = embed.DEFAULT_DIM,
                source_col: str = "source") -> DataFrame:
    """H1: ``(doc_id, chunk_no, source, text, embedding)``; narrow end to end.

    A vector's id is the pair ``(doc_id, chunk_no)``.  ``doc_id`` must be an
    integer; number path-keyed corpora first with
    :func:`quire.sources.tables.number_rows`."""
    from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType
    if not isinstance(docs.schema["doc_id"].dataType, (LongType, IntegerType, ShortType, ByteType)):
        raise TypeError("build_index needs an integer doc_id; number the documents first "
                        "(quire.sources.tables.number_rows) and keep the path as `source`")
    docs = spread(docs, "doc_id")
    chunks = chunking.wrap_chunks(docs, ("doc_id",), "text", width, keep=(source_col,))
    return embed.hash_embed(chunks, "text", "embedding", dim) \
        .select("doc_id", "chunk_no", F.col(source_col).alias("source"), "text", "embedding")


def retrieve(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
             dim: int = embed.DEFAULT_DIM) -> DataFrame:
    """``(qid, rank, doc_id, chunk_no, dist)`` for ``queries(qid, query)``; a
    column ``top_k`` of the queries is each query's own number of hits (null: ``k``)."""
    own = [F.col("top_k")] if "top_k" in queries.columns else []
    q = embed.hash_embed(queries.select("qid", "query", *own), "query", "embedding", dim)
    return knn.knn_topk(index, q, k, corpus_id=ID, corpus_vec="embedding",
                        query_id="qid", query_vec="embedding", k_col="top_k" if own else None)


def contexts(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """``(qid, context, n_hits)``.  The search reads ids and vectors of the
    index; the texts of the ranked hits are fetched from it by their ids.  Pass a
    stored index (:func:`stored_index`, :func:`load_index`): it is read several times."""
    top = knn.materialize(retrieve(index, queries, k))
    return knn.assemble_context(knn.attach_text(top, index, corpus_id=ID))


def answers(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """F3 with the default extractive answerer: ``(qid, query, context, prompt, response)``.
    Queries without any hit keep an empty context."""
    ctx = contexts(index, queries, k)
    joined = queries.select("qid", "query").join(ctx, "qid", "left") \
        .withColumn("context", F.coalesce("context", F.lit("")))
    return joined.select("qid", "query", "context",
                         rag.few_shot_prompt("context", "query").alias("prompt"),
                         rag.default_answer("context", "query").alias("response"))


def stored_index(spark, docs: DataFrame, path: str, **options) -> DataFrame:
    """H1: the index in ``path``, after documents that it has not yet were added
    (:func:`update_index`)."""
    update_index(spark, docs, path, **options)
    return load_index(spark, path)


def save_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the index as Parquet (one table: ids, text, source, vector).
    Rows are sorted by id within each partition (no shuffle), so row
    groups carry tight id ranges and id lookups skip most of them."""
    index.sortWithinPartitions(*ID).write.mode(mode).parquet(path)


def load_index(spark, path: str) -> DataFrame:
    """Read a persisted index (an integer ``doc_id``, whatever its width)."""
    return spark.read.parquet(path)


def update_index(spark, docs: DataFrame, path: str, width: int = CHUNK_WIDTH,
                 dim: int = embed.DEFAULT_DIM, key: str = "doc_id") -> int:
    """Index only documents whose ``key`` (``doc_id``, or e.g. the
    ``source`` path) was not indexed yet (left anti join) and append them;
    returns the number of documents added.  The first call builds the whole
    index.  Keys that were worked on stand in ``<path>/_done`` (also those of
    documents without a chunk); a run that stopped between the two writes finds
    its documents in the index itself and does not add them again."""
    done = f"{path.rstrip('/')}/_done"

    def there(folder):
        folder = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

    seen = spark.createDataFrame([], docs.select(key).schema)
    if there(path):  # a failed read raises
        seen = seen.unionByName(load_index(spark, path).select(key))
    if there(done):
        seen = seen.unionByName(spark.read.parquet(done))
    from quire.session import materialize
    # null-safe: documents without a key are indexed once, as those of any key
    fresh, seen = docs.select(key).distinct().alias("f"), seen.distinct().alias("s")
    keys = materialize(fresh.join(seen, F.col(f"f.{key}").eqNullSafe(F.col(f"s.{key}")), "left_anti"))
    n = keys.count()
    if n:
        new = docs.alias("d").join(keys.alias("k"), F.col(f"d.{key}").eqNullSafe(F.col(f"k.{key}")), "left_semi")
        save_index(build_index(new, width, dim), path, mode="append")
        keys.write.mode("append").parquet(done)
    return n

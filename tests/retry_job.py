"""Run in a subprocess by test_retry.py: a session that retries failed tasks,
with a pass-through stage that fails every task's first attempt."""
import json
import sys

sys.path.insert(0, sys.argv[1])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quire.operators import knn  # noqa: E402
from quire.plans import dataset  # noqa: E402

spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
sf = sys.argv[2]


def chaos(batches):
    from pyspark import TaskContext
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0:
        raise RuntimeError("injected failure: first attempt of every task")
    yield from batches


def flaky(df):
    return df.repartition(4).mapInArrow(chaos, df.schema)


emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
q = emb.select(F.col("vec_id").alias("qid"), "embedding")
clean_knn = sorted(tuple(r) for r in knn.knn_topk(emb, q, 3).select("qid", "rank", "vec_id").collect())
faulty_knn = sorted(tuple(r) for r in knn.knn_topk(flaky(emb), q, 3).select("qid", "rank", "vec_id").collect())
docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
clean_qa = sorted(r.id + "|" + r.answer for r in dataset.sentence_qa(docs).collect())
faulty_qa = sorted(r.id + "|" + r.answer for r in dataset.sentence_qa(flaky(docs)).collect())
print(json.dumps({"knn": clean_knn == faulty_knn and len(clean_knn) > 0,
                  "qa": clean_qa == faulty_qa and len(clean_qa) > 0}))

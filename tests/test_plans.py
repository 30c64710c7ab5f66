"""Plan shape: no query builds a cartesian product, scans read only the
columns they use, and the corpus is not shuffled by the kNN scan."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
STREAMS = {"stream_sentence_pack", "stream_latest_status", "task_status"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(E.queries()) - STREAMS))
def test_no_cartesian_products(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key,cols", [
    ("wrap_chunks", {"doc_id", "text"}),
    ("hash_embed", {"doc_id", "text"}),
    ("sentence_pack", {"doc_id", "text"}),
    ("incremental_anti", {"doc_id", "n_chars"}),
    ("latest_status", {"event_id", "ts", "user_id", "event_type", "props"}),
    ("ext_filter", {"page_id", "url"}),
])
def test_scans_are_pruned(spark, key, cols):
    plan = _plan(E.queries()[key](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas
    for s in schemas:
        read = {f.split(":")[0] for f in s.split(",")}
        assert read <= cols, (key, read)


def test_knn_meets_in_groups_of_cells(spark):
    import inspect

    from quire.operators import knn
    plan = _plan(E.queries()["knn_topk"](spark, SF))
    # both sides are dealt out by (cell, salt, part), the survivors by query; no side is
    # gathered on the driver or broadcast
    assert "CoGroups" in plan and "WindowGroupLimit" in plan
    assert "Broadcast" not in plan
    assert "toArrow" not in inspect.getsource(knn) and "broadcast(" not in inspect.getsource(knn)


def test_pages_take_one_exchange(spark):
    for key in ("page_concat", "page_concat_nl", "corpus_union"):
        assert _plan(E.queries()[key](spark, SF)).count("Exchange") == 1, key


@pytest.mark.parametrize("key", ["text_prefix", "qgen_prompt", "quarantine", "min_text_filter",
                                 "truncate_tokens", "parse_questions", "ext_filter", "path_parts"])
def test_cheap_row_queries_do_not_shuffle(spark, key):
    # per-row expressions run on the scan; only CPU-heavy folds spread first
    assert "Exchange" not in _plan(E.queries()[key](spark, "/root/testdata/sf0.01"))

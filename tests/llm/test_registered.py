"""The registered queries of the llm subpackage."""

import __spark_entry__ as E
from quire.llm import queries

#: Not SQL: held against brute force in the other modules here.
NO_ORACLE = {"op1_context_mixing", "op3_secret_scan", "op4_language_id", "op6_one_bit_codes", "op7_token_count",
             "op8_packing", "op9_bloom_lookup", "op13_quality_classifier", "pipeline"}


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(E.queries()) and len(queries.QUERIES) == 14
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == NO_ORACLE

"""Joins by a key that grows with the data are shuffled: no side of them is sent whole through the driver."""

import re

import pytest

from parapet.catalog import QUERIES
from parapet.sources import derived

SF = "/root/testdata/sf0.001"
KEYS = "model_id|doc_id|sheet|case_id"


@pytest.mark.parametrize(
    "name", ["E06_setback_formula", "H04_cap_candidates", "M01_edit_grid", "G04_rejected", "G04_chunk_two_level", "D05_within", "D09_inset_bent", "F03_status_rollup", "C15_bracket_height"]
)
def test_no_broadcast_by_key(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert not re.findall(rf"BroadcastHashJoin \[(?:{KEYS})#", plan)


@pytest.mark.parametrize("name", ["E18_evaluate", "F01_issue_counts", "F06_issue_groups", "M13_remedy_compound"])
def test_all_findings_shuffle_tables_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # tables are dealt by model where they are read; no ring, facts row or finding is shuffled after that
    assert "hashpartitioning(l_orderkey" in plan
    assert not re.findall(r"Exchange hashpartitioning\(model_id[^\n]*", plan)
    assert len({re.sub(r"#\d+L?", "", x) for x in re.findall(r"FileScan parquet \[l_orderkey[^\]]*\]", plan)}) == 1


def test_tables_dealt_by_model_are_the_same(spark):
    rows = lambda df: sorted(map(repr, df.collect()))
    plain, dealt = (derived.model_tables(spark, SF, x) for x in (False, True))
    assert {k for k in plain if rows(plain[k]) != rows(dealt[k])} == set()

"""Every registered query has a callable; a sample is compared with its SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

DIR = "/root/testdata/sf0.001"
SAMPLE = ["triple_state", "loss_causes", "person_flow", "stock", "flow_pairs", "decompose", "first_touch", "trigger_first_credit", "calendar_boundary", "step_months"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 230


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    ok, msg = compare(spark, duck(DIR), name, entry.queries()[name], entry.oracle_sql()[name], DIR)
    assert ok, msg


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["side", "cause", "n_triples", "n_persons", "amt"]

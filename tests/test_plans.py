"""Plan-shape checks: the scale properties the operators are designed for."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF0001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_is_one_scan_and_one_shuffle(spark):
    p = plan(E.queries()["decontaminate_exact"](spark, SF0001))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert len(re.findall(r"documents\.parquet", p)) == 1
    assert "n_chars" not in p.split("ReadSchema")[1].split("\n")[0]          # column pruning
    assert "partial_min_by" in p                                               # map-side keep-first


@pytest.mark.parametrize("name", ["integrate_corpora", "decontaminate_exact", "label_lists", "multi_hot",
                                  "metrics_per_label", "similarity_all", "similarity_density", "cosine_pairs",
                                  "pair_offsets", "encode_tokens", "binary_tanimoto_pairs"])
def test_no_cartesian_products(spark, name):
    p = plan(E.queries()[name](spark, SF0001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_reach_the_scan(spark):
    p = plan(E.queries()["parse_or_drop"](spark, SF0001))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,props:string>" in p


def test_dense_pairs_run_in_arrow_tiles(spark):
    p = plan(E.queries()["cosine_pairs"](spark, SF0001))
    assert "FlatMapGroupsInPandas" in p and "BatchEvalPython" not in p

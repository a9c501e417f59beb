"""Driver contract: entry() runs, and every query with an oracle matches DuckDB at sf0.001."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from sievekit.sources.tables import TABLES

from .conftest import SF0001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "key" in df.columns


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    return con


FAST = ["decontaminate_exact", "integrate_corpora", "multi_hot", "stratified_kfold", "metrics_per_label",
        "reaction_edges", "longest_chain", "binary_tanimoto_pairs", "cosine_pairs", "encode_tokens",
        "similarity_density", "record_attributes", "stream_decontaminate", "group_split", "key_matches", "metrics_masked",
        "parallel_lists", "minhash_fingerprint", "ridge_statistics"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF0001)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(df.columns)
    srows = Counter(tuple(_norm(r[c]) for c in order) for r in df.collect())
    drows = Counter(tuple(_norm(r[dcols.index(c)]) for c in order) for r in res.fetchall())
    assert srows == drows


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())

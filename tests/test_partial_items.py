"""Lists per composite key, fan-out, ragged files, long chains, masked metrics, vector encoders, quantiles of far values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.functions.udfs import ENCODERS
from sievekit.operators import aggs, graph, joins, metrics, quantiles
from sievekit.sources import files


def test_parallel_lists(spark):
    rows = [("a", 1, 3, "x", None), ("a", 1, 1, "y", 5), ("a", 1, 2, "x", 6), ("a", 2, 1, None, 7), (None, 1, 1, "z", 8)]
    got = aggs.parallel_lists(spark.createDataFrame(rows, "k string, g int, o int, name string, n int"), ["k", "g"], ["o"], ["name", "n"])
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([
        ("a", 1, ["y", "x", "x"], [5, 6, None]), ("a", 2, [None], [7]), (None, 1, ["z"], [8])], key=str)


def test_fan_out_is_kept(spark):
    a = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, "l")], "id int, key string")
    b = spark.createDataFrame([(5, "k"), (6, "k"), (7, "k"), (8, None)], "id int, key string")
    got = sorted((r["id_a"], r["id_b"]) for r in joins.fanout_join(a, b, "key").collect())
    assert got == [(x, y) for x in (1, 2) for y in (5, 6, 7)]


def test_ragged_files_read_back(spark, tmp_path):
    rows = [(1, ["a", "b", "c"]), (2, ["d"]), (3, [])]
    df = spark.createDataFrame(rows, "g int, v array<string>")
    assert files.write_ragged(df, "g", "v", str(tmp_path / "r")) == 3
    got = sorted((int(r["g"]), r["pos"], r["v"]) for r in files.read_ragged(spark, str(tmp_path / "r"), "g", "v").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")]
    files.write_ragged(df.filter("g = 3"), "g", "v", str(tmp_path / "none"))
    assert files.read_ragged(spark, str(tmp_path / "none"), "g", "v").count() == 0


def test_only_long_chains(spark):
    df = spark.createDataFrame([(1, 2, ["a", "b"]), (2, 3, ["c", "d", "e"])], "g int, chain_len int, chain array<string>")
    assert [tuple(r) for r in graph.chains_longer_than(df, "g", 2).orderBy("pos").collect()] == [(2, 0, "c"), (2, 1, "d"), (2, 2, "e")]


def test_masked_confusion(spark):
    long = lambda rows: spark.createDataFrame(rows, "id int, label string")
    train, test = long([(1, "a"), (1, "b"), (2, "c")]), long([(3, "a"), (4, "b"), (4, "d")])
    got = metrics.masked_confusion(train, test, long([(3, "a"), (3, "b"), (4, "c"), (4, "d")]), ["id"]).collect()
    assert {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in got} == {"a": (1, 0, 0), "b": (0, 1, 1)}


def test_vector_encoder(spark):
    got = spark.createDataFrame([("Aeè iOu u",), ("",), (None,)], "t string").select(ENCODERS["vowel_vector"]("t").alias("v")).collect()
    assert [r["v"] for r in got] == [[1, 1, 1, 1, 2], [0, 0, 0, 0, 0], None]


@pytest.mark.parametrize("far", [0, 1e12])
def test_quantiles_with_a_far_value(spark, far):
    rng = np.random.default_rng(1)
    x = np.r_[np.round(rng.random(3000), 2), far]
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)] + [(7, None)], "g int, x double")
    got = {r["g"]: (r["a"], r["b"]) for r in quantiles.exact_quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.99}).collect()}
    assert set(got) == {0, 1, 2}
    for k in range(3):
        assert got[k] == pytest.approx((np.quantile(x[g == k], 0.5), np.quantile(x[g == k], 0.99)))


def test_empty_quantiles(spark):
    none = spark.createDataFrame([], "g int, x double")
    assert quantiles.exact_quantiles(none.withColumn("x", F.col("x")), ["g"], "x", {"a": 0.5}).count() == 0

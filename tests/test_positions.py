"""Positions over range partitions, O(n) row sums and exact thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.operators import allpairs, clean, ranking, setsim


def test_hot_stratum_and_null_group(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                  .when(F.col("id") % 3 == 1, F.concat(F.lit("s"), (F.col("id") % 100).cast("string")))
                                  .alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = ranking.group_position(df, "g", "h").toPandas()
    assert len(got) == 6000
    want = got.sort_values("h").groupby("g", dropna=False).cumcount() + 1
    assert (want.sort_index() == got["pos"].sort_index()).all()


def test_label_index_loses_nothing(spark):
    d = clean.label_index(spark.range(120_000).select(F.format_string("L%07d", "id").alias("label")))
    r = d.agg(F.count("*").alias("n"), F.countDistinct("label_idx").alias("u"), F.max("label_idx").alias("m"),
              F.max(F.col("label") != F.format_string("L%07d", "label_idx")).alias("bad")).first()
    assert (r.n, r.u, r.m, r.bad) == (120_000, 120_000, 119_999, False)


def test_row_sums_vs_numpy(spark):
    x = np.random.default_rng(5).normal(size=(200, 8))
    x[7] = 0.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.row_sum for r in allpairs.similarity_row_sums(df, "id", "v").collect()}
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    want = (u @ u.T).sum(axis=1) - 1
    assert got[7] is None and len(got) == 200
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(200) if i != 7)


def test_near_copies_and_thresholds(spark):
    base = [f"w{k}" for k in range(30)]
    rows = [(i, base[:29] + [f"x{i}"]) for i in range(40)] + [(100 + i, base) for i in range(3)] + [(200, [])]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    sets = {i: set(w) for i, w in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a]
            and len(sets[a] & sets[b]) * 10 >= 9 * len(sets[a] | sets[b])}
    got = [(r.id_a, r.id_b) for r in setsim.prefix_join(df, None, "id", "w", 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        setsim.prefix_join(df, None, "id", "w", 0.1 + 0.2)

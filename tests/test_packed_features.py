"""Features on their way to the pairs: packed counts come back whole, and a line travels once."""

from pyspark.sql import functions as F

from sievekit.functions import similarity as S
from sievekit.operators import ranking


def test_counts_come_back(spark):
    rows = [([0, 1, 127],), ([128, 0, 5],), ([100_000, 2**30, 255],), ([],), (None,)]
    df = spark.createDataFrame(rows, "c array<int>").withColumn("p", S.packed_counts("c")).withColumn("u", S.unpacked_counts("p"))
    for r in df.collect():
        assert r["u"] == (None if r["c"] is None else [float(x) for x in r["c"]])
        assert (r["p"]["high"] is None) == all(x < 128 for x in r["c"] or [])


def test_lines_of_the_first_stretch_travel_once(spark):
    got = spark.range(0, 200).select("id", ranking._stretches(F.col("id"), 64, 6).alias("b")).collect()
    assert all(r["b"] == ([r["id"] // 64] if r["id"] < 64 or r["id"] % 64 >= 6 else [r["id"] // 64, r["id"] // 64 - 1]) for r in got)
    chains = spark.range(0, 1500).select((F.col("id") % 10).alias("g"), F.floor(F.col("id") / 10).alias("pos"), F.col("id").alias("n"))
    x = ranking.offset_pairs(chains, "g", "pos", "n", 6)
    assert sorted((r["mol1"], r["mol2"], r["separation"]) for r in x.collect()) == sorted(
        (a * 10 + g, b * 10 + g, b - a) for g in range(10) for a in range(150) for b in range(a + 1, min(a + 7, 150)))

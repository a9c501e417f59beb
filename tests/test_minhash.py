"""MinHash registers against plain minima, merging, the estimate's error; the greatest cross similarity."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sievekit.operators import minhash, setsim

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, t array<string>"


def by_hand(tokens):
    h = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in set(tokens)]
    return [min((x * a + b) % minhash.P for x in h) for a, b in minhash.permutations()]


def test_registers(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["é", "日本", ""]), (3, [str(k) for k in range(5000)]), (4, []), (5, None), (1, ["c"])]
    got = {r["id"]: r for r in minhash.fingerprints(spark.createDataFrame(rows, SCHEMA), "id", "t").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["registers"] == by_hand("abc") and got[3]["registers"] == by_hand(rows[2][1])
    assert got[2]["registers"] == by_hand(rows[1][1]) and got[3]["n_tokens"] == 5000


def test_merged_registers_are_those_of_the_union(spark):
    rng = random.Random(3)
    rows = [(k, [str(rng.randrange(400)) for _ in range(60)]) for k in range(20)]
    prints = minhash.fingerprints(spark.createDataFrame(rows, SCHEMA), "id", "t").withColumn("g", F.col("id") % 3)
    for r in minhash.merge(prints, "g").collect():
        assert r["registers"] == by_hand([t for k, ts in rows if k % 3 == r["g"] for t in ts])


@pytest.mark.parametrize("j", [0.0, 0.5, 0.8])
def test_error_of_the_estimate(spark, j):
    """Mean within three standard errors over 200 pairs, each pair's spread as stated."""
    rng, n, rows = random.Random(int(j * 10)), 300, []
    both = round(2 * n * j / (1 + j))
    true = both / (2 * n - both)
    for p in range(200):
        words = [f"{p}-{rng.random()}" for _ in range(2 * n - both)]
        rows += [(2 * p, words[:n]), (2 * p + 1, words[n - both:])]
    prints = minhash.fingerprints(spark.createDataFrame(rows, SCHEMA), "id", "t")
    a = prints.filter("id % 2 = 0").select(F.expr("id div 2").alias("p"), F.col("registers").alias("a"))
    b = prints.filter("id % 2 = 1").select(F.expr("id div 2").alias("p"), F.col("registers").alias("b"))
    got = np.array([r["s"] for r in a.join(b, "p").select(minhash.similarity(F.col("a"), F.col("b")).alias("s")).collect()])
    error = np.sqrt(true * (1 - true) / minhash.K)
    assert abs(got.mean() - true) <= 3 * error / np.sqrt(200) + 1e-9
    assert got.std() <= 1.3 * error + 1e-9


def test_fingerprints_of_the_corpus(spark):
    rows = E.queries()["minhash_fingerprint"](spark, SF).collect()
    assert rows and all(len(r["registers"].split()) == minhash.K for r in rows)


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0


@pytest.mark.parametrize("seed,likeness", [(1, 30), (3, 20_000)])
def test_greatest_similarity(spark, seed, likeness):
    rng = random.Random(seed)
    sets = lambda base: [(base + k, [str(rng.randrange(likeness)) for _ in range(rng.randint(0, 25))]) for k in range(40)]
    left, right = sets(0), sets(100)
    got = setsim.greatest_similarity(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "id", "t").collect()
    best = max((jaccard(a, b), -i, -j) for i, a in left for j, b in right)
    if best[0] == 0:
        assert got == []
    else:
        assert (pytest.approx(got[0]["sim"]), got[0]["id_a"], got[0]["id_b"]) == (best[0], -best[1], -best[2])


def test_nothing_in_common(spark):
    a, b = spark.createDataFrame([(1, ["x"]), (2, [])], SCHEMA), spark.createDataFrame([(3, ["y"]), (4, [])], SCHEMA)
    assert setsim.greatest_similarity(a, b, "id", "t").count() == 0
    assert setsim.greatest_similarity(a, b.limit(0), "id", "t").count() == 0


def test_languages_and_the_whole(spark, tmp_path):
    """The query's registers per language and their share of equal ones with the union of all."""
    rows = [(k, None if k == 5 else "xy"[k % 2], " ".join(chr(97 + (k * j) % 26) for j in range(30))) for k in range(8)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = {g: {" ".join(t.split()[j:j + 3]) for _, n, t in rows if n == g for j in range(28)} for g in "xy"}
    whole = by_hand(grams["x"] | grams["y"])
    got = {r["lang"]: r for r in E.queries()["minhash_merged"](spark, str(tmp_path)).collect()}
    assert set(got) == {"x", "y"}
    for g, r in got.items():
        assert r["registers"] == " ".join(map(str, by_hand(grams[g])))
        assert r["share_of_all"] == pytest.approx(np.mean(np.equal(by_hand(grams[g]), whole)), abs=1e-6)

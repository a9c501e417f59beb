"""Iterative stratification against the row-by-row rule in plain Python."""

import hashlib
import random
from collections import Counter

import pytest

import __spark_entry__ as E
from sievekit.operators import splits
from sievekit.plans.labels import order_labels

SF = "/root/testdata/sf0.001"


def by_hand(rows, k, rep):
    """{id: fold}; rows: {id: set of labels}."""
    total = Counter(x for labels in rows.values() for x in labels)
    want = {x: [n / k] * k for x, n in total.items()}
    size = [len(rows) / k] * k
    left, out = dict(rows), {}
    while left:
        n = Counter(x for labels in left.values() for x in labels)
        rare = min(n, key=lambda x: (n[x], x))
        for i in sorted((i for i in left if rare in left[i]), key=lambda i: hashlib.md5(f"{rep}|{i}".encode()).hexdigest()):
            fold = max(range(k), key=lambda j: (round(want[rare][j], 6), round(size[j], 6), -j))
            out[i] = fold
            size[fold] -= 1
            for x in left[i]:
                want[x][fold] -= 1
            del left[i]
    return out


def sets(df, key="o_orderkey"):
    rows = {}
    for i, x in df.select(key, "label").collect():
        rows.setdefault(i, set()).add(x)
    return rows


def shares(rows, folds, k):
    count = Counter((x, folds[i]) for i, labels in rows.items() for x in labels)
    return {x: [count[x, j] for j in range(k)] for x in {x for labels in rows.values() for x in labels}}


def test_orders(spark):
    rows = sets(order_labels(spark, SF))
    got = {}
    for r in E.queries()["iterative_kfold"](spark, SF).collect():
        assert (r["rep"], r["o_orderkey"]) not in got
        got[r["rep"], r["o_orderkey"]] = r["fold"]
    assert len(got) == 5 * len(rows)
    for rep in range(5):
        folds = {i: f for (r, i), f in got.items() if r == rep}
        want = by_hand(rows, 5, rep)
        assert folds == want
        even = shares(rows, want, 5)
        assert all(max(n) - min(n) == max(even[x]) - min(even[x]) for x, n in shares(rows, folds, 5).items())


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 5)])
def test_uneven_labels(spark, seed, k):
    """A label on almost every row, rare ones and one that always stands beside another."""
    rng = random.Random(seed)
    rows = {}
    for i in range(240):
        labels = {x for x, p in (("a", 0.9), ("b", 0.3), ("c", 0.05), ("d", 0.02), ("é", 0.4)) if rng.random() < p}
        rows[i] = labels | ({"pair"} if "c" in labels else set())
    rows = {i: x for i, x in rows.items() if x}
    long = spark.createDataFrame([(i, x) for i, labels in rows.items() for x in labels] * 2, "id long, label string")
    got = splits.iterative_folds(long, "id", "label", k=k, reps=2).collect()
    for rep in range(2):
        assert {r["id"]: r["fold"] for r in got if r["rep"] == rep} == by_hand(rows, k, rep)


def test_no_labels(spark):
    none = spark.createDataFrame([(1, None)], "id long, label string")
    assert splits.iterative_folds(none, "id", "label").count() == 0

"""Skipped pairs of blocks change no result: clustered and scattered vectors against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.operators import allpairs

SCHEMA = "id long, v array<double>"


def vectors(kind, seed=0, n=420, d=12):
    rng = np.random.default_rng(seed)
    if kind == "scattered":
        x = rng.standard_normal((n, d))
    else:
        centres = rng.standard_normal((7, d))
        x = centres[rng.integers(7, size=n)] + 0.05 * rng.standard_normal((n, d))
    x[5] = 0
    x[11] = x[10]
    x[12] = 3 * x[10]
    return x


def frame(spark, x):
    return spark.createDataFrame([(k, [float(z) for z in r]) for k, r in enumerate(x)], SCHEMA)


def cosines(x):
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("kind", ["clustered", "scattered"])
@pytest.mark.parametrize("threshold", [0.3, 0.97])
def test_pairs(spark, kind, threshold):
    x = vectors(kind)
    c = cosines(x)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] >= threshold}
    rows = allpairs.cosine_pairs_above(frame(spark, x), "id", "v", threshold, tile=20).collect()
    assert len(rows) == len(want) and {(r["i"], r["j"]) for r in rows} == want


@pytest.mark.parametrize("kind", ["clustered", "scattered"])
def test_nearest(spark, kind):
    x = vectors(kind, 1)
    c = np.round(cosines(x), 12)
    np.fill_diagonal(c, -9)
    c[:, 5] = -9
    got = {r["id"]: (r["nn_id"], r["sim"]) for r in allpairs.nearest_neighbours(frame(spark, x), "id", "v", tile=20).collect()}
    assert set(got) == set(range(len(x))) - {5}
    for k, (nn, sim) in got.items():
        assert sim == pytest.approx(c[k].max(), abs=1e-9) and c[k, nn] == pytest.approx(c[k].max(), abs=1e-9)


def test_spanning_tree(spark):
    x = vectors("clustered", 2, n=120)
    w = 1 - cosines(x)
    left = [k for k in range(len(x)) if k != 5]
    near, total = {k: w[left[0], k] for k in left[1:]}, 0.0
    while near:                                     # Prim
        k = min(near, key=near.get)
        total += near.pop(k)
        near = {j: min(v, w[k, j]) for j, v in near.items()}
    got = allpairs.cosine_mst(frame(spark, x), "id", "v", tile=8).collect()
    assert len(got) == len(left) - 1 and sum(r["w"] for r in got) == pytest.approx(total, abs=1e-9)
    parent = {k: k for k in left}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for r in got:
        a, b = root(r["u"]), root(r["v"])
        assert a != b
        parent[a] = b


def tree(points):
    """Kruskal over ids; an id may have several vectors, and equal vectors hang on the smallest id."""
    ids, x = [k for k, _ in points], np.array([v for _, v in points])
    w = np.round(1 - cosines(x), 12)
    edges = sorted({(w[a, b], min(ids[a], ids[b]), max(ids[a], ids[b]))
                    for a in range(len(ids)) for b in range(a) if ids[a] != ids[b]})
    root, kept = {k: k for k in ids}, []
    for d, u, v in edges:
        if root[u] != root[v]:
            kept.append((u, v, d))
            old, new = root[v], root[u]
            root = {k: new if r == old else r for k, r in root.items()}
    return kept


def test_spanning_tree_of_copies_and_repeated_ids(spark):
    """More copies than a list holds, an id with two vectors, whole rows twice, and rows without id or direction."""
    x = [list(map(float, r)) for r in vectors("scattered", 3, n=60)]
    points = [(k, x[k]) for k in range(60) if k != 5] + [(100 + k, x[20]) for k in range(3 * allpairs.NEAR)]
    points += [(30, x[41]), (31, [-z for z in x[7]])]
    odd = [(None, x[1]), (200, None), (201, [0.0] * 12), points[3], points[70]]
    got = allpairs.cosine_mst(spark.createDataFrame(points + odd, SCHEMA), "id", "v").collect()
    want = tree(points)
    assert sorted((r["u"], r["v"]) for r in got) == sorted((u, v) for u, v, _ in want)
    assert sum(r["w"] for r in got) == pytest.approx(sum(d for *_, d in want), abs=1e-9)


def test_spanning_tree_meets_all_pairs_once(spark, monkeypatch):
    """Later searches ask for the vectors whose lists ended, not for all of them once a round."""
    whole, asked, some = [], [], allpairs._search_some
    search = allpairs._search_all
    monkeypatch.setattr(allpairs, "_search_all", lambda *a: whole.append(1) or search(*a))
    monkeypatch.setattr(allpairs, "_search_some", lambda b, c, rows, t: asked.append(rows.count()) or some(b, c, rows, t))
    x = vectors("scattered", 4, n=300)
    got = allpairs.cosine_mst(frame(spark, x), "id", "v").collect()
    want = tree([(k, v) for k, v in enumerate(x) if k != 5])
    assert len(got) == len(want) and sum(r["w"] for r in got) == pytest.approx(sum(d for *_, d in want), abs=1e-9)
    assert whole == [1] and sum(asked) < len(x) / 2


def test_share_of_skipped_pairs(spark):
    """Clusters leave most pairs of blocks out; scattered vectors, at a low threshold, next to none."""
    tight = allpairs.make_blocks(frame(spark, vectors("clustered")), "id", "v", tile=20)
    wide = allpairs.make_blocks(frame(spark, vectors("scattered")), "id", "v", tile=20)
    assert tight.measured and wide.measured
    assert allpairs.skipped(tight, F.col("reach") >= 0.97) > 0.6
    assert allpairs.skipped(wide, F.col("reach") >= 0.3) < 0.2
    assert tight.rows.groupBy("blk").count().agg(F.max("count")).first()[0] <= 60


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], SCHEMA)
    for df in (none, zero):
        assert allpairs.cosine_pairs_above(df, "id", "v", 0.1).count() == 0
        assert allpairs.nearest_neighbours(df, "id", "v").count() == 0
        assert allpairs.cosine_mst(df, "id", "v").count() == 0

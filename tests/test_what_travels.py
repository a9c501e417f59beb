"""What the joins on sets and chains write and shuffle, and that the results stay."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators import graph, metrics, ranking, setsim, splits
from sievekit.plans import graph as graphs, labels, similarity
from sievekit.streaming import streams

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, t array<string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_shared_tokens_are_written(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["b", "c", "d"]), (3, ["e"]), (4, ["b", "a", "c"]), (5, []), (6, None)]
    members, sets = setsim._ranked_sets([spark.createDataFrame(rows, SCHEMA)], "id", "t")
    assert {r["id"] for r in members.collect()} == {1, 2, 3, 4}
    assert sorted((r["n"], len(r["r"])) for r in sets.collect()) == [(3, 2), (3, 3)]      # a is held by the copies
    left, right = spark.createDataFrame([(1, ["a", "b", "x"]), (2, ["x"])], SCHEMA), spark.createDataFrame([(3, ["b", "c"])], SCHEMA)
    _, sets = setsim.ranked(left, right, "id", "t")
    assert sorted((r["n"], len(r["r"])) for r in sets.collect()) == [(2, 1), (3, 1)]      # x meets no token of the other side


def test_sides_ranked_once(spark):
    rng = random.Random(5)
    sets = lambda base: spark.createDataFrame(
        [(base + k, [str(rng.randrange(30)) for _ in range(rng.randint(0, 12))]) for k in range(40)], SCHEMA).localCheckpoint()
    left, right = sets(0), sets(100)
    gone = spark.createDataFrame([(k,) for k in range(0, 40, 3)], "id long")
    sides = setsim.ranked(left, right, "id", "t")
    for part, s in ((left, sides), (left.join(gone, "id", "left_anti"), setsim.without_left(sides, gone, "id"))):
        assert (setsim.greatest_similarity(part, right, "id", "t", s).collect()
                == setsim.greatest_similarity(part, right, "id", "t").collect())


def test_long_chain_without_a_join(spark):
    chains = spark.range(1, 201).select(F.lit(1).alias("g"), F.col("id").alias("pos"), F.col("id").alias("node"))
    chains = chains.unionByName(spark.createDataFrame([(2, 1, 7), (2, 4, 8), (None, 1, 9), (None, 2, 9)], "g int, pos long, node long"))
    got = ranking.offset_pairs(chains, "g", "pos", "node", 6)
    want = {(1, i, j, j - i) for i in range(1, 201) for j in range(i + 1, min(200, i + 6) + 1)} | {(2, 7, 8, 3)}
    assert "Join" not in plan(got)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_first_positions(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    got = splits.first_positions(ids.withColumn("v", F.col("id")), "id", "a", 500, 1 / 6)
    want = splits.shuffle_positions(ids.withColumn("v", F.col("id")), "id", "a").filter("pos <= 500").select("v", "pos")
    assert sorted(got.collect()) == sorted(want.collect())
    same = splits.first_positions(spark.range(60).select(F.lit("q").alias("k"), "id"), "k", "a", 10, 1e-6)
    assert same.count() == 10               # no hash lies below the bound: all rows are ordered


def test_features_are_never_broadcast(spark):
    t = similarity.similarity_table(spark, SF)
    assert "strategy=merge" in t._jdf.queryExecution().analyzed().toString() + t._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_spread_before_they_are_counted(spark):
    """no table of keys beside a scan; parts meet the matched rows."""
    truth = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "a"), (None, "a")], "id int, label string")
    pred = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "a")], "id int, label string")
    for df in (metrics.confusion(truth, pred, ["id"]), labels.order_labels(spark, SF)):
        assert "HashAggregate" not in plan(df).split("REPARTITION_BY_NUM")[1]
    parts = spark.createDataFrame([(i, r, (i + r) % 2) for i in (1, 2, 3) for r in (0, 1)], "id int, rep int, fold int")
    got = metrics.confusion(truth, pred, ["id"], parts=parts).collect()
    want = metrics.confusion(truth.join(parts, "id"), pred.join(parts, "id"), ["id", "rep", "fold"]).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want) and len(got) == 6


def test_positions_need_one_shuffle(spark):
    """after the written ranges no row is dealt again."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 700).alias("g"))
    got = ranking.ordered_position(df, "g", ["id"])
    shown = plan(got)
    assert "Window" not in shown and "SortMergeJoin" not in shown
    seen = {}
    for g, i, p in sorted(((r["g"], r["id"], r["pos"]) for r in got.collect()), key=lambda x: x[1]):
        seen[g] = seen.get(g, 0) + 1
        assert p == seen[g]
    assert sum(seen.values()) == 4000


def test_cut_orders_one_bin(spark, monkeypatch):
    """only the rows of the bin with the cut are ordered, and the cut is that of a full order."""
    ids = spark.range(5000).select("id", (F.col("id") % 3).alias("s"), F.lit("x").alias("v"))
    ids = ids.unionByName(spark.createDataFrame([(None, 1, "y"), (9001, 7, "z")], "id long, s long, v string"))
    ordered = []
    place = splits.group_position
    monkeypatch.setattr(splits, "group_position", lambda df, *a, **k: ordered.append(df.count()) or place(df, *a, **k))
    got = {(r["id"], r["s"], r["v"]): r["role"] for r in splits.position_cut(ids, "s", "id", "q", 0.8, "in", "out").collect()}
    assert len(got) == 5002 and ordered[0] < 100
    key = ids.withColumn("h", splits.seeded_hash("q", "id"))
    want = place(key, "s", "h").join(key.groupBy("s").count(), "s").collect()
    assert all(got[r["id"], r["s"], r["v"]] == ("in" if r["pos"] <= -(-r["count"] * 80 // 100) else "out") for r in want)


def test_small_groups_take_no_rounds(spark, monkeypatch):
    """groups of few edges are done in one cell, and the rounds give the same."""
    rng = random.Random(3)
    rows = [(g, *(rng.choice(["a", "b", "c", "d", None]) for _ in "sd")) for g in [*range(60), None] for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, src string, dst string")
    dag = spark.createDataFrame([(g, a, b) for g, a, b in rows if a and b and a < b], "g int, src string, dst string")
    alone = spark.createDataFrame([(0, "z"), (77, "z"), (77, "y"), (None, "z")], "g int, n string")
    ask = {"parts": lambda: graph.strong_components(df), "cyclic": lambda: graph.cyclic_groups(df),
           "simple": lambda: graph.longest_chains(df), "dag": lambda: graph.dag_longest_paths(dag, nodes=alone)}
    cells = {k: sorted(map(str, f().collect())) for k, f in ask.items()}
    gathered = graph._gathered
    monkeypatch.setattr(graph, "_gathered", lambda rows, most: gathered(rows, 0))
    assert cells == {k: sorted(map(str, f().collect())) for k, f in ask.items()}
    monkeypatch.setattr(graph, "_gathered", gathered)
    with pytest.raises(ValueError):
        graph.dag_longest_paths(spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "g int, src string, dst string"))
    written = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(df) or cut(df))
    graph.strong_components(df.filter("g is not null"))
    assert len(written) == 2                        # the distinct edges and the groups of many


def test_edges_without_a_join(spark):
    """consecutive lines meet in a window."""
    assert plan(graphs.type_edges(spark, SF)).count("SortMergeJoin") == 0


def test_negative_pairs_look_for_few(spark, monkeypatch):
    """a round looks for at most twice the wanted candidates among the pairs."""
    asked = []
    semi = graphs.joins.semi_join
    monkeypatch.setattr(graphs.joins, "semi_join", lambda df, other, on: asked.append(other.count()) or semi(df, other, on))
    assert graphs.random_negative_pairs(spark, "/root/testdata/sf0.01").count() == 600
    assert len(asked) == 1 and asked[0] <= 1200


def test_held_keys_are_not_collected(spark, monkeypatch, tmp_path):
    """no broadcast of the held keys per batch."""
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, key string").write.parquet(str(tmp_path / "in"))
    held = spark.createDataFrame([("b",), ("b",)], "key string")
    hinted = []
    frame = type(held)
    hint = frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, name, *a: hinted.append(name) or hint(self, name, *a))
    stream = spark.readStream.schema("id int, key string").parquet(str(tmp_path / "in"))
    got = streams.decontaminate_stream(spark, stream, held, "key", str(tmp_path / "out"), str(tmp_path / "at"))
    assert {r["id"] for r in got.collect()} == {1, 3} and hinted == ["merge"]

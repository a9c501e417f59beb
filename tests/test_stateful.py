"""State over streams that survives a restart, and the table function."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.functions import udtfs
from sievekit.streaming import state

SCHEMA = "id long, grp string, score double, hit boolean"


def auc(rows):
    pos = [int(s // 1) for _, _, s, h in rows if h]
    neg = [int(s // 1) for _, _, s, h in rows if not h]
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return won / (len(pos) * len(neg)) if pos and neg else None


def run(spark, source, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    state.histogram_stream(spark, stream, F.col("grp"), F.col("id"), F.floor("score"), F.col("hit"),
                           str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    return {r["grp"]: (r["n"], r["auc"]) for r in state.area_under_roc(state.reduced(spark, str(tmp_path / "sink"))).collect()}


def test_state_survives_a_restart(spark, tmp_path):
    """One group holds most rows, one has a single class, scores and labels may be null."""
    rng = random.Random(1)
    rows = [(k, rng.choice("aaaab") if k % 50 else "one", rng.uniform(0, 12), rng.random() < 0.4 and k % 50 > 0) for k in range(900)]
    odd = [(1000, "a", None, True), (1001, "a", 3.0, None), (1002, None, 2.5, True), (1003, None, 1.5, False)]
    source = str(tmp_path / "in")
    write = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    write(rows[:300])
    write(rows[300:500])
    first = run(spark, source, tmp_path)
    write(rows[500:])
    write(odd)
    second = run(spark, source, tmp_path)
    for found, seen in ((first, rows[:500]), (second, rows + odd)):
        seen = [r for r in seen if r[2] is not None and r[3] is not None]
        for g in {r[1] for r in seen}:
            mine = [r for r in seen if r[1] == g]
            want = auc(mine)
            assert found[g][0] == len(mine)
            assert found[g][1] == (pytest.approx(want) if want is not None else None)
    assert spark.conf.get(state.PROVIDER, None) != state.ROCKSDB


def test_equation_table_function(spark):
    udtfs.register(spark)
    rows = [(1, "2 A + B <=> C"), (2, " A <=> "), (3, None), (4, "no arrow"), (5, "n x y + + Z <=> 3 P + Q <=> R")]
    got = spark.sql("SELECT id, e.* FROM {t} AS t, LATERAL equation_edges(t.eq) AS e",
                    t=spark.createDataFrame(rows, "id long, eq string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "A", "C"), (1, "B", "C"), (5, "Z", "P"), (5, "Z", "Q"),
                                             (5, "x y", "P"), (5, "x y", "Q")]

"""Multi-label ridge against the closed form, persistence, and the search on validation folds."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.operators import multilabel as ml
from sievekit.plans import models

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return models.labelled(spark, SF).cache()


def matrices(rows):
    got = rows.orderBy("doc_id").collect()
    labels = sorted({x for r in got for x in r["labels"]})
    return (np.array([r["x"] for r in got]), np.array([[x in r["labels"] for x in labels] for r in got]), labels,
            [r["doc_id"] for r in got])


def closed_form(x, y, alpha):
    """One regression per label on standardised features, constant features dropped, intercept apart."""
    keep = x.std(0) ** 2 > 1e-12
    z = (x[:, keep] - x[:, keep].mean(0)) / x[:, keep].std(0)
    t = np.where(y, 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (t - t.mean(0)))
    return z @ w + t.mean(0)


@pytest.mark.parametrize("alpha", [0.01, 1.0, 50.0])
def test_closed_form(rows, alpha):
    x, y, labels, ids = matrices(rows)
    model = ml.MultiLabelRidge(featuresCol="x", alpha=alpha).fit(rows)
    assert model.labels == labels
    np.testing.assert_allclose(x @ model.linear.coef.T + model.linear.intercept, closed_form(x, y, alpha), atol=1e-6)
    want = closed_form(x, y, alpha) > 0
    got = {r["doc_id"]: r["predicted"] for r in model.transform(rows).collect()}
    assert [got[i] for i in ids] == [[v for v, on in zip(labels, r) if on] for r in want]


def test_groups_add_up(rows):
    x, y, labels, _ = matrices(rows)
    two = rows.withColumn("g", F.array(F.pmod("doc_id", F.lit(3)), F.lit(7)))
    got = ml.statistics(two, "x", "labels", labels, F.col("g"))
    whole = ml.statistics(rows, "x", "labels", labels)[0]
    np.testing.assert_allclose(got[7].gram, whole.gram)
    np.testing.assert_allclose(sum((got[k] for k in (1, 2)), got[0]).pos, whole.pos)
    one = np.column_stack([np.ones(len(x)), x])
    np.testing.assert_allclose(whole.gram, one.T @ one)
    np.testing.assert_allclose(whole.pos, y.T @ one)


LOAD = """
import sys
sys.path.insert(0, {repo!r})
from sievekit.session import build_session
from pyspark.ml import PipelineModel
s = build_session("local[2]")
rows = s.read.parquet({data!r})
got = PipelineModel.load({model!r}).transform(rows).orderBy("doc_id").collect()
print("FOUND", hash(tuple((r["doc_id"], tuple(r["predicted"])) for r in got)))
"""


def test_pipeline_survives_a_new_session(spark, rows, tmp_path):
    """Scaler, PCA and ridge in one pipeline; saved, loaded by another process, equal predictions."""
    from pathlib import Path

    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector
    data, path = str(tmp_path / "rows"), str(tmp_path / "model")
    rows.withColumn("v", array_to_vector("x")).write.parquet(data)
    frame = spark.read.parquet(data)
    model = Pipeline(stages=[StandardScaler(inputCol="v", outputCol="z", withMean=True),
                             PCA(k=8, inputCol="z", outputCol="pc"),
                             ml.MultiLabelRidge(featuresCol="pc", alpha=2.0, predictionCol="predicted")]).fit(frame)
    model.write().save(path)
    want = model.transform(frame).orderBy("doc_id").collect()
    code = LOAD.format(repo=str(Path(__file__).resolve().parent.parent), data=data, model=path)
    env = {**__import__("os").environ, "PYTHONHASHSEED": "0"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300).stdout
    mine = subprocess.run([sys.executable, "-c", f"print(hash({tuple((r['doc_id'], tuple(r['predicted'])) for r in want)!r}))"],
                          capture_output=True, text=True, env=env, timeout=60).stdout
    assert out.split()[-1] == mine.split()[-1]
    loaded = type(model).load(path)
    assert loaded.stages[2].getOrDefault("alpha") == 2.0


def test_estimator_params_persist(spark, tmp_path):
    e = ml.MultiLabelRidge(featuresCol="f", alpha=3.5)
    e.write().save(str(tmp_path / "e"))
    back = ml.MultiLabelRidge.load(str(tmp_path / "e"))
    assert back.getOrDefault("alpha") == 3.5 and back.getOrDefault("featuresCol") == "f"


@pytest.fixture(scope="module")
def data(spark, rows):
    folds = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(r)), F.lit(4)).cast("long") for r in range(2)])
    return rows.select("doc_id", "x", F.col("labels").alias("y"), folds.alias("folds")).cache()


def run(data, labels):
    return ml.search(data, labels, models.REPRESENTATIONS, k=4, reps=2, rounds=3, per_round=3)


def test_search(spark, rows, data):
    x, y, labels, ids = matrices(rows)
    found = run(data, labels)
    folds = {r["doc_id"]: r["folds"] for r in data.collect()}
    trials = found.trials.collect()
    assert len(trials) == 2 * 4 * 9 and sum(t["best"] for t in trials) == 8

    def masked_f1(rep, train, held, alpha, representation):
        cols = models.REPRESENTATIONS[representation]
        tr = np.array([folds[i][rep] in train for i in ids])
        te = np.array([folds[i][rep] == held for i in ids])
        keep = x[tr][:, cols].std(0) ** 2 > 1e-12
        mu, sd = x[tr][:, cols].mean(0)[keep], x[tr][:, cols].std(0)[keep]
        z = lambda a: (a[:, cols][:, keep] - mu) / sd
        t = np.where(y[tr], 1.0, -1.0)
        w = np.linalg.solve(z(x[tr]).T @ z(x[tr]) + alpha * np.eye(keep.sum()), z(x[tr]).T @ (t - t.mean(0)))
        p = z(x[te]) @ w + t.mean(0) > 0
        mask = y[tr].any(0) & y[te].any(0)
        tp, fp, fn = [(a & b).sum(0)[mask] for a, b in ((p, y[te]), (p, ~y[te]), (~p, y[te]))]
        return (2 * tp / np.maximum(2 * tp + fp + fn, 1)).mean()

    for t in trials:
        rest = {f for f in range(4)} - {t["fold"], (t["fold"] + 1) % 4}
        want = masked_f1(t["rep"], rest, (t["fold"] + 1) % 4, t["alpha"], t["representation"])
        assert t["macro_f1"] == pytest.approx(want, abs=0.02)
    summary = found.summary.collect()
    assert len(summary) == 8
    for s in summary:
        mine = [t for t in trials if (t["rep"], t["fold"]) == (s["rep"], s["fold"])]
        assert s["validation_f1"] == max(t["macro_f1"] for t in mine)
        want = masked_f1(s["rep"], set(range(4)) - {s["fold"]}, s["fold"], s["alpha"], s["representation"])
        assert s["macro_f1"] == pytest.approx(want, abs=0.02)


def test_search_never_sees_its_test_fold(rows, data):
    """Other labels on fold 2 of repetition 0 change no trial of the search that is tested on it."""
    labels = matrices(rows)[2]
    other = data.withColumn("y", F.when(F.col("folds")[0] == 2, F.array(F.lit("toxic"))).otherwise(F.col("y")))
    pick = lambda d: [tuple(r) for r in run(d, labels).trials.filter("rep = 0 and fold = 2").orderBy("trial").collect()]
    a, b = pick(data), pick(other)
    assert [t[:5] for t in a] == [t[:5] for t in b]
    np.testing.assert_allclose([t[5] for t in a], [t[5] for t in b])


def test_later_trials_come_from_the_better_ones():
    rng = np.random.default_rng(1)
    done = [(0.9, ml.Trial(10.0, "all"))] + [(0.1, ml.Trial(0.001, "letters"))] * 3
    drawn = [ml.draw(rng, done, ["all", "letters"]) for _ in range(200)]
    assert 3 < np.median([t.alpha for t in drawn]) < 30
    assert sum(t.representation == "all" for t in drawn) > 150


def test_no_labels_and_nulls(spark):
    f = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, x array<double>")
    t = spark.createDataFrame([(1, None), (9, "a")], "id long, label string")
    got = ml.label_arrays(f, t, "id")
    assert [r["labels"] for r in got.collect()] == [[], []]
    assert all(r["predicted"] == [] for r in ml.MultiLabelRidge(featuresCol="x").fit(got).transform(got).collect())

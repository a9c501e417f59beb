"""Quality classifier: statistics by hand, the fit against plain numpy, held-out accuracy, odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import quality_classifier as qc, queries
from sievekit.llm.blocks import text_slices
import pyarrow as pa

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, predicted string, held_out string, _fold string"


def by_hand(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    share = lambda rx: len(re.findall(rx, raw)) / size
    return [np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(max(map(len, words), default=0)),
            share(rb"[#*$%&|<>]"), share(rb"!"), share(rb"[\"'()+,\-./:;=?@\[\\\]^_`{}~]"), share(rb"[A-Z]"), share(rb"[0-9]"),
            share(rb"[\x80-\xff]"), share(rb"[\x20\x09-\x0D]"), np.log1p(len(words) / max(len(lines), 1)), len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, max(map(words.count, set(words)), default=0) / n,
            sum(not re.search(rb"[^\x00-\x60\x7B-\x7F]|[A-Z]", w) for w in words) / n,
            len(set(lines)) / max(len(lines), 1), sum(w[-1:] in b".!?" for w in words) / n]


def test_statistics(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()]
    texts += ["", " \n\t", "a", "a a a\na a a\n\nb", "Ünïcode wörds 123 ### !!", "x" * 50, "no end\n" * 4]
    got = []
    for _, _, data, offs in text_slices(pa.array(texts), 1 << 16):
        got.append(qc.statistics(data, offs))
    np.testing.assert_allclose(np.vstack(got), [by_hand(t) for t in texts], atol=1e-9)


def test_features_approach_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, len(qc.STATS))) / 2
    z = qc.fourier(x, np.zeros(len(qc.STATS)), np.ones(len(qc.STATS)))[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-far / 2 / qc.WIDTH ** 2)).mean() < 2 / np.sqrt(qc.FEATURES)


def test_isotonic_is_the_best_monotone_curve():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = rng.integers(1, 30)
        x, w = np.sort(rng.choice(1000, n, replace=False)), rng.integers(1, 9, n).astype(float)
        y = rng.random(n)
        knots, values = qc.isotonic(x, w, w * y)
        got = np.interp(x, knots, values)
        assert (np.diff(got) >= -1e-12).all()
        # min-max form of isotonic regression
        mean = lambda a, b: (w[a:b] * y[a:b]).sum() / w[a:b].sum()
        want = [max(min(mean(a, b) for b in range(k + 1, n + 1)) for a in range(k + 1)) for k in range(n)]
        np.testing.assert_allclose(got, want, atol=1e-9)


def test_partition_sums_equal_one_solve(spark, monkeypatch):
    monkeypatch.setattr(qc, "FAN", 4)
    rng = np.random.default_rng(2)
    stats = rng.standard_normal((500, len(qc.STATS)))
    y = (stats[:, 0] + stats[:, 3] ** 2 > 0.5).astype(float)
    fold = rng.integers(0, qc.FOLDS, 500)
    df = spark.createDataFrame([(s.tolist(), int(f), float(v)) for s, f, v in zip(stats, fold, y)],
                               "_stats array<double>, _fold int, _y double").repartition(23)
    mean, scale = stats.mean(0), stats.std(0)
    sums = qc._fold_sums(df, mean, scale)
    z = qc.fourier(stats, mean, scale)
    for k in range(qc.FOLDS):
        a, b, yy = qc._unpack(sums[k])
        np.testing.assert_allclose(a, z[fold == k].T @ z[fold == k], atol=1e-8)
        np.testing.assert_allclose(b, z[fold == k].T @ y[fold == k], atol=1e-8)
        assert yy == pytest.approx(y[fold == k].sum())
    w = qc._ridge(sum(sums.values()), 0.01)
    ridge = 5 * np.eye(z.shape[1])
    ridge[-1, -1] = 5e-7
    np.testing.assert_allclose(w, np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-6)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out(spark, sf):
    d = f"/root/testdata/{sf}"
    got = queries.QUERIES["op12_fourier_quality"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").filter("quality is not null")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert min(r["predicted"] for r in held if r["quality"]) == 1 or \
        sum(r["predicted"] for r in held if r["quality"]) >= 0.99 * sum(r["quality"] for r in held)


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "s", "p", "h", "f") for k, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "\n"), (None, "plain words in a row."), (5, "plain words in a row."), (5, "### $$$ ***"),
       (7, "word " * 400_000), (8, "日本語 テキスト")]


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(None, 1, 0), (5, None, 0), (5, 1, 0), (5, 0, 1), (2, 0, 0), (7, 0, 0), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = qc.classify(docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (1, 2)}
    assert same[1] == same[2]


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in qc.classify(docs(spark, ODD), none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in qc.classify(docs(spark, ODD), one).collect())
    assert qc.classify(docs(spark, ODD).limit(0), one).count() == 0


def test_labels_and_ids_are_no_inputs(spark):
    d = f"/root/testdata/sf0.001"
    frame, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = qc.held_out()
    a = {r["doc_id"]: r["score"] for r in qc.classify(frame, labels).collect()}
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    b = {r["doc_id"]: r["score"] for r in qc.classify(frame, flipped).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)

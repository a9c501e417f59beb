"""Multi-label ridge, adaptive search with validation, and persistent pipeline stages (M3–M8).

One +1/-1 regression per label over a shared design matrix.  A pass sums, per group of rows, the
Gramian of ``[1, x]`` and, for every label, the sum of ``[1, x]`` over its positive rows: the targets
are sparse, so their cost follows the positives and not rows x labels, and the +1/-1 product is
``2 * positives - all``.  These sums (d^2 + labels x d numbers per group, whatever the number of
rows) are all that the driver sees; training sets of folds are sums and differences of groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import cut_lineage
from . import metrics

SUMS = "grp long, kind string, row int, pos int, val double"


class Stats(NamedTuple):
    gram: np.ndarray        # (d+1, d+1): sums of [1, x] [1, x]'
    pos: np.ndarray         # (labels, d+1): sums of [1, x] over the positive rows

    def __add__(self, other):
        return Stats(self.gram + other.gram, self.pos + other.pos)

    def __sub__(self, other):
        return Stats(self.gram - other.gram, self.pos - other.pos)

    def part(self, columns: list[int]) -> Stats:
        """The statistics of a representation that holds only some features."""
        at = [0, *[c + 1 for c in columns]]
        return Stats(self.gram[np.ix_(at, at)], self.pos[:, at])


class Linear(NamedTuple):
    coef: np.ndarray        # (labels, d) on the raw feature scale
    intercept: np.ndarray   # (labels,)


def label_arrays(features: DataFrame, targets: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """``features`` with the array ``labels`` of each row's positive labels (none: empty) from a long table."""
    held = targets.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__id")) \
        .agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return features.join(held, features[id_col] == F.col("__id"), "left").drop("__id") \
        .withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def _numbers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _positives(column: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, label number) of every known positive label."""
    flat = column.flatten().to_pylist()
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False).astype(int))
    known = np.array([index.get(x, -1) for x in flat], dtype=int)
    return row[known >= 0], known[known >= 0]


def _sum_kernel(labels: list[str]):
    index = {x: n for n, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Stats] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _numbers(b.column("x"))
            x = np.column_stack([np.ones(len(x)), x])
            row, lab = _positives(b.column("y"), index)
            groups = b.column("grps")
            of = groups.flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(x)), groups.value_lengths().to_numpy(zero_copy_only=False).astype(int))
            for g in np.unique(of):
                member = np.zeros(len(x), bool)
                member[at[of == g]] = True
                pos = np.zeros((len(labels), x.shape[1]))
                keep = member[row]
                np.add.at(pos, lab[keep], x[row[keep]])
                now = Stats(x[member].T @ x[member], pos)
                held[int(g)] = held[int(g)] + now if int(g) in held else now
        for g, s in held.items():
            for kind, m in (("x", s.gram), ("y", s.pos)):
                n, d = m.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * m.size, pa.int64()), pa.array([kind] * m.size, pa.string()),
                     pa.array(np.repeat(np.arange(n), d).astype(np.int32)), pa.array(np.tile(np.arange(d), n).astype(np.int32)),
                     pa.array(m.ravel())], names=["grp", "kind", "row", "pos", "val"])
    return run


def sums(df: DataFrame, x_col: str, y_col: str, labels: list[str], groups: Column | None = None) -> DataFrame:
    """(grp, kind, row, pos, val): cells of the statistics, summed over all rows in one pass.

    ``kind`` x: Gramian of [1, x]; y: sums of [1, x] over the positives of label ``row``.
    ``groups`` is an array of the groups that a row counts in (none: group 0)."""
    grps = groups if groups is not None else F.array(F.lit(0))
    rows = df.select(grps.cast("array<bigint>").alias("grps"), F.col(x_col).cast("array<double>").alias("x"),
                     F.col(y_col).alias("y"))
    return rows.mapInArrow(_sum_kernel(labels), SUMS).groupBy("grp", "kind", "row", "pos").agg(F.sum("val").alias("val"))


def statistics(df: DataFrame, x_col: str, y_col: str, labels: list[str], groups: Column | None = None) -> dict[int, Stats]:
    cells = sums(df, x_col, y_col, labels, groups).toPandas()
    out = {}
    for g, part in cells.groupby("grp"):
        width = int(part["pos"].max()) + 1
        gram, pos = np.zeros((width, width)), np.zeros((len(labels), width))
        for m, kind in ((gram, "x"), (pos, "y")):
            c = part[part["kind"] == kind]
            m[c["row"].to_numpy(), c["pos"].to_numpy()] = c["val"].to_numpy()
        out[int(g)] = Stats(gram, pos)
    return out


def solve(stats: Stats, alpha: float, var_threshold: float = 0.0) -> Linear:
    """Standardise, drop features of variance up to the threshold, solve one ridge for all labels;
    the intercept is not penalised."""
    n = stats.gram[0, 0]
    mu = stats.gram[0, 1:] / n
    cov = stats.gram[1:, 1:] - n * np.outer(mu, mu)
    var = np.diag(cov) / n
    keep = var > max(var_threshold, 1e-12)
    sd = np.sqrt(np.where(keep, var, 1.0))
    ybar = (2 * stats.pos[:, 0] - n) / n
    xty = 2 * stats.pos[:, 1:] - stats.gram[0, 1:] - n * np.outer(ybar, mu)
    a = (cov / np.outer(sd, sd))[np.ix_(keep, keep)]
    w = np.linalg.solve(a + alpha * np.eye(keep.sum()), (xty / sd)[:, keep].T).T
    coef = np.zeros(xty.shape)
    coef[:, keep] = w / sd[keep]
    return Linear(coef, ybar - coef @ mu)


def long_labels(df: DataFrame, id_col: str, column: str) -> DataFrame:
    return df.select(id_col, F.explode(column).alias("label"))


# --- pipeline stages -------------------------------------------------------------------------------

class _RidgeParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector or array column", TypeConverters.toString)
    labelsCol = Param(Params._dummy(), "labelsCol", "array of positive labels", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "array of predicted labels", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "ridge penalty", TypeConverters.toFloat)
    varianceThreshold = Param(Params._dummy(), "varianceThreshold", "features up to it are dropped", TypeConverters.toFloat)

    def _arrays(self, df: DataFrame) -> DataFrame:
        name = self.getOrDefault(self.featuresCol)
        kind = df.schema[name].dataType
        x = F.col(name) if isinstance(kind, ArrayType) else vector_to_array(name)
        return df.withColumn("__features", x.cast("array<double>"))


class MultiLabelRidge(Estimator, _RidgeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of one ridge regression per label found in ``labelsCol``."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelsCol="labels", predictionCol="predicted", alpha=1.0,
                 varianceThreshold=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelsCol="labels", predictionCol="predicted", alpha=1.0,
                         varianceThreshold=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MultiLabelRidgeModel:
        y = self.getOrDefault(self.labelsCol)
        x = self._arrays(df)
        names = [r["label"] for r in df.select(F.explode(y).alias("label")).distinct().orderBy("label").collect()]
        found = statistics(x, "__features", y, names)
        if not found:
            raise ValueError("no rows to fit")
        model = solve(found[0], self.getOrDefault(self.alpha), self.getOrDefault(self.varianceThreshold))
        return self._copyValues(MultiLabelRidgeModel(names, model))


class _ModelWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        m = self.instance.linear
        rows = [(n, x, float(b), [float(v) for v in w]) for n, (x, b, w) in enumerate(zip(self.instance.labels, m.intercept, m.coef))]
        spark.createDataFrame(rows, "at int, label string, intercept double, coef array<double>") \
            .coalesce(1).write.parquet(f"{path}/data")


class _ModelReader(MLReader):
    def load(self, path: str) -> MultiLabelRidgeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/data").orderBy("at").collect()
        model = MultiLabelRidgeModel([r["label"] for r in rows], Linear(np.array([r["coef"] for r in rows]),
                                                                       np.array([r["intercept"] for r in rows])))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class MultiLabelRidgeModel(Model, _RidgeParams, MLReadable, MLWritable):
    """Labels, coefficients (kept as a table beside the params) and sign decisions."""

    def __init__(self, labels: list[str] | None = None, linear: Linear | None = None):
        super().__init__()
        self._setDefault(featuresCol="features", labelsCol="labels", predictionCol="predicted", alpha=1.0,
                         varianceThreshold=0.0)
        self.labels, self.linear = labels or [], linear

    def _transform(self, df: DataFrame) -> DataFrame:
        decided = F.pandas_udf(_decider(self.linear, self.labels), "array<string>")
        return self._arrays(df).withColumn(self.getOrDefault(self.predictionCol), decided("__features")).drop("__features")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


def _decider(model: Linear, labels: list[str]):
    """Labels whose regression is positive."""
    coef, intercept, names = model.coef, model.intercept, np.array(labels, dtype=object)

    def decide(x: pd.Series) -> pd.Series:
        if not len(x) or not len(names):
            return pd.Series([[] for _ in range(len(x))])
        yes = np.stack(x.to_numpy()) @ coef.T + intercept > 0
        return pd.Series([list(names[r]) for r in yes])
    return decide


# --- search on the validation part -------------------------------------------------------------------

class Trial(NamedTuple):
    alpha: float
    representation: str


class Search(NamedTuple):
    trials: DataFrame       # rep, fold, trial, alpha, representation, macro_f1 on the validation fold, best
    per_label: DataFrame    # rep, fold, label and its counts and scores on the test fold, masked
    summary: DataFrame      # rep, fold: the chosen trial and masked averages on the test fold


def draw(rng: np.random.Generator, done: list[tuple[float, Trial]], representations: list[str]) -> Trial:
    """The sampler: without trials log-uniform over six decades and uniform over representations; then a parent
    from the better quarter, its penalty moved by half a decade (one deviation), its representation kept four times of five."""
    if not done:
        return Trial(float(10 ** rng.uniform(-3, 3)), str(rng.choice(representations)))
    better = sorted(done, key=lambda t: -t[0])[:max(1, len(done) // 4)]
    parent = better[rng.integers(len(better))][1]
    kept = parent.representation if rng.random() < 0.8 else str(rng.choice(representations))
    return Trial(float(np.clip(parent.alpha * 10 ** rng.normal(0, 0.5), 1e-4, 1e4)), kept)


def _score_kernel(models: dict[tuple[int, int], list[Linear]], held: dict[tuple[int, int], int], labels: list[str], reps: int):
    """Counts of every (rep, fold) search's models on the rows of its held fold."""
    index = {x: n for n, x in enumerate(labels)}

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _numbers(b.column("x"))
            row, lab = _positives(b.column("y"), index)
            y = np.zeros((len(x), len(labels)), bool)
            y[row, lab] = True
            folds = _numbers(b.column("folds")).astype(int)
            for (rep, fold), found in models.items():
                at = folds[:, rep] == held[rep, fold]
                if not at.any():
                    continue
                for t, m in enumerate(found):
                    p = x[at] @ m.coef.T + m.intercept > 0
                    c = np.stack([(p & y[at]).sum(0), (p & ~y[at]).sum(0), (~p & y[at]).sum(0)])
                    total[rep, fold, t] = total.get((rep, fold, t), 0) + c
        for (rep, fold, t), c in total.items():
            n = len(labels)
            same = lambda v: pa.array([v] * n, pa.int64())
            yield pa.RecordBatch.from_arrays([same(rep), same(fold), same(t), pa.array(labels, pa.string()),
                                              *[pa.array(v.astype(np.int64)) for v in c]],
                                             names=["rep", "fold", "trial", "label", "tp", "fp", "fn"])
    return run


def _scored(rows: DataFrame, models, held, labels, reps, trained: dict[tuple[int, int], Stats]) -> DataFrame:
    """Per (rep, fold, trial, label) counts and scores, where the label has positives in both parts."""
    counts = rows.mapInArrow(_score_kernel(models, held, labels, reps),
                             "rep long, fold long, trial long, label string, tp long, fp long, fn long")
    conf = counts.groupBy("rep", "fold", "trial", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]) \
        .withColumn("support", F.col("tp") + F.col("fn"))
    seen = [(r, f, x) for (r, f), s in trained.items() for n, x in enumerate(labels) if s.pos[n, 0] > 0]
    mask = rows.sparkSession.createDataFrame(seen, "rep long, fold long, label string")
    return metrics.with_scores(conf.filter("support > 0").join(mask, ["rep", "fold", "label"]))


def search(rows: DataFrame, labels: list[str], representations: dict[str, list[int]], k: int, reps: int,
           rounds: int = 4, per_round: int = 5, seed: int = 43) -> Search:
    """Search per (rep, fold) of ``rows`` (x, y, folds: array with the row's fold in every repetition).

    The fold is the test part, the next fold the validation part, the others train.  All searches go on
    together: one pass over the rows sums the statistics of every (rep, fold), and one pass per round
    scores all trials of the round.  The chosen trial is fitted again on train and validation rows and only
    then meets the test fold."""
    spark = rows.sparkSession
    rows = rows.select("x", "y", F.col("folds").cast("array<double>").alias("folds"))
    group = F.transform("folds", lambda f, r: r * k + f.cast("int"))
    stats = statistics(rows, "x", "y", labels, group)
    if not stats:
        raise ValueError("no rows to search")
    empty = Stats(*[np.zeros_like(m) for m in next(iter(stats.values()))])
    of = lambda r, f: stats.get(r * k + f % k, empty)
    total = sum((of(0, f) for f in range(k)), empty)
    width = total.gram.shape[0] - 1
    searches = [(r, f) for r in range(reps) for f in range(k)]
    train = {s: total - of(*s) - of(s[0], s[1] + 1) for s in searches}

    def fitted(stat: Stats, t: Trial) -> Linear:
        columns = representations[t.representation]
        m = solve(stat.part(columns), t.alpha)
        coef = np.zeros((len(labels), width))
        coef[:, columns] = m.coef
        return Linear(coef, m.intercept)

    names = sorted(representations)
    tried: dict[tuple[int, int], list[tuple[float, Trial]]] = {s: [] for s in searches}
    rngs = {s: np.random.default_rng([seed, *s]) for s in searches}
    for _ in range(rounds):
        now = {s: [draw(rngs[s], tried[s], names) for _ in range(per_round)] for s in searches}
        scored = _scored(rows, {s: [fitted(train[s], t) for t in now[s]] for s in searches},
                         {s: (s[1] + 1) % k for s in searches}, labels, reps, train)
        mean = metrics.averaged(scored, ["rep", "fold", "trial"], "macro", ("f1",)).collect()
        found = {(r["rep"], r["fold"], r["trial"]): r["macro_f1"] for r in mean}
        for s in searches:
            tried[s] += [(found.get((*s, n), 0.0), t) for n, t in enumerate(now[s])]
    best = {s: max(range(len(v)), key=lambda n: (v[n][0], -n)) for s, v in tried.items()}
    trials = spark.createDataFrame(
        [(*s, n, t.alpha, t.representation, float(f1), n == best[s]) for s, v in tried.items() for n, (f1, t) in enumerate(v)],
        "rep long, fold long, trial long, alpha double, representation string, macro_f1 double, best boolean")
    rest = {s: total - of(*s) for s in searches}
    scored = cut_lineage(_scored(rows, {s: [fitted(rest[s], tried[s][best[s]][1])] for s in searches},
                                 {s: s[1] for s in searches}, labels, reps, rest).drop("trial"))
    macro = metrics.averaged(scored, ["rep", "fold"], "macro")
    weighted = metrics.averaged(scored, ["rep", "fold"], "weighted")
    n = scored.groupBy("rep", "fold").agg(F.count(F.lit(1)).alias("n_labels"))
    chosen = trials.filter("best").select("rep", "fold", "alpha", "representation", F.col("macro_f1").alias("validation_f1"))
    summary = chosen.join(n, ["rep", "fold"]).join(macro, ["rep", "fold"]).join(weighted, ["rep", "fold"])
    return Search(trials, scored, summary)

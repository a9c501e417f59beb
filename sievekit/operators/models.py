"""Distributed linear models (M1–M9).

Ridge (one ±1 regression per label, shared design matrix) is solved from
summable statistics: one pass computes n, Σx, Σx², XᵀX and XᵀY per group
with Arrow batches (``mapInPandas``) and Spark sums the partials.  Only the
d×d / d×L statistics — sized by the feature width, never by the row count —
reach the driver, where standardisation (M1), the variance filter (M2) and
the closed-form solve (M3) happen.  Cross-validation (M5/M6) needs no extra
pass: a fold's training statistics are the total minus that fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATS_SCHEMA = T.StructType([T.StructField("grp", T.LongType()), T.StructField("kind", T.StringType()),
                             T.StructField("pos", T.IntegerType()), T.StructField("val", T.DoubleType())])


def _partial_stats(n_labels: int):
    def fn(batches):
        acc: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("grp"):
                x = np.stack(part["x"].to_numpy()).astype(np.float64)
                y = np.zeros((len(part), n_labels))
                y[np.arange(len(part)), part["y"].to_numpy().astype(int)] = 1.0
                y = 2 * y - 1                                         # ±1 targets
                a = acc.setdefault(int(g), [0, 0, 0, 0, 0, 0])
                a[0] += len(part)
                a[1] = a[1] + x.sum(0)
                a[2] = a[2] + (x * x).sum(0)
                a[3] = a[3] + x.T @ x
                a[4] = a[4] + x.T @ y
                a[5] = a[5] + y.sum(0)
        for g, (n, sx, sxx, xtx, xty, sy) in acc.items():
            parts = [("n", np.array([n], float)), ("sx", sx), ("sxx", sxx), ("xtx", xtx.ravel()),
                     ("xty", xty.ravel()), ("sy", sy)]
            for kind, arr in parts:
                yield pd.DataFrame({"grp": g, "kind": kind, "pos": np.arange(len(arr), dtype=np.int32),
                                    "val": arr})
    return fn


def ridge_stats(df: DataFrame, x_col: str, y_col: str, n_labels: int, group: str | None = None) -> dict:
    """Summable statistics per group (one pass).  ``y_col`` holds a class index
    0..n_labels-1 (one-vs-rest ±1 targets are built in the kernel)."""
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    x = df.select(g.alias("grp"), F.col(x_col).cast("array<double>").alias("x"), F.col(y_col).alias("y"))
    parts = x.mapInPandas(_partial_stats(n_labels), STATS_SCHEMA)
    summed = parts.groupBy("grp", "kind", "pos").agg(F.sum("val").alias("val")).toPandas()  # O(d²) rows
    out: dict = {}
    d = int(summed.loc[summed.kind == "sx", "pos"].max()) + 1
    for grp, sub in summed.groupby("grp"):
        def arr(kind):
            s = sub[sub.kind == kind].sort_values("pos")["val"].to_numpy()
            return s
        out[int(grp)] = {"n": arr("n")[0], "sx": arr("sx"), "sxx": arr("sxx"),
                         "xtx": arr("xtx").reshape(d, d), "xty": arr("xty").reshape(d, n_labels),
                         "sy": arr("sy")}
    return out


def combine(stats: list[dict], sign: list[float] | None = None) -> dict:
    sign = sign or [1.0] * len(stats)
    return {k: sum(s[k] * w for s, w in zip(stats, sign)) for k in stats[0]}


def ridge_solve(st: dict, alpha: float, var_threshold: float = 0.0) -> dict:
    """M1 + M2 + M3: standardise (population std), drop features with variance
    ≤ threshold, solve (X'ᵀX' + αI) W = X'ᵀ(Y − ȳ) with an unpenalised intercept."""
    n = st["n"]
    mu = st["sx"] / n
    var = st["sxx"] / n - mu * mu
    keep = var > var_threshold
    sd = np.sqrt(np.where(keep, var, 1.0))
    xtx_c = st["xtx"] - n * np.outer(mu, mu)
    ybar = st["sy"] / n
    xty_c = st["xty"] - n * np.outer(mu, ybar)
    a = (xtx_c / np.outer(sd, sd))[np.ix_(keep, keep)]
    b = (xty_c / sd[:, None])[keep]
    w = np.linalg.solve(a + alpha * np.eye(a.shape[0]), b)
    coef = np.zeros((len(mu), b.shape[1]))
    coef[keep] = w / sd[keep][:, None]                       # back to raw feature scale
    intercept = ybar - mu @ coef
    return {"coef": coef, "intercept": intercept, "keep": keep}


def predict(df: DataFrame, x_col: str, model: dict, out: str = "pred") -> DataFrame:
    """M4 predict: argmax of the per-label decision values, built-in expressions
    only (the coefficients are literals sized by the model, not the data)."""
    coef, b = model["coef"], model["intercept"]
    x = F.col(x_col).cast("array<double>")
    scores = []
    for k in range(coef.shape[1]):
        w = F.array(*[F.lit(float(v)) for v in coef[:, k]])
        s = F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(float(b[k])), lambda acc, v: acc + v)
        scores.append(F.struct(s.alias("s"), F.lit(-k).alias("k")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return df.withColumn(out, (-best["k"]).cast("int"))


def save_model(spark, model: dict, path: str) -> None:
    """M8: coefficients as a parquet table (label, intercept, coef)."""
    rows = [(k, float(model["intercept"][k]), [float(v) for v in model["coef"][:, k]])
            for k in range(model["coef"].shape[1])]
    spark.createDataFrame(rows, "label int, intercept double, coef array<double>") \
         .write.mode("overwrite").parquet(path)


class RidgePipeline:
    """M4: steps (scale → variance filter → ridge) as fit / transform."""

    def __init__(self, x_col: str, y_col: str, n_labels: int, alpha: float = 1.0, var_threshold: float = 0.0):
        self.x_col, self.y_col, self.n_labels = x_col, y_col, n_labels
        self.alpha, self.var_threshold = alpha, var_threshold
        self.model = None

    def fit(self, df: DataFrame) -> "RidgePipeline":
        st = ridge_stats(df, self.x_col, self.y_col, self.n_labels)[0]
        self.model = ridge_solve(st, self.alpha, self.var_threshold)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return predict(df, self.x_col, self.model)


def pca_2d(df: DataFrame, x_col: str, id_col: str) -> DataFrame:
    """M9: centre (no scaling) then 2-component PCA with Spark ML.  Spark's PCA
    does not centre the projection, hence the explicit StandardScaler."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = df.select(id_col, array_to_vector(F.col(x_col).cast("array<double>")).alias("x"))
    pipe = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="xc", withMean=True, withStd=False),
                            PCA(k=2, inputCol="xc", outputCol="pc")])
    out = pipe.fit(v).transform(v).select(id_col, vector_to_array("pc").alias("pc"))
    return out.select(id_col, F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))

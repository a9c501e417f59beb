"""Multi-label metric algebra.

Truth and prediction are long ``(id, label)`` tables.  Instead of a full
outer join we union them tagged (t, p), aggregate per (id, label) — a partial
aggregate — and then per label; tp/fp/fn are sums, so every metric here is
built from summable state and also works per fold, per block or in a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggs import spread


def _safe_div(a: Column, b: Column) -> Column:
    """Zero denominator → 0.0 (sklearn's zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(truth: DataFrame, pred: DataFrame, keys: list[str], label: str = "label",
              parts: DataFrame | None = None) -> DataFrame:
    """Per (keys…, label): tp, fp, fn, support.  ``keys`` holds the entity id
    first and any grouping columns (rep, fold, block) after it; repeated rows count once.

    ``parts`` (entity id, more grouping columns; no row twice): every entity counts in each of its parts, to
    which it is joined after truth and prediction have met, not before.

    The tagged rows are ``spread`` before the first aggregate: nearly all of them differ."""
    t = truth.select(*keys, label, F.lit(1).alias("__t"), F.lit(0).alias("__p"))
    p = pred.select(*keys, label, F.lit(0).alias("__t"), F.lit(1).alias("__p"))
    both = (spread(t.unionByName(p), *keys, label).groupBy(*keys, label)
              .agg(F.max("__t").alias("__t"), F.max("__p").alias("__p")))
    grp = keys[1:] + [label]
    if parts is not None:
        both, grp = both.join(parts, keys[0]), keys[1:] + [c for c in parts.columns if c != keys[0]] + [label]
    return both.groupBy(*grp).agg(
        F.sum(F.col("__t") * F.col("__p")).alias("tp"),
        F.sum((1 - F.col("__t")) * F.col("__p")).alias("fp"),
        F.sum(F.col("__t") * (1 - F.col("__p"))).alias("fn"),
    ).withColumn("support", F.col("tp") + F.col("fn"))


def with_scores(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 per row of a confusion table."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (conf.withColumn("precision", _safe_div(tp, tp + fp))
                .withColumn("recall", _safe_div(tp, tp + fn))
                .withColumn("f1", _safe_div(2 * tp, 2 * tp + fp + fn)))


# Registry of averaged metrics — name → aggregate Column over a scored table.
AVERAGES = {
    "macro": lambda m: F.avg(F.col(m)),
    "weighted": lambda m: _safe_div(F.sum(F.col(m) * F.col("support")), F.sum("support")),
}


def averaged(scored: DataFrame, group: list[str], average: str,
             metrics=("precision", "recall", "f1")) -> DataFrame:
    """A16 (macro) / A17 (support-weighted) over the labels of each group."""
    agg = AVERAGES[average]
    return scored.groupBy(*group).agg(*[agg(m).alias(f"{average}_{m}") for m in metrics])


def label_mask(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Labels with at least one positive in both parts."""
    return train.select(label).intersect(test.select(label))


def masked_confusion(train: DataFrame, test: DataFrame, pred: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """A14 + A16: the confusion of the test part over the labels with a positive in both parts; ``averaged`` and
    ``with_scores`` go on from it."""
    mask = label_mask(train, test, label)
    return confusion(test, pred, keys, label).join(mask, label, "left_semi")

"""Aggregations (A1–A13, A24–A27) over long tables.

Lists are built from pre-deduplicated (key, value) pairs with
``collect_set``/``collect_list`` only where the value domain is bounded
(label vocabularies); everything else is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` over all shuffle partitions, for an aggregate on them whose keys hardly repeat
    within a task: no scan keeps a table of its keys, and, as the number is given, the partitions are
    not merged by their compressed size, from which such tables grow tenfold."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sorted_set(col: str) -> Column:
    """Sorted distinct values of a group."""
    return F.array_sort(F.collect_set(F.col(col)))


def parallel_lists(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """A3: per composite key one list per column, in the order of the rows and with repeats, so that the
    lists' positions belong together (nulls keep theirs).  A list is one cell of the result."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.struct(*order).alias("__o"), F.struct(*columns).alias("__v")])))
    held = df.groupBy(*keys).agg(rows.alias("__rows"))
    return held.select(*keys, *[F.col("__rows")["__v"][c].alias(c) for c in columns])


def describe(df: DataFrame, col: str) -> DataFrame:
    """A4: count, mean, sample std, min, exact quartiles, max of a numeric column."""
    c = F.col(col)
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), q.alias("__q"), F.max(c).cast("double").alias("max"),
    ).select("count", "mean", "std", "min",
             F.col("__q")[0].alias("q25"), F.col("__q")[1].alias("q50"), F.col("__q")[2].alias("q75"),
             "max")


def quantile(df: DataFrame, col: str, q: float) -> Column:
    """Exact quantile with linear interpolation, as a scalar subquery Column."""
    return df.agg(F.percentile(F.col(col), q)).scalar()


def survival_counts(lengths: DataFrame, col: str, max_len: int = 10) -> DataFrame:
    """Number of items with length > L for L = 0..max_len (zero rows kept).

    Lengths are first reduced to a (length, n) histogram (partial aggregate);
    each histogram bin then contributes to the thresholds below it — no join
    of the raw rows against the threshold list.
    """
    hist = lengths.groupBy(F.col(col).alias("__len")).agg(F.count(F.lit(1)).alias("__n"))
    ls = F.sequence(F.lit(0), F.lit(max_len))
    contrib = hist.select(F.explode(F.filter(ls, lambda L: F.col("__len") > L)).alias("L"), "__n")
    per_l = contrib.groupBy("L").agg(F.sum("__n").alias("n_chains"))
    grid = lengths.sparkSession.range(0, max_len + 1).select(F.col("id").cast("int").alias("L"))
    return (grid.join(per_l, "L", "left")
                .select("L", F.coalesce(F.col("n_chains"), F.lit(0)).cast("long").alias("n_chains")))

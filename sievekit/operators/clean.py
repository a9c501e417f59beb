"""Projection, filtering and cleaning operators.

Frequency-based filters (P6, P7, P14) aggregate first (partial aggregation
map-side), rank the small aggregate, and remove values with a join — the big
table is never sorted or windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import anti_join
from .ranking import global_position


def normalise_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def resolve_column(df: DataFrame, name: str, position: int) -> str:
    """The column called ``name`` if present, else the one at ``position``."""
    return name if name in df.columns else df.columns[position]


def not_in(df: DataFrame, col: str, values: list, keep_null: bool = True) -> DataFrame:
    """Drop rows whose value is in a literal list (NULLs kept by default)."""
    c = F.col(col)
    cond = ~c.isin(values)
    return df.filter(c.isNull() | cond if keep_null else cond)


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A1: rows per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def top_frequent(df: DataFrame, col: str, k: int, name: str = "freq_rank") -> DataFrame:
    """A2: the ``k`` most frequent values with 1-based rank (count desc, value asc).

    ``orderBy(...).limit(k)`` plans as a distributed TakeOrdered over the
    per-value aggregate; the rank window then sees only ``k`` rows.
    """
    top = value_counts(df, col).orderBy(F.desc("n"), F.asc(col)).limit(k)
    return top.withColumn(name, F.row_number().over(Window.orderBy(F.desc("n"), F.asc(col))))


def drop_frequent(df: DataFrame, col: str, top_n: int = 0, ranks: list[int] | None = None) -> DataFrame:
    """Drop the ``top_n`` most frequent values and/or values at given ranks."""
    k = max([top_n, *(ranks or [])])
    fr = top_frequent(df, col, k)
    cond = F.col("freq_rank") <= top_n
    if ranks:
        cond = cond | F.col("freq_rank").isin(ranks)
    return anti_join(df, fr.filter(cond).select(col), col)


def drop_positions(df: DataFrame, col: str, ordinal: str, positions: list[int]) -> DataFrame:
    """P5: drop values at 0-based positions of the first-seen distinct list."""
    first = df.groupBy(col).agg(F.min(ordinal).alias("__o"))
    head = first.orderBy("__o", col).limit(max(positions) + 1)
    pos = head.withColumn("__pos", F.row_number().over(Window.orderBy("__o", col)) - 1)
    return anti_join(df, pos.filter(F.col("__pos").isin(positions)).select(col), col)


def min_group_size(df: DataFrame, group: str, n: int) -> DataFrame:
    """Keep rows of groups with at least ``n`` rows (count, filter, semi join)."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n)
    return df.join(big.select(group), group, "left_semi")


def parse_or_drop(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Derive a key; drop rows where it cannot be derived (no misalignment)."""
    return df.withColumn(name, expr).filter(F.col(name).isNotNull())


def fold_label(long: DataFrame, label: str, source: str, target: str, keys: list[str]) -> DataFrame:
    """Logical OR of ``source`` into ``target``; ``source`` disappears."""
    return (long.withColumn(label, F.when(F.col(label) == source, F.lit(target))
                            .otherwise(F.col(label)))
                .select(*keys, label).distinct())


def label_index(long: DataFrame, label: str = "label", name: str = "label_idx") -> DataFrame:
    """Sorted distinct labels → dense 0-based index."""
    return (global_position(long.select(label).distinct(), [label], "__pos")
            .select(label, (F.col("__pos") - 1).cast("int").alias(name)))


def code_to_name(df: DataFrame, code: str, dim: DataFrame, dim_code: str, dim_name: str,
                 out: str) -> DataFrame:
    """Code → display name, keeping the code when there is no name."""
    d = dim.select(F.col(dim_code).alias("__code"), F.col(dim_name).alias("__name"))
    j = df.join(d, df[code] == d["__code"], "left")
    return j.withColumn(out, F.coalesce(F.col("__name"), F.col(code).cast("string"))) \
            .drop("__code", "__name")


def over_frequent_filter(pairs: DataFrame, a: str, b: str, q: float = 0.99) -> DataFrame:
    """Drop pairs touching a node whose count over both roles is > the q-quantile.

    One partial aggregate of node counts, one exact ``percentile`` over the
    (node, count) aggregate (a scalar subquery), and two anti joins.
    """
    nodes = pairs.select(F.col(a).alias("__v")).unionAll(pairs.select(F.col(b).alias("__v")))
    counts = nodes.groupBy("__v").agg(F.count(F.lit(1)).alias("__c"))
    thr = counts.agg(F.percentile("__c", q)).scalar()          # scalar subquery
    hot = counts.filter(F.col("__c") > thr).select("__v")
    out = pairs.join(hot.withColumnRenamed("__v", a), a, "left_anti")
    return out.join(hot.withColumnRenamed("__v", b), b, "left_anti")

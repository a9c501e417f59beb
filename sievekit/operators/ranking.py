"""Keep-first, offsets, class assignment and best-match operators.

Skew rule: a key or stratum may hold a third of all rows, so nothing here
uses a plain ``Window.partitionBy(key)`` over unbounded groups.  Keep-first
is an aggregate (``min_by``) with map-side partial aggregation; positions
inside a group are computed by ``ordered_position``, which splits every group
over range partitions first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _cols(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key — the row with the smallest ``order`` tuple.

    Expressed as ``groupBy(keys).agg(min_by(struct(rest), struct(order)))`` so
    each mapper collapses its share of a hot key before the shuffle.
    """
    keys = _cols(keys)
    order = _cols(order)
    rest = [c for c in df.columns if c not in keys]
    ordc = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*rest), ordc).alias("__first"))
              .select(*keys, "__first.*"))


def ordered_position(df: DataFrame, group, order: list, name: str = "pos", drop: tuple[str, ...] = ()) -> DataFrame:
    """1-based position of each row inside ``group`` by the column tuple ``order``; the columns ``drop`` are left out.

    The rows are range-partitioned and sorted on (group, order), numbered along their run of one group in the
    range and written once, so their number of ranges grows with the data and a group holding a third of all
    rows spans many of them.  Only a range's first run can go on from earlier ranges: its offset
    is the sum of the last runs of that group there, one small row per range.  ``order`` should be unique
    inside a group.
    """
    from ..functions.udfs import run_places
    group, order = _cols(group), _cols(order)
    kept = [c for c in df.columns if c not in drop]
    ranges = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    columns = [*kept, *[g for g in group if g not in kept]]
    runs = cut_lineage(ranges.select(*columns, F.spark_partition_id().alias("__b"), run_places(*group).alias("__v")))
    place, first, last = F.shiftright("__v", 2), F.col("__v").bitwiseAND(2) > 0, F.col("__v").bitwiseAND(1) > 0
    edges = runs.filter(last | (first & (place == 1)))
    counts = edges.groupBy(*group, "__b").agg(F.sum(F.when(last, place).otherwise(0)).alias("__n"),
                                              F.max(first & (place == 1)).alias("__first"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("__first", F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    offs = cut_lineage(offs.filter("__first").select("__c", "__off"))
    return (runs.join(offs, F.col("__b") == F.col("__c"))
                .select(*kept, (place + F.when(first, F.col("__off")).otherwise(0)).cast("long").alias(name)))


def group_position(df: DataFrame, group, order_hex: str, name: str = "pos", drop: tuple[str, ...] = ()) -> DataFrame:
    """``ordered_position`` by one unique order key (md5 of seed‖id)."""
    return ordered_position(df, group, [order_hex], name, drop)


def global_position(df: DataFrame, order: list, name: str = "pos", drop: tuple[str, ...] = ()) -> DataFrame:
    """1-based position among all rows, without a one-task window."""
    return ordered_position(df.withColumn("__all", F.lit(0)), "__all", order, name, ("__all", *drop))


SPAN = 64


def _stretches(pos: Column, span: int, max_k: int) -> Column:
    """The stretches that a row goes to: its own, and near its start the one before, but none lies before the first."""
    b = F.floor(pos / span)
    return F.when((pos % span < max_k) & (b != 0), F.array(b, b - 1)).otherwise(F.array(b))


def offset_pairs(chains: DataFrame, group: str, pos: str, node: str, max_k: int,
                 sep_name: str = "separation", carry: tuple[str, ...] = ()) -> DataFrame:
    """(node_i, node_{i+k}) for k = 1..max_k along each ordered chain (positions unique in a group, from 0 or 1 on);
    ``carry``: columns that come along from both ends, suffixed _1 and _2.

    A group is cut into stretches of ``SPAN`` positions, each with the first ``max_k`` rows of the next one,
    so a row travels once (near a cut twice) and no window holds a whole group.  A null group has no chain."""
    span = max(SPAN, max_k)
    stretches = _stretches(F.col(pos), span, max_k)
    x = (chains.filter(F.col(group).isNotNull() & F.col(pos).isNotNull())
               .select(F.col(group), F.col(pos).alias("__p"), F.struct(F.col(node).alias("n"), *carry).alias("__x"),
                       F.explode(stretches).alias("__b")))
    w = Window.partitionBy(group, "__b").orderBy("__p")
    ahead = [F.lead(F.struct("__p", "__x"), k).over(w) for k in range(1, max_k + 1)]
    x = x.select(group, "__p", "__b", "__x", F.array(*ahead).alias("__a")).filter(F.floor(F.col("__p") / span) == F.col("__b"))
    near = F.filter("__a", lambda y: y["__p"] - F.col("__p") <= max_k)      # null: the chain's end
    x = x.select(group, "__p", "__x", F.explode(near).alias("__y"))
    return x.select(group, F.col("__x.n").alias("mol1"), F.col("__y.__x.n").alias("mol2"),
                    (F.col("__y.__p") - F.col("__p")).cast("int").alias(sep_name),
                    *[F.col(f"{side}.{c}").alias(c + s) for side, s in (("__x", "_1"), ("__y.__x", "_2")) for c in carry])


def assign_by_rank(long_labels: DataFrame, id_col: str, label: str, rank: str,
                   default: str | None = None) -> DataFrame:
    """Per id, the positive label with the smallest rank (else ``default``)."""
    out = long_labels.groupBy(id_col).agg(F.min_by(F.col(label), F.col(rank)).alias("assigned"))
    if default is not None:
        out = out.withColumn("assigned", F.coalesce("assigned", F.lit(default)))
    return out


def assign_second(long_labels: DataFrame, id_col: str, label: str, rank: str) -> DataFrame:
    """The second positive (by rank) when several exist, else the only one.

    Two partial aggregates (smallest, then smallest above it) instead of
    collecting each id's labels into one list.
    """
    firsts = long_labels.groupBy(id_col).agg(
        F.min(F.struct(F.col(rank).alias("r"), F.col(label).alias("l"))).alias("__m1"),
        F.count(F.lit(1)).alias("__n"))
    rest = (long_labels.join(firsts.select(id_col, "__m1"), id_col)
            .filter(F.struct(F.col(rank).alias("r"), F.col(label).alias("l")) > F.col("__m1"))
            .groupBy(id_col)
            .agg(F.min(F.struct(F.col(rank).alias("r"), F.col(label).alias("l"))).alias("__m2")))
    return (firsts.join(rest, id_col, "left")
            .select(id_col, F.coalesce(F.col("__m2.l"), F.col("__m1.l")).alias("assigned")))

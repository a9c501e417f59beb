"""Column expressions shared by the operators (JVM-side only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

HEX_DIGITS = 13
HEX_SPAN = float(16 ** HEX_DIGITS)


def text_of(name: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def split_words(text: Column, gap: str = SPACE) -> Column:
    """Maximal runs of characters outside ``gap``, in order."""
    return F.array_remove(F.split(text, gap), "")


def unit_hash(*parts: Column) -> Column:
    """A draw in [0, 1) fixed by the parts: the leading 52 bits of their MD5."""
    whole = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(whole), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(HEX_SPAN)


def hash_ranks(df: DataFrame, group: list[str], keys: list[str], out: str,
               n_rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Add ``out``: the gapless rank from 0 of each row inside its group.

    Rows are ordered by (MD5 draw of the keys, keys).  The draw is cut into as
    many equal ranges as the row count asks for, so a group that holds a third
    of all rows is still ranked by many tasks, each over about ``per_bucket``
    rows; range sizes turn into offsets in a window over the small count table.
    Rows that agree in all keys get different ranks in any order.
    ``df`` is read twice, so pass a written table.
    """
    buckets = max(1, -(-n_rows // per_bucket))
    drawn = df.withColumn("_draw", unit_hash(*[F.col(k) for k in keys]))
    drawn = drawn.withColumn("_bucket", F.floor(F.col("_draw") * buckets).cast("long"))
    near = Window.partitionBy(*group, "_bucket").orderBy("_draw", *keys)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (drawn.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    match = F.col("_bucket") == F.col("_b")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    ranked = drawn.withColumn("_near", F.row_number().over(near) - 1)
    return (ranked.join(starts, match)
            .withColumn(out, (F.col("_start") + F.col("_near")).cast("long"))
            .drop("_draw", "_bucket", "_b", "_n", "_start", "_near", *[f"_g_{g}" for g in group]))


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key meets a null key; the keys of ``a`` stay."""
    other = b.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return a.join(other, same, how).drop(*[f"_k{n}" for n in range(len(keys))])

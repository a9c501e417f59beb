"""Join operators (J1–J14) and set operations.

No join here forces a broadcast: AQE turns a sort-merge join into a broadcast
join only after it has measured the bytes of the shuffled side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    """O1: union by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def anti_join(df: DataFrame, other: DataFrame, on, null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``.

    ``null_safe=True`` treats NULL keys as equal (pandas ``isin`` behaviour);
    the default keeps NULL-key rows, as SQL ``NOT EXISTS`` does.
    """
    keys = [on] if isinstance(on, str) else list(on)
    right = other.select(*keys).distinct()           # pre-aggregate hot keys map-side
    if not null_safe:
        return df.join(right, keys, "left_anti")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return df.join(r, cond, "left_anti")


def anti_join_many(df: DataFrame, others: list[DataFrame], on: str) -> DataFrame:
    """Remove every key present in any held-out set — one union, one shuffle."""
    keys = union_all([o.select(on) for o in others])
    return anti_join(df, keys, on)


def semi_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def mandatory_lookup(df: DataFrame, dim: DataFrame, on: str, value: str) -> DataFrame:
    """Left join; a missing key raises at execution time instead of yielding NULL."""
    j = df.join(dim, on, "left")
    return j.withColumn(value, F.when(F.col(value).isNull(),
                                      F.raise_error(F.concat(F.lit("missing key: "),
                                                             F.col(on).cast("string"))))
                        .otherwise(F.col(value)))


def role_join(pairs: DataFrame, dim: DataFrame, key: str, roles: dict[str, str],
              cols: list[str]) -> DataFrame:
    """Join the same dimension once per role, suffixing its columns.

    ``roles`` maps pair column → suffix, e.g. {"mol1": "_mol1", "mol2": "_mol2"}.
    """
    out = pairs
    for col, suf in roles.items():
        d = dim.select(F.col(key).alias(col), *[F.col(c).alias(c + suf) for c in cols])
        out = out.join(d, col, "left")
    return out


def fanout_join(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner equi join on a derived key, every match kept; the other columns get the suffixes.

    A key that m and n rows share gives its m x n rows, which are the answer itself.  Rows of a hot key are
    spread by the skew join, and a null key meets nothing."""
    a = left.select(key, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c != key])
    b = right.select(key, *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c != key])
    return a.join(b, key)


def first_match(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """First value per key by ordinal (one row per key)."""
    return df.groupBy(key).agg(F.min_by(F.col(value), F.col(ordinal)).alias(value))


def last_match(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """Last occurrence wins."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.col(ordinal)).alias(value))


def explode_cross(df: DataFrame, left: str, right: str, out_left: str = "src",
                  out_right: str = "dst") -> DataFrame:
    """Every left member × every right member of the same row (one reaction)."""
    return (df.withColumn(out_left, F.explode(F.col(left)))
              .withColumn(out_right, F.explode(F.col(right))))

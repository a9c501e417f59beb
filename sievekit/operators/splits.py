"""Deterministic sampling and splitting.

Every random choice is an ordering by ``md5(seed || '|' || id)``: identical in
Spark and in SQL engines, reproducible, and independent of partitioning.
Positions inside a stratum come from ``ranking.group_position`` (over range
partitions), so a stratum holding a third of all rows is still sorted by many
tasks.  No split is materialised per (rep, fold): one long table
``(rep, id, fold)`` carries everything and roles are predicates on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .ranking import global_position, group_position


def seeded_hash(seed, id_col: str) -> Column:
    s = F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")
    return F.md5(F.concat(s, F.lit("|"), F.col(id_col).cast("string")))


def sample_fixed(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, the smallest seeded hashes (distributed top-n)."""
    return df.withColumn("__h", seeded_hash(seed, id_col)).orderBy("__h", id_col).limit(n)


def shuffle_positions(df: DataFrame, id_col: str, seed: int, name: str = "pos") -> DataFrame:
    """A full seeded permutation as a 1-based position column."""
    return global_position(df.withColumn("__h", F.unhex(seeded_hash(seed, id_col))), ["__h"], name, ("__h",))


def first_positions(df: DataFrame, id_col: str, seed, n: int, share: float, name: str = "pos") -> DataFrame:
    """The rows at positions 1..n of the seeded permutation; ``share``: about n by all rows.

    Only rows whose hash lies below a bound somewhat above that share are ordered; where fewer than n do
    (many equal ids), all rows are."""
    x = df.withColumn("__h", seeded_hash(seed, id_col)).drop(id_col)
    below = x.filter(F.col("__h") < F.lit(f"{min(0xffffffff, int((share * 1.05 + 1e-4) * 2**32)):08x}"))
    below = cut_lineage(below)
    if below.count() < n:
        below = x
    return global_position(below, ["__h"], name, ("__h",)).filter(F.col(name) <= n)


def rarest_label(long: DataFrame, id_col: str, label: str) -> DataFrame:
    """T6 stratum: the row's positive label with the fewest positives overall
    (ties by label name): the smallest (positives, label) pair, with no rank over labels."""
    cnt = cut_lineage(long.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))      # its size is known to the join
    return (long.join(cnt, label).groupBy(id_col)
                .agg(F.min(F.struct(F.col("__n"), F.col(label).alias("__l")))["__l"].alias("stratum")))


def stratified_folds(strata: DataFrame, id_col: str, k: int = 5, reps: int = 5) -> DataFrame:
    """(rep, id, stratum, fold) with fold = (position in stratum − 1) % k,
    positions ordered by md5(rep‖id); reps are generated per row (no cross join)."""
    x = (strata.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
               .withColumn("rep", F.col("rep").cast("long"))
               .withColumn("__h", F.unhex(seeded_hash(F.col("rep"), id_col))))
    p = group_position(x, ["rep", "stratum"], "__h", name="__pos", drop=("__h",))
    return p.select("rep", id_col, "stratum", ((F.col("__pos") - 1) % k).alias("fold"))


def _deal(given: list[int], sizes: list[int], position: Column) -> Column:
    """Fold of the row at a 1-based position when every row goes to the fold that still wants most.

    ``given`` are the label's rows per fold so far and ``sizes`` all rows per fold.  All folds want
    the same share, so fold j is ``given[j]`` rows behind its demand: the folds with fewest rows are
    filled first, then one more fold joins, and the rows go round the joined folds.  A fold's rows of
    other labels, ``sizes - given``, settle ties, then its number; the order stays the same
    from turn to turn, so a fold is a few comparisons on the position and no row waits for the one before.
    """
    k = len(given)
    order = sorted(range(k), key=lambda j: (sizes[j] - given[j], j))
    start, fold = 0, None
    levels = sorted(set(given))
    for n, level in enumerate(levels):
        joined = [j for j in order if given[j] <= level]
        turn = F.array(*[F.lit(j) for j in joined])[((position - 1 - start) % len(joined)).cast("int")]
        fold = turn if fold is None else F.when(position > start, turn).otherwise(fold)
        if n + 1 < len(levels):
            start += (levels[n + 1] - level) * len(joined)
    return fold.cast("long")


def iterative_folds(long: DataFrame, id_col: str, label: str, k: int = 5, reps: int = 5) -> DataFrame:
    """(rep, id, fold) by iterative stratification of a multi-label table (id, label).

    A round takes the label with the fewest open rows (ties: by label) and deals them, in the order
    of md5(rep | id), to the fold that still wants most rows of that label, ties to the fold that
    wants most rows in all, then to the lower number; every label of a dealt row lowers that
    fold's demand.  The counts (labels x folds x repetitions, sized by the vocabulary) are the only
    state on the driver.  The open rows of a label do not depend on the folds, so all repetitions
    share a round.  The rows are written once per label that they hold, and a round reads
    its own label's rows only; positions come from range partitions, so a label on most rows is dealt
    by many tasks.
    """
    spark = long.sparkSession
    pairs = long.select(id_col, label).filter(F.col(label).isNotNull()).distinct()
    counts = {r[label]: r["n"] for r in pairs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    number = {x: n for n, x in enumerate(names)}
    held = pairs.groupBy(id_col).agg(F.collect_list(label).alias("__labels"))
    if not names:
        return held.select(F.lit(0).cast("long").alias("rep"), id_col, F.lit(0).cast("long").alias("fold"))
    path = scratch_path(spark, "label-rows")
    numbers = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    (held.select(id_col, F.array_sort(F.transform("__labels", lambda x: numbers[x])).alias("__held"))
         .withColumn("__label", F.explode("__held")).write.partitionBy("__label").parquet(path))
    rows = spark.read.parquet(path)
    open_rows = [counts[x] for x in names]
    given = [[[0] * k for _ in names] for _ in range(reps)]
    sizes = [[0] * k for _ in range(reps)]
    done, parts = [], []
    while len(done) < len(names):
        now = min((n for n in range(len(names)) if n not in done), key=lambda n: (open_rows[n], n))
        left = rows.filter(F.col("__label") == now).drop("__label")
        if done:
            left = left.filter(~F.arrays_overlap("__held", F.array(*[F.lit(n) for n in done])))
        done.append(now)
        if not open_rows[now]:
            continue
        x = left.withColumn("rep", F.explode(F.array(*[F.lit(r).cast("long") for r in range(reps)])))
        x = x.withColumn("__h", seeded_hash(F.col("rep"), id_col))
        placed = group_position(x, "rep", "__h", name="__pos")
        fold = F.lit(None).cast("long")
        for r in range(reps):
            fold = F.when(F.col("rep") == r, _deal(given[r][now], sizes[r], F.col("__pos"))).otherwise(fold)
        dealt = cut_lineage(placed.select("rep", id_col, "__held", fold.alias("fold")))
        parts.append(dealt)
        for c in dealt.select("rep", "fold", F.explode("__held").alias("n")).groupBy("rep", "fold", "n").count().collect():
            given[c["rep"]][c["n"]][c["fold"]] += c["count"]
            open_rows[c["n"]] -= c["count"] if c["rep"] == 0 else 0
            sizes[c["rep"]][c["fold"]] += c["count"] if c["n"] == now else 0
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rep", id_col, "fold")


def position_cut(df: DataFrame, stratum: str, id_col: str, seed, frac: float,
                 inside: str, outside: str, role: str = "role") -> DataFrame:
    """Per stratum, the first ceil(frac·m) rows by md5(seed‖id) get ``inside``.

    A single-member stratum therefore always lands ``inside`` (trap 25).  Rows per (stratum, first three hex
    digits of the hash) are counted; the cut falls into one such bin of a stratum, and only that bin's rows
    are ordered.  All others are decided by their digits alone and never travel.  ``df`` is read several
    times, so it should be a written table or cheap to derive from one.
    """
    grp = [stratum] if isinstance(stratum, str) else list(stratum)
    x = df.withColumn("__h", seeded_hash(seed, id_col)).withColumn("__p", F.coalesce(F.substring("__h", 1, 3), F.lit("")))
    bins = x.groupBy(*grp, "__p").agg(F.count(F.lit(1)).alias("__n"))
    all_rows = Window.partitionBy(*grp)
    before = all_rows.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    pct = int(round(frac * 100))               # exact: ceil(m·pct/100) in integers
    bins = bins.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))) \
               .withColumn("__left", F.floor((F.sum("__n").over(all_rows) * pct + 99) / 100) - F.col("__off"))
    here = (F.col("__left") > 0) & (F.col("__left") <= F.col("__n"))
    cuts = cut_lineage(bins.groupBy(*grp).agg(F.max(F.when(here, F.col("__p"))).alias("__at"),
                                              F.max(F.when(here, F.col("__left"))).alias("__k")))
    y = x.join(cuts, grp)
    ranked = group_position(y.filter("__p = __at"), grp, "__h", name="__pos")
    ranked = ranked.withColumn(role, F.when(F.col("__pos") <= F.col("__k"), inside).otherwise(outside))
    others = y.filter("__at is null or __p != __at").withColumn(role, F.when(F.col("__p") < F.col("__at"), inside).otherwise(outside))
    columns = [*grp, *[c for c in df.columns if c not in grp], role]
    return others.select(*columns).unionByName(ranked.select(*columns))


def group_split(sizes: DataFrame, group: str, frac_train: float = 0.8, frac_val: float = 0.1,
                n: str = "n") -> DataFrame:
    """Whole groups to train/val/test, largest groups first.

    Cut points on the running row count over (size desc, md5(group)).  The
    running sum is distributed: rows of equal size form one bucket whose
    offset comes from a window over the (few) distinct sizes, and the
    position inside a bucket comes from the bucketed ``group_position``.
    """
    s = sizes.withColumn("__h", F.md5(F.col(group).cast("string")))
    per_size = s.groupBy(n).agg(F.count(F.lit(1)).alias("__g"))
    w = Window.orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("__off", F.coalesce(F.sum(F.col(n) * F.col("__g")).over(w), F.lit(0)))
    total = sizes.agg(F.sum(n)).scalar()
    p = group_position(s, n, "__h", name="__pos").join(per_size.select(n, "__off"), n)
    cum = F.col("__off") + F.col("__pos") * F.col(n)
    # exact integer comparison in percent: cum/total <= frac
    t_pct, v_pct = int(round(frac_train * 100)), int(round((frac_train + frac_val) * 100))
    role = (F.when(cum * 100 <= total * t_pct, "train")
             .when(cum * 100 <= total * v_pct, "val").otherwise("test"))
    return p.select(group, n, cum.alias("cum_rows"), role.alias("role"))

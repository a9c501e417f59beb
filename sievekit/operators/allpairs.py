"""All pairs over dense vectors, blocks far apart skipped (J9, F1, W6, W7, G9 on vectors).

Pairs are never stored.  Unit vectors are ordered by (nearest pivot, angle to it) and cut into blocks
of about ``BLOCK`` rows (range partitions), so that a block lies in one direction as far as the data allow.  A
block has a centre and a radius (its largest angle to the centre); two vectors of blocks with
centres at angle t cannot be closer than ``t - r1 - r2``.  A pair of blocks is visited only where that
leaves a chance: above the caller's threshold, above the worst nearest neighbour found inside the
two blocks, or within the lists of nearest others that the spanning tree is built from.  A row is copied once per
visited pair of its block, at most n / BLOCK times (n / WIDE for the tree) where nothing can be skipped (vectors
without any clusters), and ``skipped`` reports the share.

One Arrow-batched ``applyInPandas`` call per visited pair multiplies ``SUB`` x ``SUB`` tiles (the tree: ``SPAN``), and emits
only what the caller needs: pairs above a threshold, per-row bests, or per-row lists of nearest others,
which Spark reduces with ordinary aggregates.  A group holds about 2 * BLOCK vectors (the tree: 2 * WIDE).
Vectors of length zero have no cosine and meet nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BLOCK = 8192
SUB = 2048
MIN_BLOCKS = 8          # small inputs still spread over tasks
PIVOTS = 256            # vectors that set the directions of the blocks; a bounded sample, any choice is exact
SLACK = 1e-7            # for the rounding of angles


class Blocks(NamedTuple):
    measured: bool      # False: few blocks, of any directions, and every pair is visited
    rows: DataFrame     # id, vec (unit length), blk
    pairs: DataFrame    # b1 <= b2, reach: greatest cosine that a pair of their vectors can have


def _unit(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest one left, so that blocks across two pivots stay narrow."""
    c, order, left = pivots @ pivots.T, [0], set(range(1, len(pivots)))
    while left:
        order.append(max(left, key=lambda k: c[order[-1], k]))
        left.remove(order[-1])
    return pivots[order]


def _nearest_pivot(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                c = np.clip(_unit(pdf["vec"]) @ pivots.T, -1, 1)
                k = c.argmax(axis=1)
                yield pdf.assign(pivot=k.astype("int32"), angle=np.arccos(c[np.arange(len(k)), k]))
    return run


def _extent(pdf: pd.DataFrame) -> pd.DataFrame:
    x = _unit(pdf["vec"])
    mean = x.mean(axis=0)
    length = np.linalg.norm(mean)
    centre = mean / length if length > 1e-12 else x[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    return pd.DataFrame({"blk": pdf["blk"].iloc[:1], "centre": [centre], "radius": [radius]})


def make_blocks(vecs: DataFrame, id_col: str, vec_col: str, tile: int = BLOCK) -> Blocks:
    x = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))
    unit = (vecs.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), norm.alias("n")).filter("n > 0")
                .select("id", F.transform("x", lambda v: v / F.col("n")).alias("vec")))
    n = vecs.count()
    nb = max(1, min(n, max(math.ceil(n / tile), MIN_BLOCKS)))
    if nb <= MIN_BLOCKS:
        # few pairs of blocks: a visit to each costs less than finding out which to skip
        rows = unit.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int"))
        pairs = vecs.sparkSession.range(nb).select(F.col("id").cast("int").alias("b1")) \
            .withColumn("b2", F.explode(F.sequence(F.col("b1"), F.lit(nb - 1))))
        return Blocks(False, rows, pairs.withColumn("reach", F.lit(1.0)))
    unit = cut_lineage(unit)        # read by three passes
    pivots = [r["vec"] for r in unit.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, nb)).collect()]
    if not pivots:
        return Blocks(False, unit.withColumn("blk", F.lit(0)), vecs.sparkSession.createDataFrame([], "b1 int, b2 int, reach double"))
    near = unit.mapInPandas(_nearest_pivot(_chain(np.array(pivots))), "id long, vec array<double>, pivot int, angle double")
    rows = cut_lineage(near.repartitionByRange(nb, "pivot", "angle", "id")
                       .select("id", "vec", F.spark_partition_id().alias("blk")))
    extent = rows.groupBy("blk").applyInPandas(_extent, "blk int, centre array<double>, radius double")
    one = extent.select(F.col("blk").alias("b1"), F.col("centre").alias("c1"), F.col("radius").alias("r1"))
    two = extent.select(F.col("blk").alias("b2"), F.col("centre").alias("c2"), F.col("radius").alias("r2"))
    last = rows.agg(F.max("blk")).scalar()
    cosine = F.aggregate(F.zip_with("c1", "c2", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    apart = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) - F.col("r1") - F.col("r2")
    pairs = one.withColumn("b2", F.explode(F.sequence(F.col("b1"), last))).join(two, "b2")
    return Blocks(True, rows, pairs.select("b1", "b2", F.cos(F.greatest(apart - SLACK, F.lit(0.0))).alias("reach")))


def skipped(blocks: Blocks, wanted: Column) -> float:
    """Share of the pairs of blocks that a condition on ``reach`` leaves out."""
    r = blocks.pairs.agg(F.avg((~wanted).cast("double"))).first()[0]
    return float(r or 0.0)


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of both blocks of every pair."""
    first = rows.join(pairs.select(F.col("b1").alias("blk"), "b1", "b2"), "blk")
    second = rows.join(pairs.filter("b1 < b2").select(F.col("b2").alias("blk"), "b1", "b2"), "blk")
    return first.unionByName(second)


def _groups(rows: DataFrame, pairs: DataFrame):
    return _of_pairs(rows, pairs).groupBy("b1", "b2")


def _tiles(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, columns, cosines, each pair once) of the pair's tiles, rows in order of id."""
    pdf = pdf.sort_values("id", kind="stable")
    b1, b2 = int(pdf["b1"].iloc[0]), int(pdf["b2"].iloc[0])
    a = pdf[pdf["blk"] == b1]
    b = a if b1 == b2 else pdf[pdf["blk"] == b2]
    xa = _unit(a["vec"])
    xb = xa if b1 == b2 else _unit(b["vec"])
    for i in range(0, len(a), SUB):
        for j in range(i if b1 == b2 else 0, len(b), SUB):
            s = xa[i:i + SUB] @ xb[j:j + SUB].T
            once = np.ones(s.shape, bool)
            if b1 == b2 and i == j:
                once = np.triu(once, 1)
            yield a.iloc[i:i + SUB], b.iloc[j:j + SUB], s, once


PAIR_SCHEMA = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()),
                            T.StructField("sim", T.DoubleType())])


def cosine_pairs_above(vecs: DataFrame, id_col: str, vec_col: str, threshold: float, tile: int = BLOCK) -> DataFrame:
    """J9 + F1: every unordered pair (i < j) with cosine ≥ threshold."""

    def kernel(pdf):
        out = [pd.DataFrame({"i": [], "j": [], "sim": []})]
        for a, b, s, once in _tiles(pdf):
            r, c = np.nonzero(once & (s >= threshold))
            i, j = a["id"].to_numpy()[r], b["id"].to_numpy()[c]
            out.append(pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "sim": s[r, c]}))
        return pd.concat(out)

    blocks = make_blocks(vecs, id_col, vec_col, tile)
    return _groups(blocks.rows, blocks.pairs.filter(F.col("reach") >= threshold - SLACK)).applyInPandas(kernel, PAIR_SCHEMA)


def _best_kernel(pdf):
    """Best partner of every row in the visited tiles (ties → smallest id)."""
    found = []
    for a, b, s, once in _tiles(pdf):
        for rows, cols, m in ((a, b, np.where(once, s, -np.inf)), (b, a, np.where(once, s, -np.inf).T)):
            if not m.size:
                continue
            k = m.argmax(axis=1)                    # columns are in order of id
            best = m[np.arange(len(rows)), k]
            keep = np.isfinite(best)
            found.append(pd.DataFrame({"i": rows["id"].to_numpy()[keep], "j": cols["id"].to_numpy()[k][keep], "sim": best[keep]}))
    return pd.concat(found) if found else pd.DataFrame({"i": [], "j": [], "sim": []})


def _best(cand: DataFrame) -> DataFrame:
    best = cand.groupBy("i").agg(F.max(F.struct(F.col("sim").alias("s"), (-F.col("j")).alias("r"))).alias("b"))
    return best.select("i", (-F.col("b.r")).alias("j"), F.col("b.s").alias("sim"))


def nearest_neighbours(vecs: DataFrame, id_col: str, vec_col: str, tile: int = BLOCK) -> DataFrame:
    """Per vector the most similar other vector (ties → smallest id).

    Blocks are first searched by themselves; two blocks meet only if a vector of one might beat the
    worst best match of the other."""
    blocks = make_blocks(vecs, id_col, vec_col, tile)
    if not blocks.measured:
        found = _best(_groups(blocks.rows, blocks.pairs).applyInPandas(_best_kernel, PAIR_SCHEMA))
        return found.select(F.col("i").alias(id_col), F.col("j").alias("nn_id"), "sim")
    blocks = blocks._replace(pairs=cut_lineage(blocks.pairs))
    own = cut_lineage(_best(_groups(blocks.rows, blocks.pairs.filter("b1 = b2")).applyInPandas(_best_kernel, PAIR_SCHEMA)))
    worst = (blocks.rows.select("id", "blk").join(own.select(F.col("i").alias("id"), "sim"), "id", "left")
             .groupBy("blk").agg(F.min(F.coalesce("sim", F.lit(-2.0))).alias("worst")))
    open_pairs = (blocks.pairs.filter("b1 < b2").join(worst.select(F.col("blk").alias("b1"), F.col("worst").alias("w1")), "b1")
                  .join(worst.select(F.col("blk").alias("b2"), F.col("worst").alias("w2")), "b2")
                  .filter(F.col("reach") >= F.least("w1", "w2") - SLACK).select("b1", "b2"))
    far = _groups(blocks.rows, open_pairs).applyInPandas(_best_kernel, PAIR_SCHEMA)
    return _best(own.unionByName(far)).select(F.col("i").alias(id_col), F.col("j").alias("nn_id"), "sim")


def similarity_row_sums(vecs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """W6 helper: Σ_j≠i cos(i, j) per vector in O(n): the dot product of the unit vector with the
    sum of all unit vectors, less its own.  A zero vector has no cosine: its sum is NULL."""
    x = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))
    unit = (vecs.select(F.col(id_col).alias("__id"), x.alias("__x"), norm.alias("__n"))
                .select("__id", F.when(F.col("__n") > 0, F.transform("__x", lambda v: v / F.col("__n"))).alias("__u")))
    total = (unit.select(F.posexplode("__u").alias("__k", "__v")).groupBy("__k").agg(F.sum("__v").alias("__s"))
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__s"))),     # one entry per dimension
                                  lambda r: r["__s"]).alias("__t")))
    dot = F.aggregate(F.zip_with("__u", "__t", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return unit.withColumn("__t", total.scalar()).select(F.col("__id").alias(id_col), (dot - 1).alias("row_sum"))


WIDE = 4 * BLOCK        # rows of a block of the spanning tree: two blocks are two matrices in a task
NEAR = 8                # partners kept per vector and search
SPAN = 1024             # rows of a tile of the search; its float32 cosines stay near the core
FARTHEST = 3.0          # beyond any distance 1 - cos
LAST_ID = (1 << 63) - 1


def _dots(xa: np.ndarray, xb: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of single pairs, the same number wherever and from whichever side a pair is met."""
    out = np.empty(len(r))
    for k in range(0, len(r), 8192):
        out[k:k + 8192] = (xa[r[k:k + 8192]] * xb[c[k:k + 8192]]).sum(axis=1)
    return out


class _Nearest:
    """Per row the ``NEAR`` nearest partners met so far, by (distance, id), none beyond the row's ``cap`` (NaN: none wanted)."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids, self.x, self.comp = pdf["id"].to_numpy(), _unit(pdf["vec"]), pdf["comp"].to_numpy()
        self.low = self.x.astype(np.float32)
        cap = pdf["cap"].to_numpy(dtype="float64")
        self.wanted, self.cap = ~np.isnan(cap), np.nan_to_num(cap, nan=-FARTHEST)
        self.w = np.full((len(pdf), NEAR), np.inf)
        self.j = np.full((len(pdf), NEAR), LAST_ID)

    def look(self, rows: slice, other: _Nearest, cols: slice, s: np.ndarray, axis: int) -> None:
        """Takes the partners that may count from the float32 cosines ``s``: rows along ``axis`` 0, or along 1."""
        if not self.wanted[rows].any():
            return
        least = 1 - np.minimum(self.cap[rows], self.w[rows, -1])
        if (least <= 1 - FARTHEST).any() and s.shape[1 - axis] > NEAR:
            kth = np.partition(s, s.shape[1 - axis] - NEAR, axis=1 - axis).take(s.shape[1 - axis] - NEAR, axis=1 - axis)
            least = np.where(self.wanted[rows], np.maximum(least, kth), least)
        least = np.maximum(least, -2.0) - (self.x.shape[1] + 8) * 1.2e-7      # float32 errs by less
        r, c = np.divmod(np.flatnonzero(s >= np.expand_dims(least.astype(np.float32), 1 - axis)), s.shape[1])
        if axis:
            r, c = c, r
        r, c = r + rows.start, c + cols.start
        w = 1 - _dots(self.x, other.x, r, c)
        near = w <= self.cap[r]
        if near.any():
            self._add(r[near], other.ids[c[near]], w[near])

    def _add(self, r: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        rows, pos = np.unique(r, return_inverse=True)
        pos = np.concatenate([np.repeat(np.arange(len(rows)), NEAR), pos])
        w, j = np.concatenate([self.w[rows].ravel(), w]), np.concatenate([self.j[rows].ravel(), j])
        order = np.lexsort((j, w, pos))
        pos, w, j = pos[order], w[order], j[order]
        rank = np.arange(len(pos)) - np.searchsorted(pos, np.arange(len(rows)))[pos]
        kept = rank < NEAR
        self.w[rows[pos[kept]], rank[kept]] = w[kept]
        self.j[rows[pos[kept]], rank[kept]] = j[kept]

    def found(self) -> pd.DataFrame:
        r, k = np.nonzero(np.isfinite(self.w))
        return pd.DataFrame({"i": self.ids[r], "j": self.j[r, k], "w": self.w[r, k]})


def _near_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nearest partners in other components, of the wanted rows of both blocks of a pair."""
    pdf = pdf.assign(idle=pdf["cap"].isna()).sort_values(["idle", "id"], kind="stable")
    b1, b2 = int(pdf["b1"].iloc[0]), int(pdf["b2"].iloc[0])
    a = _Nearest(pdf[pdf["blk"] == b1])
    b = a if b1 == b2 else _Nearest(pdf[pdf["blk"] == b2])
    for i in range(0, len(a.ids), SPAN):
        for j in range(i if a is b else 0, len(b.ids), SPAN):
            ra, rb = slice(i, i + SPAN), slice(j, j + SPAN)
            if not (a.wanted[ra].any() or b.wanted[rb].any()):
                continue
            s = a.low[ra] @ b.low[rb].T
            if len(np.intersect1d(a.comp[ra], b.comp[rb])):
                s[a.comp[ra][:, None] == b.comp[rb][None, :]] = -9
            a.look(ra, b, rb, s, 0)
            if not (a is b and i == j):
                b.look(rb, a, ra, s, 1)
    return a.found() if a is b else pd.concat([a.found(), b.found()])


NEAR_SCHEMA = "i long, j long, w double"


def _search(rows: DataFrame, pairs: int) -> DataFrame:
    """The kernel once per pair of blocks; a number of partitions of its own, as small ones put together would run one after the other."""
    return rows.repartition(2 * max(pairs, 1), "b1", "b2").groupBy("b1", "b2").applyInPandas(_near_kernel, NEAR_SCHEMA)


def _search_blocks(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return _search(_of_pairs(rows, pairs), pairs.count())


def _nearest_of(found: DataFrame) -> DataFrame:
    """Per id its ``NEAR`` nearest partners, by (w, j): for one id the order of (w, u, v)."""
    listed = F.array_sort(F.collect_list(F.struct("w", "j")))
    return found.groupBy("i").agg(F.slice(listed, 1, NEAR).alias("near"))


def _lists(asked: DataFrame, found: DataFrame) -> DataFrame:
    """i, near, and up to which edge (w, u, v) all edges of i to other components are in near (null: all are).  ``asked``: i, cap."""
    last = F.element_at("near", -1)
    full = F.size("near") == NEAR
    beyond = F.struct(F.col("cap").alias("w"), F.lit(LAST_ID).alias("u"), F.lit(LAST_ID).alias("v"))
    bound = F.when(full, F.struct(last["w"].alias("w"), F.least("i", last["j"]).alias("u"), F.greatest("i", last["j"]).alias("v"))) \
        .when(F.col("cap") < FARTHEST, beyond)
    return asked.join(_nearest_of(found), "i", "left").select("i", "near", bound.alias("bound"))


def _search_all(blocks: Blocks) -> DataFrame:
    """Every vector's nearest others.  Far blocks are visited only where they may hold something nearer than a list of the own block."""
    rows = blocks.rows.select("id", "vec", "blk", F.col("id").alias("comp"))
    asked = rows.select(F.col("id").alias("i")).distinct().withColumn("cap", F.lit(FARTHEST))
    every = rows.withColumn("cap", F.lit(FARTHEST))
    if not blocks.measured:
        return _lists(asked, _search_blocks(every, blocks.pairs))
    own = cut_lineage(_search_blocks(every, blocks.pairs.filter("b1 = b2")))
    caps = _nearest_of(own).filter(F.size("near") == NEAR).select(F.col("i").alias("id"), F.element_at("near", -1)["w"].alias("cap"))
    capped = cut_lineage(rows.join(caps, "id", "left").withColumn("cap", F.coalesce("cap", F.lit(FARTHEST))))
    wide = capped.groupBy("blk").agg(F.max("cap").alias("cap"))
    open_pairs = (blocks.pairs.filter("b1 < b2").join(wide.select(F.col("blk").alias("b1"), F.col("cap").alias("cap1")), "b1")
                  .join(wide.select(F.col("blk").alias("b2"), F.col("cap").alias("cap2")), "b2")
                  .filter(1 - F.col("reach") <= F.greatest("cap1", "cap2") + SLACK).select("b1", "b2"))
    return _lists(asked, own.unionByName(_search_blocks(capped, cut_lineage(open_pairs))))


def _search_some(blocks: Blocks, comp: DataFrame, asked: DataFrame, tile: int) -> DataFrame:
    """The lists anew for the vectors of ``asked`` (i, cap): partners outside their component as it is now."""
    rows = blocks.rows.join(comp, "id")
    chunks = max(1, math.ceil(asked.count() / tile))
    query = rows.join(asked.withColumnRenamed("i", "id"), "id").withColumn("b1", (-1 - F.pmod(F.xxhash64("id"), F.lit(chunks))).cast("int"))

    def visit(query: DataFrame, pairs: DataFrame) -> DataFrame:
        first = query.withColumnRenamed("blk", "home").join(pairs.withColumnRenamed("b1", "home"), "home") \
            .filter(1 - F.col("reach") <= F.col("cap") + SLACK).select("id", "vec", F.col("b1").alias("blk"), "comp", "cap", "b1", "b2")
        second = rows.withColumn("cap", F.lit(None).cast("double")) \
            .join(first.select("b1", "b2", F.col("b2").alias("blk")).distinct(), "blk")
        return _search(first.unionByName(second), pairs.count() * chunks)

    both = blocks.pairs.select("b1", "b2", "reach")
    both = both.unionByName(both.filter("b1 < b2").select(F.col("b2").alias("b1"), F.col("b1").alias("b2"), "reach"))
    if not blocks.measured:
        return _lists(asked, visit(query, both))
    own = cut_lineage(visit(query, both.filter("b1 = b2")))
    best = own.join(comp.withColumnRenamed("id", "i"), "i").groupBy("comp").agg(F.min("w").alias("best"))
    query = query.join(best, "comp", "left").withColumn("cap", F.least("cap", "best")).drop("best")
    asked = query.groupBy(F.col("id").alias("i")).agg(F.first("cap").alias("cap"))
    return _lists(asked, own.unionByName(visit(query, both.filter("b1 <> b2"))))


def _edges_of(lists: DataFrame) -> DataFrame:
    return lists.select("i", F.explode("near").alias("e")).select(
        F.least("i", "e.j").alias("u"), F.greatest("i", "e.j").alias("v"), "e.w")


def cosine_mst(vecs: DataFrame, id_col: str, vec_col: str, tile: int = WIDE) -> DataFrame:
    """G9 on the complete cosine-distance graph without materialising it.

    Borůvka: a round takes components' cheapest edges to another one (distance 1 − cos, ties by
    (u, v)), and components merge by min-label propagation.  All pairs are met once, for every vector's
    ``NEAR`` nearest others.  A component's cheapest listed edge is its cheapest one if no list of its
    vectors ends before it; the others wait.  Where few are sure, the vectors whose lists ended are compared with
    all others again, for partners outside their component (the largest component, if unsure, is joined by the
    rest).  Each such search leaves at most half of the components.  O(n) state, no stored pair table.
    Equal vectors count as one; the others of an id hang on the smallest id.
    """
    x = F.col(vec_col)
    length = F.sqrt(F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda acc, v: acc + v * v))
    points = (vecs.select(F.col(id_col).cast("long").alias("id"), x.alias("vec"))
              .filter(F.col("id").isNotNull() & (length > 0) & (length < math.inf)).distinct())
    # an id with several vectors is one node: its vectors stay apart
    several = points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.col("id").alias("alone"))
    points = cut_lineage(points.join(several, "id", "left"))
    first = cut_lineage(points.groupBy("vec", "alone").agg(F.min("id").alias("id")))
    copies = points.filter("alone IS NULL").join(first.filter("alone IS NULL").select("vec", F.col("id").alias("u")), "vec") \
        .filter(F.col("id") > F.col("u")).select("u", F.col("id").alias("v"), F.lit(0.0).alias("w"))
    blocks = make_blocks(first, "id", "vec", tile)
    if blocks.measured:
        blocks = blocks._replace(pairs=cut_lineage(blocks.pairs))
    else:
        blocks = blocks._replace(rows=cut_lineage(blocks.rows))
    comp = blocks.rows.select("id", F.col("id").alias("comp")).distinct()
    lists = cut_lineage(_search_all(blocks))
    bounds, edges = lists.select(F.col("i").alias("id"), "bound"), _edges_of(lists)
    rounds = [copies]
    while True:
        cu, cv = (comp.select(F.col("id").alias(k), F.col("comp").alias(f"c{k}")) for k in "uv")
        edges = cut_lineage(edges.join(cu, "u").join(cv, "v").filter("cu <> cv").select("u", "v", "w", "cu", "cv"))
        cheapest = edges.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("w", "u", "v").alias("m")).groupBy("c").agg(F.min("m").alias("m"))
        held = comp.join(bounds, "id").groupBy(F.col("comp").alias("c")).agg(F.min("bound").alias("bound"), F.count(F.lit(1)).alias("n"))
        best = cut_lineage(held.join(cheapest, "c", "left").withColumn(
            "sure", F.col("m").isNotNull() & (F.col("bound").isNull() | (F.col("m") <= F.col("bound")))))
        edges = edges.select("u", "v", "w")
        of, sure, largest = best.agg(F.count(F.lit(1)), F.count_if("sure"), F.max(F.struct("n", "c"))["c"]).first()
        if of <= 1:
            break
        if sure * 8 >= of - 1:
            picked = best.filter("sure").select("c", "m.u", "m.v", "m.w")
            rounds.append(picked.select("u", "v", "w"))
            comp = cut_lineage(_merge_components(comp, picked))
            continue
        ended = (comp.join(bounds, "id").join(best.select(F.col("c").alias("comp"), "m"), "comp")
                 .filter((F.col("comp") != largest) & F.col("bound").isNotNull() & (F.col("m").isNull() | (F.col("m") > F.col("bound"))))
                 .select(F.col("id").alias("i"), F.coalesce("m.w", F.lit(FARTHEST)).alias("cap")))
        lists = cut_lineage(_search_some(blocks, comp, cut_lineage(ended), tile))
        fresh = lists.select(F.col("i").alias("id"), "bound")
        bounds = cut_lineage(bounds.join(fresh, "id", "left_anti").unionByName(fresh))
        edges = edges.unionByName(_edges_of(lists))
    mst = rounds[0]
    for r in rounds[1:]:
        mst = mst.unionByName(r)
    return mst.distinct()


def _merge_components(comp: DataFrame, picked: DataFrame) -> DataFrame:
    """Borůvka contraction: every component points to the component across its
    picked edge; a mutual pair keeps the smaller label as root; pointer
    jumping (parent := parent(parent)) reaches the roots in O(log n) rounds."""
    cu = comp.select(F.col("id").alias("u"), F.col("comp").alias("cu"))
    cv = comp.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    e = picked.join(cu, "u").join(cv, "v")
    # component c picked edge (u, v): its parent is the component on the far end
    parent = e.select("c", F.when(F.col("cu") == F.col("c"), F.col("cv")).otherwise(F.col("cu")).alias("p"))
    # mutual picks (c → p and p → c) are 2-cycles: the smaller label becomes the root
    mutual = parent.join(parent.select(F.col("p").alias("c"), F.col("c").alias("p")), ["c", "p"], "left_semi")
    roots = mutual.filter(F.col("c") < F.col("p")).select("c", F.lit(True).alias("root"))
    parent = (parent.join(roots, "c", "left")
                    .select("c", F.when(F.col("root"), F.col("c")).otherwise(F.col("p")).alias("p")))
    parent = cut_lineage(parent)
    while True:
        # four steps up before a table is written
        nxt = parent.select("c", F.col("p").alias("p2"), "p")
        for _ in range(3):
            up = parent.select(F.col("c").alias("p2"), F.col("p").alias("pp"))
            nxt = nxt.join(up, "p2", "left").select("c", F.coalesce("pp", "p2").alias("p2"), "p")
        nxt = cut_lineage(nxt)
        if nxt.filter(F.col("p2") != F.col("p")).isEmpty():
            break
        parent = nxt.select("c", F.col("p2").alias("p"))
    return (comp.join(parent.select(F.col("c").alias("comp"), F.col("p").alias("root")), "comp", "left")
                .select("id", F.coalesce("root", "comp").alias("comp")))

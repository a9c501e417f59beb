"""Operator 6: near-duplicate documents by SetSketch registers.

A document's set holds its distinct 5-word shingles (fewer words: the whole
sequence).  A SetSketch keeps, per register, the exponentially spaced level
K = floor(1 - log_b(x)) of the smallest exponential variate x over the set, truncated to
[0, q + 1].  Registers merge by maximum and agree for two sets with probability of
about their Jaccard similarity.

1. Equal sets (128-bit digest) are reduced to their smallest id.
2. Bands of registers are hashed; sets that share a band hang under the band's
   smallest id, and connected components of these stars are candidate clusters.
   Every pair that shares a band is in one cluster, and no pair is listed.
3. Clusters are cut into tiles of at most ``TILE`` sets.  Per pair of tiles, one task
   estimates Jaccard jointly from both sketches and both sizes by maximum
   likelihood, and verifies the pairs that the estimate cannot rule out on the
   full shingle sets; it returns a spanning forest of the links, not the links.
4. Components of the forests give component_id.

With 20 bands of 4 registers a pair at the threshold 0.85 shares no band with probability
(1 - 0.85**4)**20 = 4e-7; the likelihood cut lies eight standard deviations below the threshold.

Cases: a null text, or one without words, has an empty set and is linked with
nothing; ties go to the smallest id; repeated rows are equal sets, and different sets
under one id are nodes of their own: where they meet in one component, the first by digest is kept; rows with a null id are returned alone with a null component; an empty table gives no rows; extra
columns do not matter, the result holds ``key`` and the columns it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .blocks import WINDOW_BASE, find_words, mix, signed, span_hashes, text_slices, windows
from .components import components
from .native import hash_ranks
from .registry import query

SHINGLE = 5
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
TILE = 512
THRESHOLD = (85, 100)

_ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, first index per row) of a slice of texts."""
    w = find_words(data, offs, lower=True)
    h = w.hashes()
    at, row = windows(w, k)
    sh = span_hashes(h, at, at + k, WINDOW_BASE)
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    sh = np.concatenate([sh, span_hashes(h, w.first[few], w.first[few + 1], WINDOW_BASE)])
    row = np.concatenate([row, few])
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    sh, row = sh[new], row[new]
    return sh, np.searchsorted(row, np.arange(len(offs)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of one non-empty set of hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[a:a + 4096, None] * _ODD + _ADD).min(axis=0))
    # the smallest of exponential variates is the variate of the smallest draw
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.clip(level, 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _slope(jac: np.ndarray, u: np.ndarray, up: np.ndarray, down: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Derivative of the joint log-likelihood; it falls in the similarity."""
    v = 1.0 - u
    c = (BASE - 1.0) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * c) / np.log(BASE)

    def dp(x: np.ndarray) -> np.ndarray:
        return c / (1.0 - np.clip(x, 0.0, 1.0) * c) / np.log(BASE)
    a, b = np.maximum(u - v * jac, 1e-12), np.maximum(v - u * jac, 1e-12)
    pa_, pb = np.maximum(p(a), 1e-12), np.maximum(p(b), 1e-12)
    rest = np.maximum(1.0 - pa_ - pb, 1e-12)
    return -up * dp(a) * v / pa_ - down * dp(b) * u / pb + same * (dp(a) * v + dp(b) * u) / rest


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard of pairs (rows) from registers and set sizes, by bisection."""
    up, down = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - up - down
    u = na / (na + nb)
    lo, hi = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):
        mid = (lo + hi) / 2
        rising = _slope(mid, u, up, down, same) > 0
        lo, hi = np.where(rising, mid, lo), np.where(rising, hi, mid)
    return (lo + hi) / 2


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text hash, n_shingles, digest of the set, band hashes); no bands for an empty set."""
    for batch in batches:
        for a, b, data, offs in text_slices(batch.column("_t")):
            sh, first = shingle_sets(data, offs)
            n = np.diff(first)
            full = np.flatnonzero(n)
            d1, d2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            bands = [None] * (b - a)
            if len(full):
                # sums of avalanched hashes do not depend on the order
                d1[full] = np.add.reduceat(mix(sh), first[full])
                d2[full] = np.add.reduceat(mix(sh ^ np.uint64(WINDOW_BASE)), first[full])
                reg = np.stack([registers(sh[first[k]:first[k + 1]]) for k in full]).astype(np.uint64) + np.uint64(1)
                lo = np.arange(len(full) * BANDS) * ROWS
                hashed = signed(span_hashes(reg.ravel(), lo, lo + ROWS, WINDOW_BASE)).reshape(-1, BANDS)
                for k, x in zip(full, hashed):
                    bands[k] = x
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").slice(a, b - a), batch.column("_x").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(signed(d1)),
                 pa.array(signed(d2)), pa.array(bands, pa.list_(pa.int64()))],
                names=["_id", "_x", "n_shingles", "d1", "d2", "bands"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def links(sets: list[np.ndarray], regs: np.ndarray, num: int, den: int,
          split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * |a & b| >= num * |a | b|.

    With ``split``, only pairs across that index are compared (two tiles).  A row is
    verified against all earlier ones at once, through the postings of its shingles,
    unless its plausible partners are all connected to it already."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    t = num / den
    cut = max(0.0, t - 8.0 * np.sqrt(t * (1 - t) / regs.shape[1]))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], owner[order]
    forest, out = _Forest(m), []
    for i in range(1 if split is None else split, m):
        top = i if split is None else split
        small, large = np.minimum(size[:top], size[i]), np.maximum(size[:top], size[i])
        fits = np.flatnonzero(den * small >= num * large)
        if not len(fits):
            continue
        r = regs[fits]
        up, down = (r > regs[i]).sum(axis=1), (r < regs[i]).sum(axis=1)
        u = size[fits] / (size[fits] + size[i])
        # the likelihood is concave, so its slope at the cut tells on which side the estimate lies
        fits = fits[_slope(np.full(len(u), cut), u, up, down, regs.shape[1] - up - down) >= 0]
        mine = forest.root(i)
        fits = np.array([j for j in fits if forest.root(j) != mine], dtype=np.int64)
        if not len(fits):
            continue
        lo, hi = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=m)[fits]
        for j in fits[den * both >= num * (size[fits] + size[i] - both)]:
            a, b = forest.root(int(j)), forest.root(i)
            if a != b:
                forest.up[a] = b
                out.append((int(j), i))
    return out


def _tile_links(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (cluster, tile pair, side): the links of each tile pair."""
        part, ids, side, sets, regs = None, [], [], [], []

        def done() -> pa.RecordBatch | None:
            if len(ids) < 2:
                return None
            split = side.index(1) if part[1] != part[2] and 1 in side else None
            if part[1] != part[2] and (split in (None, 0)):
                return None
            found = links(sets, np.stack(regs), num, den, split)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())],
                names=["a", "b"])
        for batch in batches:
            key = [batch.column(c).to_pylist() for c in ("cluster", "ti", "tj", "side", "_id")]
            for a, b, data, offs in text_slices(batch.column("_t")):
                sh, first = shingle_sets(data, offs)
                for k in range(b - a):
                    here = (key[0][a + k], key[1][a + k], key[2][a + k])
                    if here != part:
                        if part is not None and (r := done()) is not None:
                            yield r
                        part, ids, side, sets, regs = here, [], [], [], []
                    ids.append(key[4][a + k])
                    side.append(key[3][a + k])
                    sets.append(sh[first[k]:first[k + 1]].copy())
                    regs.append(registers(sets[-1]))
        if part is not None and (r := done()) is not None:
            yield r
    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    threshold: tuple[int, int] = THRESHOLD, tile: int = TILE, text_hash: str | None = None) -> DataFrame:
    """(key, n_shingles, component_id, kept): the smallest id of a component is kept.

    With ``text_hash``, a column of that name holds xxhash64 of the row's text."""
    source = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"), F.xxhash64(text).alias("_x"))
    sketched = cut_lineage(source.mapInArrow(
        _sketch_rows, "_id long, _x long, n_shingles long, d1 long, d2 long, bands array<long>"))
    full = sketched.filter("n_shingles > 0 and _id is not null")
    # a set is a node, numbered once written; the row that stands for it is its smallest (id, text hash)
    sets = cut_lineage(full.groupBy("n_shingles", "d1", "d2").agg(
        F.min(F.struct("_id", "_x")).alias("_rep"), F.first("bands").alias("bands"))
        .select("n_shingles", "d1", "d2", F.col("_rep._id").alias("rep"), F.col("_rep._x").alias("rep_x"), "bands",
                F.monotonically_increasing_id().alias("node")))
    banded = sets.select("node", F.posexplode("bands").alias("band", "value"))
    heads = cut_lineage(banded.groupBy("band", "value").agg(F.min("node").alias("a"), F.max("node").alias("_z"))
                        .filter("a < _z").drop("_z"))
    stars = cut_lineage(banded.join(heads, ["band", "value"]).filter("a < node")
                        .select("a", F.col("node").alias("b")).distinct())
    member = cut_lineage(components(stars).select(F.col("node").alias("_m"), F.col("label").alias("cluster")))
    placed = hash_ranks(member, ["cluster"], ["_m"], "rank", member.count(), per_bucket=tile) \
        .select("_m", "cluster", F.floor(F.col("rank") / tile).cast("int").alias("tile"))
    placed = cut_lineage(placed)
    tiles = placed.groupBy("cluster").agg(F.max("tile").alias("_last"))
    pairs = placed.join(tiles, "cluster").select(
        "_m", "cluster", "tile", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("other"))
    pairs = pairs.select("_m", "cluster", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"),
                         (F.col("tile") > F.col("other")).cast("int").alias("side"))
    shown = placed.select("_m").join(sets.select(F.col("node").alias("_m"), "rep", "rep_x"), "_m")
    texts = (source.join(shown, (F.col("_id") == F.col("rep")) & (F.col("_x") == F.col("rep_x")))
             .groupBy(F.col("_m").alias("_id")).agg(F.min("_t").alias("_t")))
    tiled = (texts.join(pairs, F.col("_id") == F.col("_m")).select("cluster", "ti", "tj", "side", "_id", "_t")
             .repartition("cluster", "ti", "tj").sortWithinPartitions("cluster", "ti", "tj", "side", "_id"))
    found = cut_lineage(tiled.mapInArrow(_tile_links(*threshold), "a long, b long"))
    linked = cut_lineage(components(found))
    grouped = cut_lineage(sets.select("n_shingles", "d1", "d2", "rep", "node").join(linked, "node"))
    first = (grouped.groupBy("label").agg(F.min(F.struct("rep", "d1", "d2", "n_shingles", "node")).alias("_first"))
             .select("label", F.col("_first.rep").alias("component_id"), F.col("_first.node").alias("_least")))
    member_of = grouped.join(first, "label").select("node", "component_id", (F.col("node") == F.col("_least")).alias("_lead"))
    labelled = cut_lineage(sets.select("n_shingles", "d1", "d2", "rep", "node").join(member_of, "node", "left")
                           .select("n_shingles", "d1", "d2", F.coalesce("component_id", "rep").alias("component_id"),
                                   F.coalesce("_lead", F.lit(True)).alias("_lead")))
    out = sketched.join(labelled, ["n_shingles", "d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("_id"))
    component = F.when(F.col("_id").isNotNull(), component)
    kept = F.col("_id").isNull() | ((F.col("_id") == F.col("_c")) & F.coalesce("_lead", F.lit(True)))
    return (out.withColumn("_c", component)
            .select(F.col("_id").alias(key), "n_shingles", F.col("_c").alias("component_id"), kept.alias("kept"),
                    *([F.col("_x").alias(text_hash)] if text_hash else [])))


@query("op6_setsketch_near_dedup", oracle=rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id
          GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
         WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
""")
def op6_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

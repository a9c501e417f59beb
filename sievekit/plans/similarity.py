"""Pairwise similarity at scale: dense vectors, token sets, representation
registry, correlation, summaries, density curves, chains and MSTs.

Dense stand-in: ``embeddings`` (64-d float vectors).  Set stand-ins:
``documents`` as distinct lower-case word 3-grams (binary) and word counts
(counted).  Representation stand-in for the known-distance pairs: each part's
text ``lower(p_name ‖ p_type ‖ p_brand)`` → a 1024-bit char-3-gram
fingerprint, a 64-bucket char-2-gram count vector, and the count vector
concatenated with two numeric columns (dense).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import words
from ..operators import allpairs, graph, joins, minhash, quantiles, ranking, setsim
from ..sources import table
from .graph import LT, OP, molecules
from .registry import query

EMB = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
COS = ("list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * "
       "sqrt(list_dot_product(b.v, b.v)), 0)")
GRAMS = r"""g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1),
                 lambda i: array_to_string(w[i:i+2], ' ')))) AS gram
       FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS w
             FROM documents)),
gs AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)"""
MEASURES = ["binary_tanimoto", "counted_tanimoto", "cosine"]


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


@query("cosine_pairs", oracle=f"""
WITH {EMB}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, {COS} AS c FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT i, j, round(c, 6) AS cosine, round(1 - c, 6) AS distance FROM p WHERE c >= 0.3
""")
def cosine_pairs(spark, sf_dir):
    """J9 + F1 + F14 + F5: all vector pairs with cosine ≥ 0.3, blocked tiles."""
    p = allpairs.cosine_pairs_above(embeddings(spark, sf_dir), "vec_id", "embedding", 0.3)
    return p.select("i", "j", F.col("sim").alias("cosine"), S.distance("sim").alias("distance"))


@query("nearest_neighbor", oracle=f"""
WITH {EMB}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, {COS} AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT i AS vec_id, j AS nn_id, round(c, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS rn FROM p WHERE c IS NOT NULL) WHERE rn = 1
""")
def nearest_neighbor(spark, sf_dir):
    """Each vector's most similar other vector (ties → smallest id)."""
    return allpairs.nearest_neighbours(embeddings(spark, sf_dir), "vec_id", "embedding")


@query("similarity_chain", oracle=f"""
WITH {EMB}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, {COS} AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
rs AS (SELECT i, sum(c) AS s FROM p GROUP BY i),
st AS (SELECT i FROM rs ORDER BY s, i LIMIT 1)
SELECT row_number() OVER (ORDER BY c DESC, j) AS pos, j AS vec_id, round(c, 6) AS sim
FROM p WHERE i = (SELECT i FROM st)
""")
def similarity_chain(spark, sf_dir):
    """Start at the vector with the lowest similarity row sum; order every
    other vector by similarity to it (ties → id).  Row sums come from the sum
    vector; positions are taken over range partitions."""
    from ..operators.ranking import global_position
    emb = embeddings(spark, sf_dir)
    rs = allpairs.similarity_row_sums(emb, "vec_id", "embedding")
    start = rs.orderBy(F.asc_nulls_last("row_sum"), "vec_id").limit(1).select("vec_id")
    # the start vector is one row: bring it to the driver as a literal array
    row = emb.join(start, "vec_id", "left_semi").first()
    start_vec = F.array(*[F.lit(float(x)) for x in row["embedding"]])
    c = (emb.filter(F.col("vec_id") != row["vec_id"])
            .select("vec_id", S.cosine("embedding", start_vec).alias("sim")).filter(F.col("sim").isNotNull()))
    return global_position(c, [F.desc("sim"), F.asc("vec_id")]).select("pos", "vec_id", "sim")


@query("mst_distance")
def mst_distance(spark, sf_dir):
    """Minimum spanning tree of the complete cosine-distance graph over all
    vectors, by Borůvka rounds over blocked tiles (no stored pair table)."""
    return allpairs.cosine_mst(embeddings(spark, sf_dir), "vec_id", "embedding")


def doc_grams(spark, sf_dir):
    """Distinct word 3-grams per document.  The word split is its own
    projection: Catalyst keeps a non-cheap expression that is referenced
    several times in a separate Project instead of re-evaluating it."""
    from ..functions.text import kgrams
    w = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w"))
    return w.select("doc_id", F.array_distinct(kgrams("w", 3)).alias("grams"))


@query("binary_tanimoto_pairs", oracle=f"""
WITH {GRAMS},
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
       GROUP BY 1, 2)
SELECT a AS doc_a, b AS doc_b, inter, round(inter / (sa.n + sb.n - inter), 6) AS sim
FROM sh JOIN gs sa ON sa.doc_id = a JOIN gs sb ON sb.doc_id = b
WHERE inter / (sa.n + sb.n - inter) >= 0.5
""")
def binary_tanimoto_pairs(spark, sf_dir):
    """F3 + X1: document pairs with 3-gram-set Tanimoto ≥ 0.5 (exact prefix-filter join)."""
    p = setsim.prefix_join(doc_grams(spark, sf_dir), None, "doc_id", "grams", 0.5)
    return p.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"),
                    F.col("inter").cast("long").alias("inter"), "sim")


@query("counted_tanimoto_pairs", oracle=r"""
WITH wc AS (SELECT doc_id, w, count(*) AS c FROM (
              SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS w
              FROM documents) GROUP BY ALL),
tot AS (SELECT doc_id, sum(c) AS n FROM wc GROUP BY 1),
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS mn FROM wc a JOIN wc b ON a.w = b.w AND a.doc_id < b.doc_id
       GROUP BY 1, 2)
SELECT a AS doc_a, b AS doc_b, round(mn / (ta.n + tb.n - mn), 6) AS sim
FROM sh JOIN tot ta ON ta.doc_id = a JOIN tot tb ON tb.doc_id = b
WHERE mn / (ta.n + tb.n - mn) >= 0.5
""")
def counted_tanimoto_pairs(spark, sf_dir):
    """F2 + X2: document pairs with word-count Tanimoto Σmin/Σmax ≥ 0.5.

    Exact via the multiset expansion (word#k) and the same prefix-filter join."""
    d = table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w"))
    ex = setsim.expand_counts(d, "doc_id", "w", "tokens")
    p = setsim.prefix_join(ex, None, "doc_id", "tokens", 0.5)
    return p.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"), "sim")


@query("decontaminate_similar", oracle=f"""
WITH {GRAMS},
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.gram = b.gram
       WHERE a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY 1, 2),
s AS (SELECT a, b, inter / (sa.n + sb.n - inter) AS sim FROM sh JOIN gs sa ON sa.doc_id = a JOIN gs sb ON sb.doc_id = b),
best AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s
                               WHERE sim > 0.6) WHERE rn = 1)
SELECT d.doc_id, best.b IS NOT NULL AS dropped, best.b AS best_match, round(best.sim, 6) AS best_sim
FROM documents d LEFT JOIN best ON best.a = d.doc_id WHERE d.doc_id % 2 = 1
""")
def decontaminate_similar(spark, sf_dir):
    """J10 + W7 + X1 + F3: odd-half documents whose 3-gram Tanimoto to some
    even-half document exceeds 0.6 are dropped; the best such match is kept."""
    g = doc_grams(spark, sf_dir)
    odd, even = g.filter(F.col("doc_id") % 2 == 1), g.filter(F.col("doc_id") % 2 == 0)
    best = setsim.matched_any(odd, even, "doc_id", "grams", 0.6, strict=True)
    return (odd.select("doc_id").join(best, "doc_id", "left")
               .select("doc_id", F.col("best_id").isNotNull().alias("dropped"),
                       F.col("best_id").alias("best_match"), "best_sim"))


# ---- representation registry over the known-distance pairs (X10) ---------

PFEAT = r"""pt AS (SELECT 'P' || p_partkey AS key, lower(concat_ws(' ', p_name, p_type, p_brand)) AS s,
               p_size, p_retailprice FROM part),
f AS (SELECT key,
  list_sort(list_distinct(list_transform(range(1, length(s) - 1),
      lambda i: ((('0x' || substr(md5(substr(s, i, 3)), 1, 8))::BIGINT) % 1024)::INTEGER))) AS bits,
  list_transform(range(0, 64), lambda k: len(list_filter(list_transform(range(1, length(s)),
      lambda i: ((('0x' || substr(md5(substr(s, i, 2)), 1, 8))::BIGINT) % 64)::INTEGER), lambda b: b = k))) AS counts,
  p_size, p_retailprice FROM pt),
fx AS (SELECT key, bits, counts, list_concat(counts::DOUBLE[], [p_size::DOUBLE, p_retailprice / 100]) AS dense FROM f),
sa AS (SELECT op.*,
  CASE WHEN len(list_distinct(list_concat(f1.bits, f2.bits))) = 0 THEN 0.0
       ELSE len(list_intersect(f1.bits, f2.bits)) / len(list_distinct(list_concat(f1.bits, f2.bits))) END AS binary_tanimoto,
  list_sum(list_transform(range(1, 65), lambda i: least(f1.counts[i], f2.counts[i])))
    / nullif(list_sum(list_transform(range(1, 65), lambda i: greatest(f1.counts[i], f2.counts[i]))), 0) AS counted_tanimoto,
  list_dot_product(f1.dense, f2.dense) / nullif(sqrt(list_dot_product(f1.dense, f1.dense))
    * sqrt(list_dot_product(f2.dense, f2.dense)), 0) AS cosine
  FROM op JOIN fx f1 ON f1.key = op.mol1 JOIN fx f2 ON f2.key = op.mol2)"""

SIM_ALL = f"WITH {LT}, {OP}, {PFEAT}"
LONG = """lg AS (SELECT separation, 'binary_tanimoto' AS measure, binary_tanimoto AS x FROM sa
       UNION ALL SELECT separation, 'counted_tanimoto', counted_tanimoto FROM sa
       UNION ALL SELECT separation, 'cosine', cosine FROM sa)"""


def part_features(spark, sf_dir):
    """One select applying every registered encoder (bits, counts, dense)."""
    pa = table(spark, sf_dir, "part")
    s = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return pa.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key"),
                     S.ENCODERS["bits1024"](s).alias("bits1024"),
                     S.ENCODERS["counts64"](s).alias("counts64"),
                     F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("numbers"))


def similarity_table(spark, sf_dir):
    """The lines take their part's features, once, and the pairs get them from the lines: no pair is
    shuffled.  The features of a part are many times the size that Spark estimates for arrays, so their join
    is a merge join, never a broadcast, and they travel packed.  A part's key may repeat, hence lists; ``combined``
    is put together per pair."""
    feats = part_features(spark, sf_dir).withColumns({"bits1024": F.col("bits1024").cast("array<smallint>"),
                                                      "counts64": S.packed_counts("counts64")})
    feats = feats.groupBy("key").agg(F.collect_list(F.struct("bits1024", "counts64", "numbers")).alias("f"))
    lines = joins.role_join(molecules(spark, sf_dir), feats.hint("merge"), "key", {"mol": ""}, ["f"])
    pairs = ranking.offset_pairs(lines, "l_orderkey", "pos", "mol", 6, carry=("f",))
    pairs = pairs.withColumn("separation", F.col("separation").cast("string"))
    for s in ("_1", "_2"):
        pairs = (pairs.withColumn("__f", F.explode_outer("f" + s)).drop("f" + s)
                      .withColumns({"bits1024" + s: F.col("__f.bits1024"), "counts64" + s: S.unpacked_counts("__f.counts64"),
                                    "numbers" + s: F.col("__f.numbers")}).drop("__f")
                      .withColumn("combined" + s, S.concat_features("counts64" + s, "numbers" + s)).drop("numbers" + s))
    cols = []
    for m in MEASURES:
        rep, fn = S.metric(m)
        cols.append(fn(f"{rep}_1", f"{rep}_2").alias(m))
    return pairs.select("l_orderkey", "mol1", "mol2", "separation", *cols)


@query("similarity_all", oracle=f"""
{SIM_ALL}
SELECT l_orderkey, mol1, mol2, separation, round(binary_tanimoto, 6) AS binary_tanimoto,
       round(counted_tanimoto, 6) AS counted_tanimoto, round(cosine, 6) AS cosine FROM sa
""")
def similarity_all(spark, sf_dir):
    """F4 + X10 + X4 + F12 + F13: three representations' similarity per known-distance pair."""
    return similarity_table(spark, sf_dir)


@query("similarity_corr", oracle=f"""
{SIM_ALL}
SELECT 'binary_tanimoto' AS a, 'counted_tanimoto' AS b, round(corr(binary_tanimoto, counted_tanimoto), 6) AS corr FROM sa
UNION ALL SELECT 'binary_tanimoto', 'cosine', round(corr(binary_tanimoto, cosine), 6) FROM sa
UNION ALL SELECT 'counted_tanimoto', 'cosine', round(corr(counted_tanimoto, cosine), 6) FROM sa
""")
def similarity_corr(spark, sf_dir):
    """Pairwise-complete Pearson correlation of every pair of measures (one pass)."""
    t = similarity_table(spark, sf_dir)
    combos = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]]
    row = t.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in combos])
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in combos]))
        .alias("r"))
    return stacked.select("r.*")


def long_measures(spark, sf_dir):
    """(separation, measure, x) written once to the shared folder: the summary
    and density plans read it from several branches."""
    from ..session import cut_lineage
    t = similarity_table(spark, sf_dir)
    return cut_lineage(t.unpivot(["separation"], MEASURES, "measure", "x"))


@query("similarity_summary", oracle=f"""
{SIM_ALL}, {LONG}
SELECT separation, measure, count(*) AS n, round(min(coalesce(x, 0)), 6) AS min,
       round(quantile_cont(coalesce(x, 0), 0.5), 6) AS median, round(max(coalesce(x, 0)), 6) AS max
FROM lg GROUP BY ALL
""")
def similarity_summary(spark, sf_dir):
    """A10 + A12 + F13: rows per separation and min / exact median / max per
    measure (undefined → 0); the median uses the bucketed exact quantile."""
    lg = long_measures(spark, sf_dir).withColumn("x", S.nan_to_zero("x"))
    base = lg.groupBy("separation", "measure").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"),
                                                   F.max("x").alias("max"))
    med = quantiles.exact_quantiles(lg, ["separation", "measure"], "x", {"median": 0.5})
    return base.join(med, ["separation", "measure"]).select("separation", "measure", "n", "min", "median", "max")


GRID = 200


@query("similarity_density", oracle=f"""
{SIM_ALL}, {LONG},
v AS (SELECT * FROM lg WHERE x IS NOT NULL),
st AS (SELECT separation, measure, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h,
              min(x) AS lo, max(x) AS hi FROM v GROUP BY ALL),
grid AS (SELECT st.*, k, (lo - 3 * h) + k * ((hi + 3 * h) - (lo - 3 * h)) / {GRID - 1} AS gx
         FROM st CROSS JOIN range(0, {GRID}) t(k))
SELECT grid.separation, grid.measure, k, round(gx, 6) AS x,
       round(sum(exp(-0.5 * pow((gx - v.x) / nullif(h, 0), 2))) / (n * nullif(h, 0) * sqrt(2 * pi())), 6) AS density
FROM grid JOIN v ON v.separation = grid.separation AND v.measure = grid.measure
GROUP BY grid.separation, grid.measure, k, gx, n, h
""")
def similarity_density(spark, sf_dir):
    """200-point Gaussian KDE per (separation, measure), Scott bandwidth,
    grid [min − 3h, max + 3h].  One Arrow pass adds every value's kernel to a
    vector of 200 per group, so a task hands on 200 sums per group and no row is
    multiplied; the groups' grids (one row per group) travel with the kernel."""
    lg = long_measures(spark, sf_dir).filter(F.col("x").isNotNull())
    grp = ["separation", "measure"]
    st = lg.groupBy(*grp).agg(F.count(F.lit(1)).alias("n"),
                              (F.stddev_samp("x") * F.pow(F.count(F.lit(1)), -0.2)).alias("h"),
                              F.min("x").alias("lo"), F.max("x").alias("hi"))
    st = st.withColumns({"lo": F.col("lo") - 3 * F.col("h"), "hi": F.col("hi") + 3 * F.col("h")})
    grids = {(r.separation, r.measure): (r.lo, r.hi, r.h) for r in st.collect()}      # 6 separations x 3 measures

    def kernel(batches):
        sums = {}
        for pdf in batches:
            for key, part in pdf.groupby(grp):
                lo, hi, h = grids[key]
                if not h:                          # a constant group or a single value has no bandwidth
                    continue
                gx = lo + np.arange(GRID) * (hi - lo) / (GRID - 1)
                for x in np.array_split(part["x"].to_numpy(), len(part) // 4096 + 1):
                    z = (gx[:, None] - x[None, :]) / h
                    sums[key] = sums.get(key, 0.0) + np.exp(-0.5 * z * z).sum(axis=1)
        for (sep, measure), s in sums.items():
            yield pd.DataFrame({"separation": sep, "measure": measure, "k": np.arange(GRID), "s": s})

    sums = (lg.mapInPandas(kernel, "separation string, measure string, k long, s double")
              .groupBy(*grp, "k").agg(F.sum("s").alias("s")))
    h = F.nullif(F.col("h"), F.lit(0.0))
    grid = st.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID - 1).cast("long"))))
    gx = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (GRID - 1)
    return grid.join(sums, [*grp, "k"], "left").select(
        *grp, "k", gx.alias("x"), (F.col("s") / (F.col("n") * h * math.sqrt(2 * math.pi))).alias("density"))


@query("similarity_study", oracle=f"""
{SIM_ALL},
e AS (SELECT 'binary_tanimoto' AS u, 'counted_tanimoto' AS v, 1 - corr(binary_tanimoto, counted_tanimoto) AS w FROM sa
      UNION ALL SELECT 'binary_tanimoto', 'cosine', 1 - corr(binary_tanimoto, cosine) FROM sa
      UNION ALL SELECT 'cosine', 'counted_tanimoto', 1 - corr(counted_tanimoto, cosine) FROM sa),   -- u < v
r AS (SELECT *, row_number() OVER (ORDER BY w, u, v) AS k FROM e)
SELECT u, v, round(w, 6) AS w FROM r WHERE k <= 2   -- a triangle loses its longest edge
""")
def similarity_study(spark, sf_dir):
    """X11 + G9: featurise → all pairs → correlate the measures → MST over
    1 − corr (edges between representations)."""
    from ..session import cut_lineage
    c = cut_lineage(similarity_corr(spark, sf_dir))
    t = graph.boruvka_mst(c.select(F.col("a").alias("u"), F.col("b").alias("v"), (1 - F.col("corr")).alias("w")))
    return t.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")


@query("minhash_pairs", oracle=f"""
WITH {GRAMS},
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
       GROUP BY 1, 2)
SELECT a AS doc_a, b AS doc_b, round(1 - inter / (sa.n + sb.n - inter), 6) AS jaccard_distance
FROM sh JOIN gs sa ON sa.doc_id = a JOIN gs sb ON sb.doc_id = b
WHERE 10 * inter >= 6 * (sa.n + sb.n - inter)
""")
def minhash_pairs(spark, sf_dir):
    """Near-duplicates (word 3-gram sets, Jaccard distance at most 0.4), all of them: the
    exact prefix-filter join at 0.6 in place of bands of minima.  Sets without a gram meet nothing."""
    g = doc_grams(spark, sf_dir)
    p = setsim.prefix_join(g, None, "doc_id", "grams", 0.6)
    return p.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"),
                    (1 - F.col("sim")).alias("jaccard_distance"))


# every gram's values under all permutations, and their least per document
REGISTERS = f"""hs AS (SELECT doc_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT AS h FROM g),
mn AS (SELECT doc_id, count(*) AS n_grams, [{", ".join(
    f"min((h * {a} + {b}) % {minhash.P})" for a, b in minhash.permutations())}] AS r FROM hs GROUP BY doc_id)"""


@query("minhash_fingerprint", oracle=f"""
WITH {GRAMS}, {REGISTERS}
SELECT doc_id, n_grams, array_to_string(r, ' ') AS registers FROM mn
""")
def minhash_fingerprint(spark, sf_dir):
    """64 registers of permutation minima per document (distinct word 3-grams)."""
    f = minhash.fingerprints(doc_grams(spark, sf_dir), "doc_id", "grams")
    return f.select("doc_id", F.col("n_tokens").alias("n_grams"),
                    F.array_join(F.transform("registers", lambda x: x.cast("string")), " ").alias("registers"))


@query("minhash_merged", oracle=f"""
WITH {GRAMS}, {REGISTERS},
m AS (SELECT lang, k, min(r[k]) AS v FROM mn JOIN documents USING (doc_id), range(1, {minhash.K + 1}) t(k)
      WHERE lang IS NOT NULL GROUP BY ALL),
f AS (SELECT lang, list(v ORDER BY k) AS r FROM m GROUP BY lang)
SELECT lang, array_to_string(r, ' ') AS registers,
       round(len(list_filter(list_zip(r, (SELECT list(v ORDER BY k) FROM (SELECT k, min(v) AS v FROM m GROUP BY k))),
                 lambda z: z[1] = z[2])) / {minhash.K}, 6) AS share_of_all
FROM f
""")
def minhash_merged(spark, sf_dir):
    """The documents' registers merged per language, and each language's estimated similarity to the
    union of all: its share of the corpus' distinct grams."""
    from ..session import cut_lineage
    f = minhash.fingerprints(doc_grams(spark, sf_dir), "doc_id", "grams").select("doc_id", "registers")
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang").filter(F.col("lang").isNotNull())
    merged = minhash.merge(f.join(langs, "doc_id"), "lang")
    merged = cut_lineage(merged)                                # a row per language, read twice
    whole = minhash.merge(merged.withColumn("__all", F.lit(0)), "__all").select(F.col("registers").alias("whole"))
    return merged.crossJoin(whole).select(
        "lang", F.array_join(F.transform("registers", lambda x: x.cast("string")), " ").alias("registers"),
        minhash.similarity(F.col("registers"), F.col("whole")).alias("share_of_all"))


@query("max_cross_similarity", oracle=f"""
WITH {GRAMS},
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.gram = b.gram
       WHERE a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY 1, 2),
s AS (SELECT a, b, inter / (sa.n + sb.n - inter) AS sim FROM sh JOIN gs sa ON sa.doc_id = a JOIN gs sb ON sb.doc_id = b),
k AS (SELECT * FROM s WHERE a NOT IN (SELECT a FROM s WHERE sim > 0.6))
SELECT 'before' AS corpus, round(sim, 6) AS sim, a AS doc_a, b AS doc_b FROM (SELECT * FROM s ORDER BY sim DESC, a, b LIMIT 1)
UNION ALL
SELECT 'after', round(sim, 6), a, b FROM (SELECT * FROM k ORDER BY sim DESC, a, b LIMIT 1)
""")
def max_cross_similarity(spark, sf_dir):
    """The greatest similarity between the odd and the even half, before and after the documents above
    0.6 are dropped."""
    from ..session import cut_lineage
    g = doc_grams(spark, sf_dir)                                # sets without a gram meet nothing
    odd, even = g.filter(F.col("doc_id") % 2 == 1), g.filter(F.col("doc_id") % 2 == 0)
    sides = setsim.ranked(odd, even, "doc_id", "grams")         # once for all three questions
    gone = cut_lineage(setsim.matched_any(odd, even, "doc_id", "grams", 0.6, strict=True, sides=sides).select("doc_id"))
    kept = odd.join(gone, "doc_id", "left_anti")
    rows = [setsim.greatest_similarity(x, even, "doc_id", "grams", part).select(
        F.lit(name).alias("corpus"), "sim", F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))
        for name, x, part in (("before", odd, sides), ("after", kept, setsim.without_left(sides, gone, "doc_id")))]
    return rows[0].unionByName(rows[1])

"""Per-label, averaged, block and fold metrics (A15–A23, U3, S11 shape).

Truth: the order's part types.  Prediction (a rule-based stand-in for a
classifier's output): the types of each line's neighbouring part
(``p_partkey = l_partkey + 1``).  Block metrics use ``labels.quality`` and
``labels.toxic`` against rules on ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import table
from .labels import OL, line_labels
from .registry import query
from .splits import KFOLD, STRATA, kfold_table

PL = """pl AS (SELECT DISTINCT l.l_orderkey AS o_orderkey, p.p_type AS label
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey + 1)"""

CONF = """j AS (SELECT coalesce(t.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(t.label, p.label) AS label,
               (t.label IS NOT NULL)::INT AS tt, (p.label IS NOT NULL)::INT AS pp
        FROM ol t FULL OUTER JOIN pl p ON t.o_orderkey = p.o_orderkey AND t.label = p.label),
c AS (SELECT label, CAST(sum(tt * pp) AS BIGINT) AS tp, CAST(sum((1 - tt) * pp) AS BIGINT) AS fp,
             CAST(sum(tt * (1 - pp)) AS BIGINT) AS fn FROM j GROUP BY label),
s AS (SELECT label, tp, fp, fn, tp + fn AS support,
             coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
             coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c)"""

# The toxicity rule's word list and the block layout of the
# two document labels (index ranges [lo, hi)).
TOXIC_WORDS = "(idiot|moron|clown|worthless)"
BLOCKS = [("quality", 0, 1), ("toxic", 1, 2), ("all", 0, 2)]


def predicted_labels(spark, sf_dir):
    """(o_orderkey, label) once per line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (li.join(pa, pa.p_partkey == li.l_partkey + 1)
              .select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_type").alias("label")))


def scored_labels(spark, sf_dir):
    conf = metrics.confusion(line_labels(spark, sf_dir), predicted_labels(spark, sf_dir), ["o_orderkey"])
    return metrics.with_scores(conf)


@query("metrics_per_label", oracle=f"""
WITH {OL}, {PL}, {CONF}
SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM s
""")
def metrics_per_label(spark, sf_dir):
    """A15 + U3: tp/fp/fn/support and precision/recall/F1 per label."""
    return scored_labels(spark, sf_dir).select("label", "tp", "fp", "fn", "support",
                                               "precision", "recall", "f1")


@query("metrics_macro_weighted", oracle=f"""
WITH {OL}, {PL}, {CONF}
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
       round(avg(f1), 6) AS macro_f1,
       round(sum(precision * support) / sum(support), 6) AS weighted_precision,
       round(sum(recall * support) / sum(support), 6) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1
FROM s WHERE support > 0
""")
def metrics_macro_weighted(spark, sf_dir):
    """A16 + A17: macro and support-weighted averages over labels with support."""
    s = scored_labels(spark, sf_dir).filter(F.col("support") > 0).withColumn("__g", F.lit(0))
    macro = metrics.averaged(s, ["__g"], "macro")
    weighted = metrics.averaged(s, ["__g"], "weighted")
    return macro.join(weighted, "__g").drop("__g")


@query("metrics_masked", oracle="""
WITH x AS (SELECT DISTINCT l_orderkey, p_type || '-' || p_size AS label, md5('mask|' || l_orderkey) < '08' AS is_test
           FROM lineitem JOIN part ON l_partkey = p_partkey),
y AS (SELECT DISTINCT l_orderkey, p_type || '-' || p_size AS label
      FROM lineitem JOIN part ON p_partkey = l_partkey + 1 WHERE md5('mask|' || l_orderkey) < '08'),
m AS (SELECT label FROM x WHERE is_test INTERSECT SELECT label FROM x WHERE NOT is_test),
j AS (SELECT coalesce(t.label, p.label) AS label, (t.label IS NOT NULL)::INT AS tt, (p.label IS NOT NULL)::INT AS pp
      FROM (SELECT * FROM x WHERE is_test) t FULL JOIN y p ON t.l_orderkey = p.l_orderkey AND t.label = p.label),
c AS (SELECT label, sum(tt * pp) AS tp, sum((1 - tt) * pp) AS fp, sum(tt * (1 - pp)) AS fn FROM j SEMI JOIN m USING (label) GROUP BY 1),
s AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c)
SELECT count(*) AS n_labels, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
       round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall,
       round(sum(f * support) / sum(support), 6) AS weighted_f1
FROM s
""")
def metrics_masked(spark, sf_dir):
    """A14 + A16 + A17: macro and weighted averages on the test orders over the labels (type-size) that have
    positives in both the train and the test part."""
    from ..operators.splits import seeded_hash
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("label"))
    test = seeded_hash("mask", "l_orderkey") < F.lit("08")
    x = li.join(pa, li.l_partkey == pa.p_partkey).select("l_orderkey", "label").distinct().withColumn("is_test", test)
    y = li.filter(test).join(pa, pa.p_partkey == li.l_partkey + 1).select("l_orderkey", "label").distinct()
    conf = metrics.masked_confusion(x.filter(~F.col("is_test")), x.filter("is_test"), y, ["l_orderkey"])
    s = metrics.with_scores(conf).withColumn("__g", F.lit(0))
    n = s.groupBy("__g").agg(F.count(F.lit(1)).alias("n_labels"))
    return n.join(metrics.averaged(s, ["__g"], "macro"), "__g").join(metrics.averaged(s, ["__g"], "weighted"), "__g").drop("__g")


@query("metrics_blocks", oracle=f"""
WITH x AS (SELECT l.doc_id, l.quality, l.toxic, (d.n_chars >= 1000)::INT AS q_hat,
                  regexp_matches(lower(d.text), '{TOXIC_WORDS}')::INT AS t_hat
           FROM labels l JOIN documents d USING (doc_id)),
lg AS (SELECT doc_id, 0 AS label_idx, quality AS y, q_hat AS yh FROM x
       UNION ALL SELECT doc_id, 1, toxic, t_hat FROM x),
c AS (SELECT label_idx, sum(y * yh) AS tp, sum((1 - y) * yh) AS fp, sum(y * (1 - yh)) AS fn,
             sum((1 - y) * (1 - yh)) AS tn FROM lg GROUP BY 1),
s AS (SELECT label_idx, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1p,
             coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0.0) AS f1n FROM c),
b AS (SELECT 'quality' AS block, 0 AS lo, 1 AS hi UNION ALL SELECT 'toxic', 1, 2 UNION ALL SELECT 'all', 0, 2)
SELECT block, count(*) AS n_labels, round(avg(f1p), 6) AS f1_pos, round(avg((f1p + f1n) / 2), 6) AS f1_binary
FROM s JOIN b ON label_idx >= lo AND label_idx < hi GROUP BY block
""")
def metrics_blocks(spark, sf_dir):
    """A18 + A19: macro F1 per label block, and the single-label F1 averaged
    over both outcomes {0, 1}.  Block membership is an expression over the
    label index (no range join)."""
    lb = table(spark, sf_dir, "labels")
    dc = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    x = lb.join(dc, "doc_id").select(
        "doc_id", "quality", "toxic",
        (F.col("n_chars") >= 1000).cast("int").alias("q_hat"),
        F.lower("text").rlike(TOXIC_WORDS).cast("int").alias("t_hat"))
    lg = x.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("label_idx"), F.col("quality").alias("y"), F.col("q_hat").alias("yh")),
        F.struct(F.lit(1).alias("label_idx"), F.col("toxic").alias("y"), F.col("t_hat").alias("yh")))).alias("r")
    ).select("r.*")
    y, yh = F.col("y"), F.col("yh")
    c = lg.groupBy("label_idx").agg(F.sum(y * yh).alias("tp"), F.sum((1 - y) * yh).alias("fp"),
                                    F.sum(y * (1 - yh)).alias("fn"), F.sum((1 - y) * (1 - yh)).alias("tn"))
    f1p = metrics._safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    f1n = metrics._safe_div(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn"))
    s = c.select("label_idx", f1p.alias("f1p"), f1n.alias("f1n"))
    idx = F.col("label_idx")
    member = F.array_compact(F.array(*[F.when((idx >= lo) & (idx < hi), F.lit(n)) for n, lo, hi in BLOCKS]))
    return (s.select("*", F.explode(member).alias("block")).groupBy("block")
              .agg(F.count(F.lit(1)).alias("n_labels"), F.avg("f1p").alias("f1_pos"),
                   F.avg((F.col("f1p") + F.col("f1n")) / 2).alias("f1_binary")))


@query("fold_summary", oracle=f"""
WITH {OL}, {PL}, {STRATA}, {KFOLD},
t AS (SELECT f.rep, f.fold, ol.o_orderkey, ol.label FROM ol JOIN f USING (o_orderkey)),
p AS (SELECT f.rep, f.fold, pl.o_orderkey, pl.label FROM pl JOIN f USING (o_orderkey)),
j AS (SELECT coalesce(t.rep, p.rep) AS rep, coalesce(t.fold, p.fold) AS fold, coalesce(t.label, p.label) AS label,
             (t.label IS NOT NULL)::INT AS tt, (p.label IS NOT NULL)::INT AS pp
      FROM t FULL OUTER JOIN p ON t.rep = p.rep AND t.o_orderkey = p.o_orderkey AND t.label = p.label),
c AS (SELECT rep, fold, label, sum(tt * pp) AS tp, sum((1 - tt) * pp) AS fp, sum(tt * (1 - pp)) AS fn
      FROM j GROUP BY ALL),
m AS (SELECT rep, fold, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)) AS macro_f1
      FROM c WHERE tp + fn > 0 GROUP BY ALL)
SELECT rep, fold, round(macro_f1, 6) AS macro_f1 FROM m
UNION ALL SELECT rep, -1 AS fold, round(avg(macro_f1), 6) AS macro_f1 FROM m GROUP BY rep
""")
def fold_summary(spark, sf_dir):
    """Macro F1 on each (rep, fold) test part, plus the mean over folds
    (fold = -1).  One confusion aggregate keyed by (rep, fold, label)."""
    from ..session import cut_lineage
    f = cut_lineage(kfold_table(spark, sf_dir).select("rep", "fold", "o_orderkey"))
    conf = metrics.confusion(line_labels(spark, sf_dir), predicted_labels(spark, sf_dir), ["o_orderkey"],
                             parts=f).filter(F.col("support") > 0)
    per = cut_lineage(metrics.averaged(metrics.with_scores(conf), ["rep", "fold"], "macro", metrics=("f1",)))
    mean = per.groupBy("rep").agg(F.lit(-1).cast("long").alias("fold"), F.avg("macro_f1").alias("macro_f1"))
    # Results land in a table partitioned by rep; a rerun resumes and
    # skips the reps already written (the second call appends nothing)
    from ..session import scratch_path
    from ..sources.files import append_new_reps
    path = scratch_path(spark, "fold-summary")
    res = cut_lineage(per.unionByName(mean))
    append_new_reps(spark, res, path, "rep")
    out = append_new_reps(spark, res, path, "rep")
    return out.select(F.col("rep").cast("long").alias("rep"), F.col("fold").cast("long").alias("fold"), "macro_f1")


@query("leaderboard", oracle="""
WITH s AS (SELECT l_suppkey AS s_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS score
           FROM lineitem GROUP BY 1)
SELECT 'max' AS direction, rk, s_suppkey, score FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, s_suppkey) AS rk FROM s) WHERE rk <= 5
UNION ALL
SELECT 'min' AS direction, rk, s_suppkey, score FROM (
  SELECT *, row_number() OVER (ORDER BY score ASC, s_suppkey) AS rk FROM s) WHERE rk <= 5
""")
def leaderboard(spark, sf_dir):
    """Best 5 suppliers by revenue, maximising and minimising (top-k reports)."""
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("score"))
    out = []
    for direction, order in (("max", F.desc("score")), ("min", F.asc("score"))):
        top = s.orderBy(order, "s_suppkey").limit(5)
        out.append(top.select(F.lit(direction).alias("direction"),
                              F.row_number().over(Window.orderBy(order, "s_suppkey")).cast("long").alias("rk"),
                              "s_suppkey", "score"))
    return out[0].unionByName(out[1])

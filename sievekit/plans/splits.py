"""Reproducible samples and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clean, joins, metrics, splits
from ..session import cut_lineage
from ..sources import table
from .labels import OL, order_labels
from .registry import query

# SQL fragment: rarest-label stratum per order (oracle side of splits.rarest_label).
STRATA = """fr AS (SELECT label, row_number() OVER (ORDER BY count(*), label) AS r FROM ol GROUP BY label),
st AS (SELECT o_orderkey, arg_min(label, r) AS stratum FROM ol JOIN fr USING (label) GROUP BY 1)"""

KFOLD = """f AS (SELECT rep, o_orderkey, stratum,
  (row_number() OVER (PARTITION BY rep, stratum
     ORDER BY md5(CAST(rep AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR))) - 1) % 5 AS fold
  FROM st CROSS JOIN range(5) t(rep))"""


def kfold_table(spark, sf_dir):
    st = splits.rarest_label(order_labels(spark, sf_dir), "o_orderkey", "label")
    return splits.stratified_folds(st, "o_orderkey", k=5, reps=5)


@query("sample_fixed", oracle="""
SELECT doc_id, h, row_number() OVER (ORDER BY h, doc_id) AS pos FROM (
  SELECT doc_id, md5('42|' || CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h, doc_id LIMIT 300)
""")
def sample_fixed(spark, sf_dir):
    """T2 + T1: exactly 300 documents by seeded hash, with their ordinal."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    s = splits.sample_fixed(d, "doc_id", 300, seed=42).withColumnRenamed("__h", "h")
    return s.withColumn("pos", F.row_number().over(Window.orderBy("h", "doc_id")).cast("long"))


@query("shuffle_order", oracle="""
SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || CAST(doc_id AS VARCHAR))) AS pos FROM documents
""")
def shuffle_order(spark, sf_dir):
    """Full seeded permutation of the corpus (position per row)."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return splits.shuffle_positions(d, "doc_id", seed=7)


@query("stratified_kfold", oracle=f"""
WITH {OL}, {STRATA}, {KFOLD}
SELECT rep, o_orderkey, stratum, fold FROM f
""")
def stratified_kfold(spark, sf_dir):
    """T6 + T9 + T11: 5 seeds × 5 folds, stratum = rarest label, one long table."""
    return kfold_table(spark, sf_dir)


@query("iterative_kfold")
def iterative_kfold(spark, sf_dir):
    """5 repetitions x 5 folds by iterative stratification: every label's rows, not only those of
    the rarest label of a row, are spread evenly."""
    return splits.iterative_folds(order_labels(spark, sf_dir), "o_orderkey", "label", k=5, reps=5)


@query("train_val_cut", oracle=f"""
WITH {OL}, {STRATA}, {KFOLD},
part AS (SELECT rep, test_fold, o_orderkey, stratum, fold FROM f, range(5) t(test_fold)),
c AS (SELECT rep, test_fold, o_orderkey,
        row_number() OVER (PARTITION BY rep, test_fold, stratum ORDER BY md5('v' || CAST(rep AS VARCHAR) || '-'
          || CAST(test_fold AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR))) AS p,
        count(*) OVER (PARTITION BY rep, test_fold, stratum) AS m FROM part WHERE fold <> test_fold)
SELECT rep, test_fold, o_orderkey, CASE WHEN p <= ceil(m * 0.8) THEN 'train' ELSE 'val' END AS role, true AS fit FROM c
UNION ALL
SELECT rep, test_fold, o_orderkey, 'test' AS role, false AS fit FROM part WHERE fold = test_fold
""")
def train_val_cut(spark, sf_dir):
    """T7 + T11 + O5: in every repetition each fold is the test part once; the other folds are
    cut 80/20 into train/val with the same stratification and a seed per (rep, fold); ``fit``
    marks train ∪ val (the final-fit set) without copying rows."""
    f = cut_lineage(kfold_table(spark, sf_dir))
    part = f.withColumn("test_fold", F.explode(F.sequence(F.lit(0).cast(f.schema["fold"].dataType),
                                                          F.lit(4).cast(f.schema["fold"].dataType))))
    keys = ["rep", "test_fold", "o_orderkey"]
    test = part.filter(F.col("fold") == F.col("test_fold")).select(*keys, F.lit("test").alias("role"))
    tr = splits.position_cut(part.filter(F.col("fold") != F.col("test_fold")), ["rep", "test_fold", "stratum"],
                             "o_orderkey", F.concat(F.lit("v"), F.col("rep").cast("string"), F.lit("-"),
                                                    F.col("test_fold").cast("string")), 0.8, "train", "val")
    out = tr.select(*keys, "role").unionByName(test)
    return out.withColumn("fit", F.col("role").isin("train", "val"))


@query("stratified_split_max", oracle=f"""
WITH {OL},
d AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM ol)),
st AS (SELECT o_orderkey, max(idx) AS stratum FROM ol JOIN d USING (label) GROUP BY 1),
a AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('s1|' || CAST(o_orderkey AS VARCHAR))) AS p,
             count(*) OVER (PARTITION BY stratum) AS m FROM st),
b AS (SELECT o_orderkey, stratum, CASE WHEN p <= ceil(m * 0.8) THEN 'train' ELSE 'test' END AS r1 FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('s2|' || CAST(o_orderkey AS VARCHAR))) AS p,
             count(*) OVER (PARTITION BY stratum) AS m FROM b WHERE r1 = 'train')
SELECT o_orderkey, stratum, CASE WHEN p <= ceil(m * 0.8) THEN 'train' ELSE 'val' END AS role FROM c
UNION ALL SELECT o_orderkey, stratum, 'test' AS role FROM b WHERE r1 = 'test'
""")
def stratified_split_max(spark, sf_dir):
    """T8 + F11: stratum = index of the last positive (the greatest label: indexes follow label order);
    80/20 train/test, then 80/20 of train into train/val."""
    ol = order_labels(spark, sf_dir)
    d = clean.label_index(ol)
    st = cut_lineage(ol.groupBy("o_orderkey").agg(F.max("label").alias("label")).join(d, "label")
                       .select("o_orderkey", F.col("label_idx").cast("long").alias("stratum")))
    a = cut_lineage(splits.position_cut(st, "stratum", "o_orderkey", "s1", 0.8, "train", "test", role="r1"))
    test = a.filter(F.col("r1") == "test").select("o_orderkey", "stratum", F.lit("test").alias("role"))
    b = splits.position_cut(a.filter(F.col("r1") == "train").drop("r1"), "stratum", "o_orderkey",
                            "s2", 0.8, "train", "val")
    return b.select("o_orderkey", "stratum", "role").unionByName(test)


@query("group_split", oracle="""
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT o_custkey, sum(n) OVER (ORDER BY n DESC, md5(CAST(o_custkey AS VARCHAR))
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             (SELECT sum(n) FROM s) AS tot FROM s)
SELECT o.o_orderkey, o.o_custkey,
       CASE WHEN cum * 100 <= tot * 80 THEN 'train' WHEN cum * 100 <= tot * 90 THEN 'val' ELSE 'test' END AS role
FROM orders o JOIN c USING (o_custkey)
""")
def group_split(spark, sf_dir):
    """80/10/10 split where no customer spans two parts, largest first."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sizes = od.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    g = splits.group_split(sizes, "o_custkey")
    return od.join(g.select("o_custkey", "role"), "o_custkey").select("o_orderkey", "o_custkey", "role")


@query("label_mask", oracle="""
WITH x AS (SELECT DISTINCT l_orderkey, p_type || '-' || CAST(p_size AS VARCHAR) AS label,
                  md5('mask|' || CAST(l_orderkey AS VARCHAR)) < '08' AS is_test
           FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT label FROM x WHERE is_test INTERSECT SELECT label FROM x WHERE NOT is_test
""")
def label_mask(spark, sf_dir):
    """Labels (type-size) with ≥ 1 positive in both train and test."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    x = (li.join(pa, li.l_partkey == pa.p_partkey)
           .select("l_orderkey", F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("label"),
                   (splits.seeded_hash("mask", "l_orderkey") < F.lit("08")).alias("is_test")))
    return metrics.label_mask(x.filter(~F.col("is_test")), x.filter(F.col("is_test")))

"""Multi-label tables, cleaning filters, lookups and class assignment.

Stand-in for the reference's (compound, pathway) facts: entity = order,
label = the ``p_type`` of a part on one of its lines.  The canonical form is
the long table ``(o_orderkey, label)``; wide multi-hot only at the edge.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggs, clean, joins
from ..sources import table
from .registry import query

# SQL fragment shared by the oracles: the long (order, label) table.
OL = """ol AS (SELECT DISTINCT l.l_orderkey AS o_orderkey, p.p_type AS label
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def line_parts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return li.join(pa, li.l_partkey == pa.p_partkey, "inner").drop("p_partkey")


def line_labels(spark, sf_dir):
    """(o_orderkey, label) once per line: for operators that take repeated rows as one."""
    return line_parts(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_type").alias("label"))


def order_labels(spark, sf_dir):
    return aggs.spread(line_labels(spark, sf_dir), "o_orderkey", "label").distinct()


def label_names(dictionary) -> list[str]:
    """Names for the columns of a wide table.  They are its schema, which the driver holds in any
    case; the long table stays the form for any number of labels."""
    return [r["label"] for r in dictionary.orderBy("label_idx").collect()]


@query("label_lists", oracle="""
SELECT l_orderkey AS o_orderkey,
       array_to_string(list_sort(list_distinct(list(p_type))), '|') AS types,
       array_to_string(list_sort(list_distinct(list(p_brand))), '|') AS brands,
       CAST(count(DISTINCT p_type) AS INTEGER) AS n_types
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY l_orderkey
""")
def label_lists(spark, sf_dir):
    """A3 + A7 + O3: per order the sorted distinct type and brand lists."""
    lp = line_parts(spark, sf_dir)
    return (lp.groupBy(F.col("l_orderkey").alias("o_orderkey"))
              .agg(aggs.sorted_set("p_type").alias("t"), aggs.sorted_set("p_brand").alias("b"))
              .select("o_orderkey", F.array_join("t", "|").alias("types"),
                      F.array_join("b", "|").alias("brands"), F.size("t").alias("n_types")))


@query("parallel_lists", oracle="""
SELECT l_orderkey, l_returnflag, array_to_string(list(p_type ORDER BY l_linenumber, l_partkey, l_suppkey), '|') AS types,
       array_to_string(list('S' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey), '|') AS suppliers
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_returnflag
""")
def parallel_lists(spark, sf_dir):
    """A3: per (order, return flag) the types and suppliers of its lines, two lists in line order with repeats."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey",
                                                 F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("suppliers"))
    pa = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("types"))
    x = li.join(pa, li.l_partkey == pa.p_partkey)
    got = aggs.parallel_lists(x, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey"], ["types", "suppliers"])
    return got.select("l_orderkey", "l_returnflag", F.array_join("types", "|").alias("types"),
                      F.array_join("suppliers", "|").alias("suppliers"))


@query("label_list_describe", oracle=f"""
WITH {OL}, n AS (SELECT o_orderkey, count(*) AS k FROM ol GROUP BY 1)
SELECT count(k) AS count, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, min(k)::DOUBLE AS min,
       round(quantile_cont(k, 0.25), 6) AS q25, round(quantile_cont(k, 0.5), 6) AS q50,
       round(quantile_cont(k, 0.75), 6) AS q75, max(k)::DOUBLE AS max
FROM n
""")
def label_list_describe(spark, sf_dir):
    """A4: describe() of label-list lengths."""
    n = order_labels(spark, sf_dir).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("k"))
    return aggs.describe(n, "k")


def _multi_hot_sql():
    # The six p_type labels of the driver tables, sorted.
    labels = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    cols = ",\n  ".join(f"max(CASE WHEN label = '{x}' THEN 1 ELSE 0 END) AS \"{x}\"" for x in labels)
    return f"WITH {OL}\nSELECT o_orderkey,\n  {cols}\nFROM ol GROUP BY o_orderkey"


@query("multi_hot", oracle=_multi_hot_sql())
def multi_hot(spark, sf_dir):
    """A5 + P11 + P15: one 0/1 column per observed label, labels in sorted order.

    Labels with no positive never reach the dictionary (P11 is free in long
    form); the pivot gets the explicit value list so Spark skips its own
    distinct-values job.
    """
    ol = order_labels(spark, sf_dir)
    names = label_names(clean.label_index(ol))
    wide = ol.groupBy("o_orderkey").pivot("label", names).agg(F.max(F.lit(1)))
    return wide.fillna(0, subset=names)


@query("label_array_unnest", oracle=f"""
WITH {OL}
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, label
FROM ol
""")
def label_array_unnest(spark, sf_dir):
    """0/1 label arrays + name dictionary → one long row per positive.

    One order's label indices become its array, ``posexplode`` gives the
    positives back and a join to the dictionary restores the names.
    """
    ol = order_labels(spark, sf_dir)
    d = clean.label_index(ol)
    n_labels = d.count()
    arr = (ol.join(d, "label")
             .groupBy("o_orderkey").agg(F.collect_set("label_idx").alias("idx"))
             .select("o_orderkey", F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)),
                                               lambda i: F.array_contains("idx", i).cast("int"))
                     .alias("y")))
    long = (arr.select("o_orderkey", F.posexplode("y").alias("label_idx", "v"))
               .filter(F.col("v") == 1).drop("v"))
    return long.join(d, "label_idx").select("o_orderkey", "label_idx", "label")


@query("label_fold_or", oracle=f"""
WITH {OL}
SELECT DISTINCT o_orderkey, CASE WHEN label = 'PROMO' THEN 'STANDARD' ELSE label END AS label FROM ol
""")
def label_fold_or(spark, sf_dir):
    """Fold PROMO into STANDARD (logical OR), PROMO disappears."""
    return clean.fold_label(order_labels(spark, sf_dir), "label", "PROMO", "STANDARD", ["o_orderkey"])


@query("label_frequency", oracle="""
SELECT p_brand, n, freq_rank FROM (
  SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS freq_rank
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p_brand)
WHERE freq_rank <= 10
""")
def label_frequency(spark, sf_dir):
    """A1 + A2: the 10 most frequent brands by line count (top-k report)."""
    t = clean.top_frequent(line_parts(spark, sf_dir), "p_brand", 10)
    return t.select("p_brand", "n", F.col("freq_rank").cast("long").alias("freq_rank"))


@query("label_positives", oracle=f"""
WITH {OL}
SELECT label, count(*) AS n_pos, row_number() OVER (ORDER BY count(*) DESC, label) AS pos_rank
FROM ol GROUP BY label
""")
def label_positives(spark, sf_dir):
    """Positives per label, ranked (label domain is the bounded vocabulary)."""
    ol = order_labels(spark, sf_dir)
    n = clean.value_counts(ol, "label")
    # labels with a greater count come first: a running sum over the distinct counts only
    before = (n.groupBy("n").agg(F.count(F.lit(1)).alias("same"))
              .select(F.col("n").alias("m"), F.coalesce(F.sum("same").over(
                  Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")))
    place = F.row_number().over(Window.partitionBy("n").orderBy("label"))
    return (n.withColumn("place", place).join(before, F.col("n") == F.col("m"))
            .select("label", F.col("n").alias("n_pos"), (F.col("ahead") + F.col("place")).cast("long").alias("pos_rank")))


@query("drop_frequent", oracle="""
WITH lp AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_brand
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
top AS (SELECT p_brand FROM (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rk
                             FROM lp GROUP BY p_brand) WHERE rk <= 5)
SELECT * FROM lp
WHERE p_brand NOT IN (SELECT p_brand FROM top)
  AND (p_brand IS NULL OR p_brand NOT IN ('Brand#1', 'Brand#10'))
""")
def drop_frequent(spark, sf_dir):
    """P6 + P4: drop the 5 most frequent brands, then a literal brand list."""
    lp = line_parts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand")
    return clean.not_in(clean.drop_frequent(lp, "p_brand", top_n=5), "p_brand", ["Brand#1", "Brand#10"])


@query("drop_positions", oracle="""
WITH f AS (SELECT p_brand, min(p_partkey) AS o FROM part GROUP BY 1),
pos AS (SELECT p_brand, row_number() OVER (ORDER BY o, p_brand) - 1 AS pos FROM f)
SELECT p_partkey, p_brand FROM part
WHERE p_brand NOT IN (SELECT p_brand FROM pos WHERE pos IN (0, 3, 7))
""")
def drop_positions(spark, sf_dir):
    """P5: drop brands at positions 0, 3, 7 of the first-seen (by p_partkey) list."""
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return clean.drop_positions(pa, "p_brand", "p_partkey", [0, 3, 7])


@query("min_group_size", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 600)
""")
def min_group_size(spark, sf_dir):
    """Keep lines of suppliers with at least 600 lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return clean.min_group_size(li, "l_suppkey", 600)


@query("min_token_count", oracle=r"""
WITH w AS (SELECT doc_id,
           CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS INTEGER) AS n_words
           FROM documents)
SELECT doc_id, n_words, (SELECT max(n_words) FROM w) AS max_words FROM w WHERE n_words >= 7
""")
def min_token_count(spark, sf_dir):
    """P8 + A25: documents with at least 7 word tokens, and the corpus maximum."""
    from ..functions.text import word_count
    w = table(spark, sf_dir, "documents").select("doc_id", word_count("text").alias("n_words"))
    mx = w.agg(F.max("n_words")).scalar()
    return w.filter(F.col("n_words") >= 7).select("doc_id", "n_words", mx.alias("max_words"))


@query("parse_or_drop", oracle=r"""
SELECT event_id, user_id, k FROM (
  SELECT event_id, user_id, TRY_CAST(regexp_extract(props, '"k":\s*(-?[0-9]+)', 1) AS INTEGER) AS k
  FROM events) WHERE k IS NOT NULL
""")
def parse_or_drop(spark, sf_dir):
    """Parse the numeric ``k`` attribute out of ``props``; drop unparseable rows."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "props")
    k = F.regexp_extract("props", r'"k":\s*(-?[0-9]+)', 1).try_cast("int")
    return clean.parse_or_drop(ev, "k", k).select("event_id", "user_id", "k")


@query("name_lookup", oracle="""
WITH fn AS (SELECT n_regionkey, arg_min(n_name, n_nationkey) AS region_first_nation FROM nation GROUP BY 1),
ls AS (SELECT c_mktsegment, arg_max(c_name, c_custkey) AS segment_last_customer FROM customer GROUP BY 1)
SELECT c.c_custkey, coalesce(n.n_name, CAST(c.c_nationkey AS VARCHAR)) AS nation_name,
       r.r_name AS region_name, fn.region_first_nation, ls.segment_last_customer
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN fn ON n.n_regionkey = fn.n_regionkey
LEFT JOIN ls ON c.c_mktsegment = ls.c_mktsegment
""")
def name_lookup(spark, sf_dir):
    """P16 + J7 + J12 + P17: code→name with fallback, mandatory region lookup,
    first nation per region, last customer per segment."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    na = table(spark, sf_dir, "nation")
    rg = table(spark, sf_dir, "region")
    x = clean.code_to_name(cu, "c_nationkey", na, "n_nationkey", "n_name", "nation_name")
    x = x.join(na.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey", "left")
    nat_region = joins.mandatory_lookup(
        na.select("n_regionkey").distinct(), rg.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"),
        "n_regionkey", "r_name")
    x = x.join(nat_region, "n_regionkey", "left")
    first = joins.first_match(na, "n_regionkey", "n_name", "n_nationkey") \
        .withColumnRenamed("n_name", "region_first_nation")
    last = joins.last_match(cu, "c_mktsegment", "c_name", "c_custkey") \
        .withColumnRenamed("c_name", "segment_last_customer")
    x = x.join(first, "n_regionkey", "left").join(last, "c_mktsegment", "left")
    return x.select("c_custkey", "nation_name", F.col("r_name").alias("region_name"),
                    "region_first_nation", "segment_last_customer")


@query("column_normalise", oracle="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def column_normalise(spark, sf_dir):
    """P2 + P3 + S12: a messy header is normalised; the key is resolved by name."""
    cu = table(spark, sf_dir, "customer")
    messy = cu.toDF(*[f"  {c.upper()} " for c in cu.columns])      # header-only change
    norm = clean.normalise_columns(messy)
    key = clean.resolve_column(norm, "c_custkey", 0)
    return norm.select(key, *[c for c in norm.columns if c != key])


@query("token_clean", oracle=r"""
SELECT p_partkey, regexp_replace(p_brand, '^(?:Brand#)', '') AS brand_code,
       lower(regexp_replace(p_name, '<[^>]*>', '', 'g')) AS name_clean,
       array_to_string(regexp_extract_all(p_name, '[A-Za-z]+'), '|') AS name_words
FROM part
""")
def token_clean(spark, sf_dir):
    """P13 + F7: strip the ``Brand#`` prefix and tags; extract all words."""
    from ..functions.text import strip_prefix, strip_tags
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return pa.select("p_partkey", strip_prefix("p_brand", "Brand#").alias("brand_code"),
                     F.lower(strip_tags("p_name")).alias("name_clean"),
                     F.array_join(F.regexp_extract_all("p_name", F.lit("[A-Za-z]+"), 0), "|")
                     .alias("name_words"))


@query("url_parts", oracle=r"""
SELECT page_id,
       regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
       regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS lang,
       regexp_extract(url, '\?([^#]*)', 1) AS query
FROM pages
""")
def url_parts(spark, sf_dir):
    """scheme, host, first path segment and query string of page URLs."""
    pg = table(spark, sf_dir, "pages").select("page_id", "url")
    u = F.col("url")
    return pg.select("page_id",
                     F.regexp_extract(u, r"^([a-z]+)://", 1).alias("scheme"),
                     F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1).alias("host"),
                     F.regexp_extract(u, r"^[a-z]+://[^/?#]+/([^/?#]*)", 1).alias("lang"),
                     F.regexp_extract(u, r"\?([^#]*)", 1).alias("query"))


@query("class_assign_frequent", oracle=f"""
WITH {OL},
fr AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS rk FROM ol GROUP BY label)
SELECT o_orderkey, arg_min(label, rk) AS assigned,
       coalesce(arg_min(label, rk) FILTER (WHERE rk <= 3), 'Other') AS assigned_top3
FROM ol JOIN fr USING (label) GROUP BY o_orderkey
""")
def class_assign_frequent(spark, sf_dir):
    """The order's globally most frequent label; top-3 cut variant → 'Other'."""
    ol = order_labels(spark, sf_dir)
    top = clean.top_frequent(ol, "label", 3).select("label", F.col("freq_rank").alias("rk"))
    j = ol.join(clean.value_counts(ol, "label"), "label").join(F.broadcast(top), "label", "left")   # three rows
    return j.groupBy("o_orderkey").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("assigned"),
        F.coalesce(F.min_by("label", "rk"), F.lit("Other")).alias("assigned_top3"))


@query("class_assign_first", oracle=f"""
WITH {OL} SELECT o_orderkey, min(label) AS assigned FROM ol GROUP BY o_orderkey
""")
def class_assign_first(spark, sf_dir):
    """First positive in label order."""
    return order_labels(spark, sf_dir).groupBy("o_orderkey").agg(F.min("label").alias("assigned"))


@query("class_assign_second", oracle=f"""
WITH {OL}
SELECT o_orderkey, label AS assigned FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY label) AS rn,
         count(*) OVER (PARTITION BY o_orderkey) AS n FROM ol)
WHERE rn = least(2, n)
""")
def class_assign_second(spark, sf_dir):
    """Second positive when several, else the only one."""
    ol = order_labels(spark, sf_dir)
    names = F.sort_array(F.collect_set("label"))           # one order's labels
    return (ol.groupBy("o_orderkey").agg(names.alias("names"))
            .select("o_orderkey", F.element_at("names", F.least(F.size("names"), F.lit(2))).alias("assigned")))


@query("dataset_shape", oracle=f"""
WITH {OL}
SELECT count(DISTINCT o_orderkey) AS n_rows, count(DISTINCT label) AS n_labels,
       count(*) AS n_positives, count(DISTINCT label) + 2 AS n_columns,
       round(count(*) / count(DISTINCT o_orderkey), 6) AS labels_per_row
FROM ol
""")
def dataset_shape(spark, sf_dir):
    """Row / label / positive counts of the multi-label table."""
    ol = order_labels(spark, sf_dir)
    return ol.agg(F.countDistinct("o_orderkey").alias("n_rows"),
                  F.countDistinct("label").alias("n_labels"),
                  F.count(F.lit(1)).alias("n_positives")) \
             .select("n_rows", "n_labels", "n_positives", (F.col("n_labels") + 2).alias("n_columns"),
                     (F.col("n_positives") / F.col("n_rows")).alias("labels_per_row"))


@query("group_attr_chain", oracle="""
SELECT c.c_custkey,
       coalesce(array_to_string(list_sort(list_distinct(list(o.o_orderpriority))), '|'), '') AS priorities,
       count(o.o_orderkey) AS n_orders
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey
""")
def group_attr_chain(spark, sf_dir):
    """Group → members → attribute set (customer → orders → priorities)."""
    cu = table(spark, sf_dir, "customer").select("c_custkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"),
                                               "o_orderpriority")
    return (cu.join(od, "c_custkey", "left").groupBy("c_custkey")
              .agg(F.array_join(aggs.sorted_set("o_orderpriority"), "|").alias("priorities"),
                   F.count("o_orderkey").alias("n_orders")))

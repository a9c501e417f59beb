"""File-format round trips: every query writes its input files from the
driver tables into a fresh folder under the shared checkpoint directory and
reads them back with the operators of ``sources.files``.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files, table
from ..functions.text import first_value, strip_tags
from ..session import scratch_path
from .registry import query

PART_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()), T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])


@query("html_items", oracle=r"""
SELECT page_id, pos, regexp_extract(item, 'href="([^"]*)"', 1) AS href,
       regexp_replace(item, '<[^>]*>', '', 'g') AS text
FROM (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages))
WHERE pos >= 1
""")
def html_items(spark, sf_dir):
    """S5 + F7: rows out of each page's list items (first item = header row,
    skipped), link target and tag-free text."""
    pg = table(spark, sf_dir, "pages").select("page_id", files.html_list_items(F.col("html")).alias("items"))
    x = pg.select("page_id", F.posexplode("items").alias("pos", "item")).filter(F.col("pos") >= 1)
    return x.select("page_id", F.col("pos").cast("long").alias("pos"),
                    F.regexp_extract("item", r'href="([^"]*)"', 1).alias("href"),
                    strip_tags("item").alias("text"))


@query("record_attributes", oracle="""
SELECT 'P' || p_partkey AS unique_id, p_type || '|' || p_brand AS types, p_name AS common_name,
       p_size AS size FROM part
""")
def record_attributes(spark, sf_dir):
    """S3 + F10: attribute-value records written as text (``KEY - value`` lines,
    a comment, ``//`` terminators) and parsed back into maps of value lists."""
    pa = table(spark, sf_dir, "part")
    rec = F.concat_ws("\n",
                      F.concat(F.lit("UNIQUE-ID - P"), F.col("p_partkey").cast("string")),
                      F.concat(F.lit("TYPES - "), "p_type"), F.concat(F.lit("TYPES - "), "p_brand"),
                      F.lit("# generated record"),
                      F.concat(F.lit("COMMON-NAME - "), "p_name"),
                      F.concat(F.lit("SIZE - "), F.col("p_size").cast("string")),
                      F.lit("//"))
    path = scratch_path(spark, "records")
    pa.select(rec.alias("value")).write.text(path)
    r = files.read_records(spark, path)
    a = F.col("attrs")
    return r.select(first_value(a, "UNIQUE-ID").alias("unique_id"),
                    F.array_join(F.element_at(a, "TYPES"), "|").alias("types"),
                    first_value(a, "COMMON-NAME").alias("common_name"),
                    first_value(a, "SIZE").cast("int").alias("size"))


@query("flatfile_records", oracle="""
SELECT 'R' || p_partkey AS entry, p_name || ' (part)' AS name,
       'C' || p_partkey || ' + C' || p_size || ' <=> C' || (p_partkey + p_size) AS equation, p_brand AS enzyme,
       array_to_string(list_sort(list_distinct([p_size || '.1.1.' || (p_partkey % 7), p_size || '.2.1.1',
                                                p_size || '.3.1.1'])), ' ') AS ec_numbers,
       array_to_string(list_sort(['K' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0'),
                                  'K' || lpad(CAST((p_partkey + 1) % 100000 AS VARCHAR), 5, '0')]), ' ') AS orthologs
FROM part
""")
def flatfile_records(spark, sf_dir):
    """S4 + S6: sectioned flat records (``///`` terminated): key-prefixed fields
    with whitespace collapsed, and the EC numbers / ortholog ids of the
    ORTHOLOGY section (header line included, section ends at the next key)."""
    pa = table(spark, sf_dir, "part")
    k = lambda c: F.lpad((c % 100000).cast("string"), 5, "0")
    pk, sz = F.col("p_partkey"), F.col("p_size").cast("string")
    rec = F.concat_ws("\n",
                      F.concat(F.lit("ENTRY       R"), pk.cast("string")),
                      F.concat(F.lit("NAME        "), "p_name", F.lit("   (part)")),
                      F.concat(F.lit("EQUATION    C"), pk.cast("string"), F.lit(" + C"), sz, F.lit(" <=> C"),
                               (pk + F.col("p_size")).cast("string")),
                      F.concat(F.lit("ENZYME      "), "p_brand"),
                      F.concat(F.lit("ORTHOLOGY   K"), k(pk), F.lit("  "), "p_type", F.lit(" [EC:"), sz,
                               F.lit(".1.1."), (pk % 7).cast("string"), F.lit(" "), sz, F.lit(".2.1.1]")),
                      F.concat(F.lit("            K"), k(pk + 1), F.lit("  other [EC:"), sz, F.lit(".3.1.1]")),
                      F.concat(F.lit("CLASS       "), "p_type", F.lit(" [EC:9.9.9.9]")),
                      F.lit("///"))
    path = scratch_path(spark, "flat")
    pa.select(rec.alias("value")).write.text(path)
    raw = spark.read.option("lineSep", "///\n").text(path).filter(F.trim("value") != "")
    v = F.col("value")
    sec = files.section_lines(v, "ORTHOLOGY")
    return raw.select(F.regexp_extract(v, r"(?m)^ENTRY\s+(\S+)", 1).alias("entry"),
                      files.key_field(v, "NAME").alias("name"),
                      files.key_field(v, "EQUATION").alias("equation"),
                      files.key_field(v, "ENZYME").alias("enzyme"),
                      F.array_join(files.ec_numbers(sec), " ").alias("ec_numbers"),
                      F.array_join(files.ortholog_ids(sec), " ").alias("orthologs"))


@query("delimited_roundtrip", oracle="""
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, p_retailprice AS retail_from_matrix,
       p_brand AS brand_from_tsv FROM part
""")
def delimited_roundtrip(spark, sf_dir):
    """S1 + S2 + S7 + S8 + S9 + S10 + S12: part exported as CSV with a header (S8),
    the header peeked (S12) and re-read with an explicit schema and declared
    fields (S1); a headerless TSV re-read with assigned names (S2); an id list
    and a numeric matrix snapshotted separately (S10) and re-aligned by exact
    input position (S7); each order's part keys also go to a ragged TSV (S9)."""
    pa = table(spark, sf_dir, "part")
    base = scratch_path(spark, "delim")
    files.write_delimited(pa, f"{base}/csv")
    cols = files.header_columns(spark, f"{base}/csv")
    if cols[0] != "p_partkey":
        raise ValueError(f"unexpected header {cols}")
    back = files.read_delimited(spark, f"{base}/csv", PART_SCHEMA, [f.name for f in PART_SCHEMA.fields])
    files.write_delimited(pa.select("p_partkey", "p_brand"), f"{base}/tsv", header=False, sep="\t")
    tsv = files.read_headerless(spark, f"{base}/tsv", ["p_partkey", "brand_from_tsv"]) \
        .withColumn("p_partkey", F.col("p_partkey").cast("long"))
    src = pa.select("p_partkey", "p_retailprice")
    files.snapshot(src.select("p_partkey"), f"{base}/ids")
    files.snapshot(src.select(F.col("p_retailprice").alias("retail_from_matrix")), f"{base}/matrix")
    mat = files.zip_by_position(spark.read.parquet(f"{base}/ids"), spark.read.parquet(f"{base}/matrix"))
    # Ragged lists (each order's part keys — small per-order groups) as one
    # column per list position
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("keys"))
    files.write_ragged(lists, "l_orderkey", "keys", f"{base}/ragged")
    return back.join(mat, "p_partkey").join(tsv, "p_partkey")


@query("ragged_roundtrip", oracle="""
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS INTEGER) AS pos, l_partkey FROM lineitem
""")
def ragged_roundtrip(spark, sf_dir):
    """Each order's part keys written as one ragged row (one column per position) and read back as rows."""
    path = scratch_path(spark, "ragged")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("keys"))
    files.write_ragged(lists, "l_orderkey", "keys", path)
    back = files.read_ragged(spark, path, "l_orderkey", "l_partkey")
    return back.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "pos", F.col("l_partkey").cast("long").alias("l_partkey"))

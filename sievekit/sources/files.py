"""File sources and sinks.

Records are never read as whole files: attribute-value files are split into
records by the text source's ``lineSep`` (one record per row), sections and
keys are parsed with array/regex expressions per row, and positional
alignment uses the parquet reader's ``_metadata.row_index`` together with the
part number of the file instead of an assumed global file order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window, Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squash_ws


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, fields: list[str],
                   header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited file with an explicit schema, keeping only declared fields."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path).select(*fields)


def read_headerless(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """Headerless TSV, names assigned after the read."""
    return spark.read.option("header", False).option("sep", sep).csv(path).toDF(*names)


def header_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Discover column names from the header only (no inference pass)."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns


def write_delimited(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """Delimited sink with a header and no index column."""
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Parquet snapshot of an intermediate."""
    df.write.mode("overwrite").parquet(path)


def _file_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with writer task, file number and row index, row counts per file)."""
    name = F.col("_metadata.file_name")
    rows = df.select("*", F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("__part"),
                     F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long").alias("__file"),
                     F.col("_metadata.row_index").alias("__row"))
    return rows, rows.groupBy("__part", "__file").agg(F.count(F.lit(1)).alias("__n"))


def with_input_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Exact input position of each row of a parquet read: (writer task, row over all files
    that the task rolled).  Two snapshots written from the same partitioning align row by row
    on this ordinal, also when their files were rolled at different places."""
    rows, sizes = _file_rows(df)
    before = Window.partitionBy("__part").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", "__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (rows.join(starts, ["__part", "__file"])
            .select(*df.columns, F.struct(F.col("__part").alias("part"),
                                          (F.col("__start") + F.col("__row")).alias("row")).alias(name)))


def zip_by_position(ids: DataFrame, matrix: DataFrame) -> DataFrame:
    """Join an id list to a numeric matrix by input position (equi join on
    the ordinal — never an assumed global order); raises when a row has no partner."""
    totals = [_file_rows(df)[1].groupBy("__part").agg(F.sum("__n").alias(n)) for df, n in ((ids, "a"), (matrix, "b"))]
    if totals[0].join(totals[1], "__part", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).limit(1).count():
        raise ValueError("the two inputs do not hold the same number of rows per part")
    return with_input_ordinal(ids).join(with_input_ordinal(matrix), "ordinal").drop("ordinal")


def write_ragged(df: DataFrame, group: str, list_col: str, path: str, prefix: str = "item_") -> int:
    """One row per group, one column per list position (NULL padded), TSV.
    Returns the number of position columns (the longest list)."""
    width = df.agg(F.max(F.size(list_col))).first()[0] or 0
    cols = [F.try_element_at(F.col(list_col), F.lit(i + 1)).cast("string").alias(f"{prefix}{i + 1}")
            for i in range(width)]
    df.select(group, *cols).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return width


def read_ragged(spark: SparkSession, path: str, group: str, value: str, prefix: str = "item_") -> DataFrame:
    """S9 read back: (group, pos from 1, value) of the positions that hold something."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = [c for c in wide.columns if c.startswith(prefix)]
    if not names:
        return wide.select(group, F.lit(1).alias("pos"), F.lit(None).cast("string").alias(value)).limit(0)
    long = wide.unpivot([group], names, "__name", value).filter(F.col(value).isNotNull())
    return long.select(group, F.substring("__name", len(prefix) + 1, 20).cast("int").alias("pos"), value)


def append_new_reps(spark: SparkSession, df: DataFrame, path: str, key: str = "rep") -> DataFrame:
    """Append result rows partitioned by ``key``, resuming a previous run:
    keys already present in the table are skipped (left anti on the keys)."""
    new = df
    try:
        known = spark.read.parquet(path).select(key).distinct()
    except AnalysisException as e:
        # only a missing folder means that there is no table yet; any other error is raised
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        new = df.join(known, key, "left_anti")
    new.write.mode("append").partitionBy(key).parquet(path)
    return spark.read.parquet(path)


def read_records(spark: SparkSession, path: str, terminator: str = "\n//\n",
                 encoding: str = "ISO-8859-1") -> DataFrame:
    """S3: attribute-value records (``KEY - value`` lines, ``#`` comments,
    records ended by ``//``) → one row per record with a map key → value list.

    Lines split on the FIRST ``' - '``; blank and comment lines are skipped.  Only a line
    that is ``//`` alone ends a record, and the bytes are decoded by ``encoding``."""
    raw = spark.read.option("lineSep", terminator).text(path) \
        .select(F.decode(F.col("value").cast("binary"), encoding).alias("value"))
    lines = raw.select(F.filter(F.split("value", "\n"),
                                lambda l: (F.trim(l) != "") & ~l.startswith("#") & (F.instr(l, " - ") > 0))
                       .alias("lines"))
    kv = lines.select(F.transform("lines", lambda l: F.struct(
        F.substring_index(l, " - ", 1).alias("k"),
        F.substring(l, F.instr(l, " - ") + 3, 1 << 30).alias("v"))).alias("kv")).filter(F.size("kv") > 0)
    keys = kv.select("kv", F.array_distinct(F.transform("kv", lambda e: e["k"])).alias("keys"))
    return keys.select(F.map_from_arrays(
        "keys", F.transform("keys", lambda k: F.transform(F.filter("kv", lambda e: e["k"] == k),
                                                          lambda e: e["v"]))).alias("attrs"))


def key_field(record: Column, key: str) -> Column:
    """Value of a key-prefixed line (``KEY   value``), whitespace collapsed."""
    return squash_ws(F.regexp_extract(record, rf"(?m)^{key}\s+(.*)$", 1))


def section_lines(record: Column, section: str) -> Column:
    """The lines of one section of a flat record — the header line (which
    carries the first entry) and its indented continuation lines, up to the
    next non-indented line.  A single pass with ``aggregate``."""
    lines = F.split(record, "\n")
    init = F.struct(F.lit(False).alias("in"), F.array().cast("array<string>").alias("out"))

    def step(acc, line):
        header = ~line.startswith(" ") & (line != "")
        now_in = F.when(header, line.startswith(section + " ")).otherwise(acc["in"])
        out = F.when(now_in, F.concat(acc["out"], F.array(line))).otherwise(acc["out"])
        return F.struct(now_in.alias("in"), out.alias("out"))

    return F.aggregate(lines, init, step)["out"]


def ec_numbers(section: Column) -> Column:
    """Sorted distinct EC numbers inside ``[EC:a b]`` lists of a section."""
    groups = F.flatten(F.transform(section, lambda l: F.regexp_extract_all(l, F.lit(r"\[EC:([^\]]*)\]"), 1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(F.trim(g), r"\s+")))))


def ortholog_ids(section: Column) -> Column:
    """Sorted distinct ``K\\d{5}`` identifiers of a section."""
    return F.array_sort(F.array_distinct(F.flatten(
        F.transform(section, lambda l: F.regexp_extract_all(l, F.lit(r"\b(K\d{5})\b"), 1)))))


def html_list_items(html: Column) -> Column:
    """Raw ``<li>`` item contents of a page, in document order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1)

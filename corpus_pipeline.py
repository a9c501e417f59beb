"""Corpus pipeline: quality rules, language ID, near-dedup, substring dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``:

1. quality rules: documents that fail the base rule or lie far from every language reference go.
2. language ID: documents without a letter, or without a clear language, go; where no row has a
   language to learn from, only those without a letter go.
3. near-dedup: the smallest doc_id of every group of near copies (5-word shingles, Jaccard of at
   least 0.8) stays, once.
4. substring dedup: passages of 50 words or more stay in the smallest doc_id only; the text is
   the kept words joined by one space where something was removed, and n_chars follows it.
5. best-fit packing: the kept texts as pieces in sequences of at most 2048 tokens.

Cases: null texts fail the base rule of stage 1; rows with a null doc_id are in no group of near copies
and stay, equal texts once; nulls in lang, source and n_chars remove nothing; empty tables pass through all stages; ties and
repeated rows are settled by doc_id and, where that repeats, by equal texts being one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.language_id import UNKNOWN, predict, train
from sievekit.llm.near_dedup import near_duplicates
from sievekit.llm.packing import pack_documents, production_vocabulary
from sievekit.llm.quality import quality_rules
from sievekit.llm.substring_dedup import substring_dedup
from sievekit.session import cut_lineage, ensure_checkpoint_dir, ship_package
from sievekit.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# op6 keeps its own 0.85; 20 bands of 4 registers miss a pair at 0.8 with probability 2.6e-5
NEAR = (80, 100)

# the tokenizer cannot be expressed in SQL
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    # the verdict is by text, so rows that share a doc_id are told apart by a hash of theirs
    marked = docs.select(*COLUMNS).withColumn("_text", F.xxhash64("text"))
    good = cut_lineage(quality_rules(marked.select("doc_id", "text", "lang", "_text")).select("doc_id", "_text", "kept"))
    good = good.filter("kept").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    return marked.join(good, same, "left_semi").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = docs.select(*COLUMNS)
    model = train(docs)
    if not model.langs:
        # nothing to tell languages by: only texts without a letter go
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = predict(docs, model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = docs.select(*COLUMNS)
    # rows with a null id are in no group and stay; rows that share an id are told apart by a hash of the text
    stay = (near_duplicates(docs, threshold=NEAR, text_hash="_hash").filter("kept")
            .select(F.col("doc_id").alias("_id"), "_hash").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    found = substring_dedup(docs.select(*COLUMNS))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                        F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long"))
                        .otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return pack_documents(docs.select("doc_id", "text"), production_vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs

"""Corpus integration, exact decontamination and held-out overlap.

Stand-in: ``documents`` split by doc_id parity into two corpora (even = the
held-out / first source, odd = the corpus being cleaned); ``benchmark`` is an
extra held-out set.  Exact-duplicate key = md5 of the trimmed lower-case text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import text_key
from ..operators.joins import anti_join_many, fanout_join, semi_join
from ..operators.ranking import first_per_key
from ..sources import table
from .registry import query


def keyed_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", text_key("text").alias("key"))


@query("integrate_corpora", oracle="""
WITH k AS (
  SELECT doc_id, lang, md5(trim(lower(text))) AS key,
         CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS corpus
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY corpus, doc_id) AS rn,
         bool_or(corpus = 'a') OVER (PARTITION BY key)
           AND bool_or(corpus = 'b') OVER (PARTITION BY key) AS in_both,
         count(*) OVER (PARTITION BY key) AS n_copies
  FROM k)
SELECT key, doc_id, lang, corpus, in_both, n_copies FROM r WHERE rn = 1
""")
def integrate_corpora(spark, sf_dir):
    """J1 + J3 + O1 + W1 + P1 in ONE shuffle.

    Union both corpora tagged 'a'/'b', then a single keyed aggregate keeps the
    first row by (corpus, doc_id): a key present in corpus a always resolves to
    an a-row, which is exactly ``A ∪ (B ▷ A)`` deduplicated, and the same
    aggregate flags keys found in both (the inner-join J1 view).
    """
    k = keyed_documents(spark, sf_dir).withColumn(
        "corpus", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    agg = (k.groupBy("key").agg(
        F.min_by(F.struct("doc_id", "lang", "corpus"), F.struct("corpus", "doc_id")).alias("f"),
        (F.max((F.col("corpus") == "a").cast("int")) * F.max((F.col("corpus") == "b").cast("int")) == 1)
        .alias("in_both"),
        F.count(F.lit(1)).alias("n_copies")))
    return agg.select("key", "f.doc_id", "f.lang", "f.corpus", "in_both", "n_copies")


@query("key_matches", oracle="""
WITH k AS (SELECT doc_id, source, md5(trim(lower(text))) AS key FROM documents)
SELECT a.key, a.doc_id AS doc_id_a, a.source AS source_a, b.doc_id AS doc_id_b, b.source AS source_b
FROM k a JOIN k b ON a.key = b.key WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1
""")
def key_matches(spark, sf_dir):
    """Even-half and odd-half documents of equal text, all matches kept."""
    k = keyed_documents(spark, sf_dir).select("key", "doc_id", "source")
    return fanout_join(k.filter(F.col("doc_id") % 2 == 0), k.filter(F.col("doc_id") % 2 == 1), "key")


@query("decontaminate_exact", oracle="""
WITH k AS (SELECT doc_id, lang, source, md5(trim(lower(text))) AS key FROM documents),
odd AS (SELECT * FROM k WHERE doc_id % 2 = 1),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) rn FROM odd)
          WHERE rn = 1),
held AS (
  SELECT key FROM k WHERE doc_id % 2 = 0 AND lang = 'en'
  UNION ALL SELECT key FROM k WHERE doc_id % 2 = 0 AND lang = 'fr'
  UNION ALL SELECT key FROM k WHERE doc_id % 2 = 0 AND lang IN ('de', 'es')
  UNION ALL SELECT md5(trim(lower(text))) FROM benchmark)
SELECT doc_id, key, lang, source FROM first f
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.key = f.key)
""")
def decontaminate_exact(spark, sf_dir):
    """W1 + text key + J4: keep the first odd-half document per key unless the
    key occurs in any of the four held-out sets (even-half en / fr / de+es,
    and ``benchmark``).

    One scan of ``documents`` and ONE keyed aggregate: every row contributes
    to ``min_by(odd row, doc_id)`` (even rows carry a NULL ordering and are
    ignored) and to a held-out flag; the partial aggregate collapses hot keys
    on each mapper, so the anti join of J4 costs no extra shuffle.  The
    two-step form (``first_per_key`` + ``anti_join_many``) computes the same.
    """
    k = keyed_documents(spark, sf_dir)
    odd = F.col("doc_id") % 2 == 1
    held_groups = [["en"], ["fr"], ["de", "es"]]
    # a NULL key never matches a held-out key (SQL NOT EXISTS semantics)
    held = ~odd & F.col("lang").isin(*[x for g in held_groups for x in g]) & F.col("key").isNotNull()
    docs = k.select("key", F.struct("doc_id", "lang", "source").alias("row"),
                    F.when(odd, F.col("doc_id")).alias("ord"), held.alias("held"))
    bench = table(spark, sf_dir, "benchmark").select(
        text_key("text").alias("key"), F.lit(None).cast(docs.schema["row"].dataType).alias("row"),
        F.lit(None).cast("long").alias("ord"), F.col("text").isNotNull().alias("held"))
    agg = docs.unionByName(bench).groupBy("key").agg(
        F.min_by("row", "ord").alias("first"), F.max("held").alias("held"))
    out = agg.filter(F.col("first").isNotNull() & ~F.col("held"))
    return out.select(F.col("first.doc_id").alias("doc_id"), "key", F.col("first.lang").alias("lang"),
                      F.col("first.source").alias("source"))


def decontaminate_exact_two_step(spark, sf_dir):
    """Reference form of the same query: keep-first, then anti join the union of the four key sets."""
    k = keyed_documents(spark, sf_dir)
    odd = first_per_key(k.filter(F.col("doc_id") % 2 == 1), "key", "doc_id")
    even = k.filter(F.col("doc_id") % 2 == 0)
    held = [
        even.filter(F.col("lang") == "en"),
        even.filter(F.col("lang") == "fr"),
        even.filter(F.col("lang").isin("de", "es")),
        table(spark, sf_dir, "benchmark").select(text_key("text").alias("key")),
    ]
    return anti_join_many(odd, held, "key").select("doc_id", "key", "lang", "source")


@query("heldout_overlap", oracle="""
WITH k AS (SELECT doc_id, md5(trim(lower(text))) AS key FROM documents)
SELECT a.doc_id, a.key FROM k a
WHERE a.doc_id % 2 = 1
  AND EXISTS (SELECT 1 FROM k b WHERE b.doc_id % 2 = 0 AND b.key = a.key)
""")
def heldout_overlap(spark, sf_dir):
    """Odd-half documents whose key also occurs in the even half."""
    k = keyed_documents(spark, sf_dir).select("doc_id", "key")
    return semi_join(k.filter(F.col("doc_id") % 2 == 1), k.filter(F.col("doc_id") % 2 == 0), "key")

"""Operator 4: license scans as an exact set-similarity join.

Text blocks are joined with license notice templates by containment: a block is a run
of consecutive words, across line ends, of at most 1 / ``threshold`` of the notice's words
(so wrapped notices are whole and words scattered over a text do not add up).  A block
meets a template when it holds at least ``threshold`` of the template's distinct words,
all words that tell the license from its likes, and none that name another one.

Template words are ordered by their frequency over all documents, rarest first.  A block
that meets a template must hold one of its first |T| - need + 1 words (prefix filter), so
only the surroundings of those words are looked at; they must have ``need`` words of the
template (length filter), and what is left is verified block by block.  The template table
is a parameter of fixed size, so only it is broadcast.

A base scan beside it finds exact phrases anywhere in the word sequence.

Cases: a null or empty text has no words, places or labels and score 0; repeated
rows are scanned alike; an empty table gives no rows; equal frequencies are
ordered by the word; extra columns do not matter, the result holds ``key`` and
the columns it adds.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .native import NON_ALNUM, split_words, text_of
from .registry import query

THRESHOLD = (8, 10)

# fixed values: phrases of the base scan and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: license notices and their labels
TEMPLATES = {
    "apache": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "licensed under a creative commons attribution sharealike license",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl": "subject to the terms of the mozilla public license",
}

# words a block must hold, and words it must not hold, to meet the notice of that label
TELLING = {"apache": ["apache"], "cc-by-nc": ["nc"], "cc-by-sa": ["sharealike"], "gpl": ["gnu", "general"],
           "lgpl": ["lesser"], "mit": ["mit"], "mpl": ["mozilla"]}
FOREIGN = {"gpl": ["lesser", "affero"]}


def scan_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: runs of digits, a-z and anything beyond ASCII."""
    return split_words(F.translate(text, ascii_uppercase, ascii_lowercase), NON_ALNUM)


def template_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for label, notice in templates.items():
        word = "".join(c if c.isalnum() else " " for c in notice.lower()).split()
        out[label] = sorted(set(word))
    return out


def word_order(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template word by its count over all documents, rarest first.

    Only template words leave the map side, so the result has at most as many rows
    as the templates have words."""
    counted = (words.select(F.explode(F.filter("_w", lambda w: w.isin(vocabulary))).alias("word"))
               .groupBy("word").count().collect())
    freq = {r["word"]: r["count"] for r in counted}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (freq.get(w, 0), w)))}


def containment_join(words: DataFrame, key: str, templates: dict[str, str], threshold: tuple[int, int] = THRESHOLD,
                     telling: dict[str, list[str]] = TELLING, foreign: dict[str, list[str]] = FOREIGN) -> DataFrame:
    """(key, template, shared, size) of the blocks around a prefix word that meet a template.

    ``words`` has ``key`` and the words ``_w`` of the text; ``shared`` is that of the best block."""
    num, den = threshold
    sets = template_sets(templates)
    vocabulary = sorted({w for s in sets.values() for w in s})
    rank = word_order(words, vocabulary)
    spark = words.sparkSession
    prefix = []
    for label, s in sets.items():
        ordered = sorted(s, key=rank.get)
        need = -(-len(ordered) * num // den)
        length = -(-len("".join(c if c.isalnum() else " " for c in templates[label]).split()) * den // num)
        for w in ordered[:len(ordered) - need + 1]:
            prefix.append((w, label, ordered, need, length, telling.get(label, []), foreign.get(label, [])))
    table_of = spark.createDataFrame(
        prefix, "word string, template string, ordered array<string>, need int, length int, "
                "telling array<string>, foreign array<string>")
    starts = sorted({p[0] for p in prefix})
    reach = max((p[4] for p in prefix), default=1)
    places = F.array_compact(F.transform("_w", lambda w, i: F.when(w.isin(starts), i)))
    hit = (words.filter(F.arrays_overlap("_w", F.array(*[F.lit(w) for w in starts])))
           .select(key, "_w", F.explode(places).alias("_i")))
    # the words up to reach - 1 before and behind the prefix word, and its place among them
    first = F.greatest(F.col("_i") - (reach - 1), F.lit(0))
    hit = hit.select(key, F.get("_w", F.col("_i")).alias("word"), (F.col("_i") - first).alias("_at"),
                     F.slice("_w", first + 1, F.col("_i") - first + reach).alias("_near"))
    hit = hit.join(F.broadcast(table_of), "word")
    # length: a block of fewer words than need cannot meet; position: the word is one of need or more shared ones,
    # of which those ranked before it can only be the rarer prefix words that stand around it
    rarer = F.size(F.array_intersect(F.slice("ordered", 1, F.array_position("ordered", F.col("word")).cast("int") - 1), "_near"))
    later = F.size("ordered") - F.array_position("ordered", F.col("word")).cast("int") + 1
    hit = hit.filter((F.size("_near") >= F.col("need")) & (rarer + later >= F.col("need")))
    hit = hit.filter((F.size(F.array_intersect("ordered", "_near")) >= F.col("need"))
                     & (F.size(F.array_except("telling", "_near")) == 0))
    begins = F.sequence(F.greatest(F.col("_at") - F.col("length") + 2, F.lit(1)), F.col("_at") + 1)

    def held(i: Column) -> Column:
        block = F.slice("_near", i, F.col("length"))
        own = (F.size(F.array_except("telling", block)) == 0) & ~F.arrays_overlap("foreign", block)
        return F.when(own, F.size(F.array_intersect("ordered", block))).otherwise(0)
    return (hit.select(key, "template", "need", F.array_max(F.transform(begins, held)).alias("shared"),
                       F.size("ordered").alias("size"))
            .filter(F.col("shared") >= F.col("need")).drop("need"))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """Array of (start, label) of every place where a phrase's words stand consecutively."""
    def at(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in phrases.items():
            first, *rest = phrase.split()
            same = w == first
            for k, r in enumerate(rest, 1):
                same = same & F.coalesce(F.get(words, i + k) == r, F.lit(False))
            found = F.when(same, F.lit(label)).otherwise(found)
        return F.struct(i.cast("long").alias("start"), found.alias("label"))
    firsts = F.array(*[F.lit(p.split()[0]) for p in phrases])
    places = F.filter(F.transform(words, at), lambda x: x["label"].isNotNull())
    return F.when(F.arrays_overlap(words, firsts), places).otherwise(
        F.array().cast("array<struct<start:bigint,label:string>>"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: base places, base labels, all labels and the best containment."""
    # rows that repeat a key are told apart by their text
    words = docs.select(F.col(key), text_of(text).alias("_t")).select(
        key, F.xxhash64("_t").alias("_tid"), scan_words(F.col("_t")).alias("_w"))
    base = (words.select(key, "_tid", F.size("_w").cast("long").alias("n_words"),
                         phrase_places(F.col("_w"), phrases).alias("_p"))
            .select(key, "_tid", "n_words", F.size("_p").cast("long").alias("n_base"),
                    F.array_min(F.transform("_p", lambda x: x["start"])).alias("first_word"),
                    F.array_max(F.transform("_p", lambda x: x["start"])).alias("last_word"),
                    F.array_sort(F.array_distinct(F.transform("_p", lambda x: x["label"]))).alias("_base")))
    row = F.struct(F.col(key).alias("k"), F.col("_tid").alias("t"))
    joined = containment_join(words.select(row.alias("_row"), "_w"), "_row", templates)
    found = (joined.groupBy("_row").agg(F.collect_set("template").alias("_more"),
                                        F.max(F.col("shared") / F.col("size")).alias("_best"))
             .select(F.col("_row.k").alias("_k"), F.col("_row.t").alias("_kt"), "_more", "_best"))
    out = base.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_tid") == F.col("_kt")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return out.select(
        key, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))


def _sql() -> str:
    """Every block of consecutive words against every template, and phrases by position."""
    num, den = THRESHOLD
    listed = lambda words: "[" + ", ".join(repr(w) for w in words) + "]::VARCHAR[]"
    rows = []
    for label, words in template_sets(TEMPLATES).items():
        long = -(-len("".join(c if c.isalnum() else " " for c in TEMPLATES[label]).split()) * den // num)
        rows.append(f"('{label}', {listed(words)}, {-(-len(words) * num // den)}, {long}, "
                    f"{listed(TELLING.get(label, []))}, {listed(FOREIGN.get(label, []))})")
    phr = ", ".join(f"('{v}', [{', '.join(repr(w) for w in p.split())}])" for p, v in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(t, '{ascii_uppercase}', '{ascii_lowercase}'),
                                        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
p(label, ph) AS (VALUES {phr}),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w), p
           WHERE w[i + 1:i + len(ph)] = ph),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
                list_sort(list(DISTINCT label)) AS bl FROM places GROUP BY 1),
m(label, s, need, long, telling, strange) AS (VALUES {', '.join(rows)}),
may AS (SELECT doc_id, w, m.* FROM w, m WHERE len(list_intersect(w, s)) >= need AND list_has_all(w, telling)),
blocks AS (SELECT doc_id, label, s, need, telling, strange, w[i:i + long - 1] AS b
           FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM may)),
met AS (SELECT doc_id, label, len(list_intersect(b, s)) / len(s) AS share FROM blocks
        WHERE len(list_intersect(b, s)) >= need AND list_has_all(b, telling) AND NOT list_has_any(b, strange)),
found AS (SELECT doc_id, list(DISTINCT label) AS ml, max(share) AS best FROM met GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(bl, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(best, 0.0), 6) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op4_license_scan", oracle=_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every whole document."""
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

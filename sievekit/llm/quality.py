"""Operator 10: quality rules by distribution divergence.

Each text is turned into two histograms: characters by class, and common words
of several languages (all other words in one more bin).  A language's reference
is the mean of the normalised histograms of all its documents.  A document
fails when even its nearest reference is farther than a threshold by
Jensen-Shannon distance (base 2, 0 to 1), provided that it is long enough to be judged.

Cases: a null or empty text has zero counts and fails the base rule; rows with a
null language are judged but shape no reference; without any reference the
method rejects nothing; repeated rows are judged alike; an empty table gives no rows;
other columns pass, those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .native import split_words, text_of
from .registry import query

MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.42

# fixed values: frequent words of the languages that the references cover
COMMON_WORDS = """
the of and to a in is that it for on was with be as at this by are from
de la le et les des en un du une que est pour qui dans au sur par pas
der die und den von zu das sich mit auf ist nicht im eine dem ein als
el del y los se las no por con una para es su al lo
""".split()
COMMON = sorted(set(COMMON_WORDS))

# fixed values: character classes as regular expressions; the rest counts as lower-case letters
CLASSES = {"symbol": r"[#*$%&|<>]", "upper": "[A-Z]", "digit": "[0-9]",
           "punct": r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]"}
BINS = [*CLASSES, "space", "wide", "other"]


def measure(docs: DataFrame, window: int = 5) -> DataFrame:
    """Counts and histograms of every text, beside the input columns other than ``text``.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the histograms char_hist
    and word_hist, and their shares char_share and word_share.  Everything stays inside one row: windows are hashed, and only where
    two are equal are (hash, position) pairs sorted to find the words they cover.
    """
    keep = [c for c in docs.columns if c not in
            {"text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_hist", "word_hist",
             "char_share", "word_share"}]
    d = docs.select(*keep, text_of().alias("_t"))
    d = d.select("*", split_words(F.col("_t")).alias("_w"),
                 F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
                 split_words(F.lower("_t"), r"[^\p{L}]+").alias("_runs"),
                 *[F.regexp_count("_t", F.lit(rx)).cast("long").alias(f"_c_{k}")
                   for k, rx in CLASSES.items()])
    d = d.select("*", F.size("_w").cast("long").alias("n_words"),
                 F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                 F.filter("_runs", lambda x: x.isin(COMMON)).alias("_common"), F.size("_runs").alias("_letter_runs"))
    # window hashes by doubling: two overlapping stretches make the longer one
    d, have = d.withColumn("_h1", F.col("_w")), 1
    while have < window:
        grow = min(have, window - have)
        tail = F.slice(f"_h{have}", grow + 1, F.greatest(F.size(f"_h{have}") - grow, F.lit(0)))
        d = d.select("*", F.zip_with(f"_h{have}", tail, lambda a, b: F.xxhash64(a, b)).alias(f"_h{have + grow}"))
        have += grow
    d = d.select("*", F.slice(f"_h{window}", 1, F.greatest(F.col("n_words").cast("int") - (window - 1), F.lit(0))).alias("_h"))
    d = d.select("*", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_rep"))
    d = d.select("*", F.when(F.col("_rep"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
                 .alias("_s"))
    d = d.select("*", F.when(F.col("_rep"), F.sort_array(F.transform(F.filter(
        "_s", lambda x, i: (F.coalesce(F.get("_s", i - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))
                 .alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(
        F.lit(window), F.coalesce(F.get("_p", j + 1) - p, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)
    space = F.char_length("_t") - F.col("word_chars")
    wide = F.octet_length("_t") - F.char_length("_t")
    known = sum((F.col(f"_c_{k}") for k in CLASSES), F.lit(0).cast("long"))
    chars = [*[F.col(f"_c_{k}") for k in CLASSES], space, wide, F.greatest(
        F.lit(0), F.char_length("_t") - known - space - wide)]
    hits = [F.size("_common") - F.size(F.array_remove("_common", w)) for w in COMMON]
    d = d.select(
        *keep, "n_words", "word_chars", F.col("_c_symbol").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_rep"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[c.cast("double") for c in chars]).alias("char_hist"),
        F.array(*[h.cast("double") for h in hits],
                (F.col("_letter_runs") - F.size("_common")).cast("double")).alias("word_hist"))
    return d.select("*", _shares(F.col("char_hist")).alias("char_share"), _shares(F.col("word_hist")).alias("word_share"))


def _shares(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    return F.transform(hist, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def references(measured: DataFrame, lang: str = "lang") -> list[tuple[str, list[float], list[float]]]:
    """(language, character reference, word reference), one per language value.

    Sums of shares per bin, so every task sends one partial row per language."""
    nc, nw = len(BINS), len(COMMON) + 1
    shares = measured.filter(F.col(lang).isNotNull() & (F.col("n_words") > 0)).select(
        F.col(lang).alias("_lang"), F.col("char_share").alias("c"), F.col("word_share").alias("w"))
    rows = shares.groupBy("_lang").agg(
        *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(nc)],
        *[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(nw)]).collect()
    out = []
    for r in rows:
        c, w = [float(r[f"c{i}"]) for i in range(nc)], [float(r[f"w{i}"]) for i in range(nw)]
        out.append((r["_lang"], [x / (sum(c) or 1) for x in c], [x / (sum(w) or 1) for x in w]))
    return sorted(out)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of two share arrays."""
    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return (F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)) / 2
    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), total))


def judge(measured: DataFrame, refs: list, max_char: float = MAX_CHAR_DISTANCE,
          max_word: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """Add base_failed, char_distance, word_distance and kept."""
    def nearest(shares: str, which: int) -> Column:
        if not refs:
            return F.lit(0.0)
        far = [js_distance(F.col(shares), F.array(*[F.lit(x) for x in r[which]])) for r in refs]
        return F.least(*far) if len(far) > 1 else far[0]
    d = measured.select("*", nearest("char_share", 1).alias("char_distance"), nearest("word_share", 2).alias("word_distance"),
                 ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))
    verdict = (F.col("n_words") < min_words) | ((F.col("char_distance") <= max_char) & (F.col("word_distance") <= max_word))
    return d.select("*", (~F.col("base_failed") & verdict).alias("kept"))


def quality_rules(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """Measure every row once into a written table without texts, build the references from
    all of them, and judge each."""
    measured = cut_lineage(measure(docs))
    return judge(measured, references(measured, lang))


def _sql_distance(shares: str, ref: str) -> str:
    return f"""sqrt(greatest(0.0, list_sum(list_transform(list_zip({shares}, {ref}), lambda z:
      (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0.0 END
       + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0.0 END) / 2))))"""


def _sql() -> str:
    """The same measure and verdict in DuckDB, by unnesting every window."""
    lit = {k: rx.replace("'", "''") for k, rx in CLASSES.items()}
    gone = {k: f"(length(t) - length(regexp_replace(t, '{rx}', '', 'g')))" for k, rx in lit.items()}
    known = " + ".join(gone.values())
    common = ", ".join(f"'{w}'" for w in COMMON)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        regexp_extract_all(lower(t), '\p{{L}}+') AS runs,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
n AS (SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        list_filter(runs, lambda x: list_contains([{common}], x)) AS c FROM m),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM n)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_rep FROM twice, range(5) t(k) GROUP BY 1),
h AS (SELECT *, [{', '.join(gone.values())}, length(t) - word_chars, strlen(t) - length(t),
          greatest(0, length(t) - ({known}) - (length(t) - word_chars) - (strlen(t) - length(t)))] AS ch,
        list_append(list_transform([{common}], lambda x: len(list_filter(c, lambda y: y = x))), len(runs) - len(c)) AS wh
      FROM n),
s AS (SELECT *, list_transform(ch, lambda x: CASE WHEN list_sum(ch) > 0 THEN x / list_sum(ch) ELSE 0.0 END) AS pc,
        list_transform(wh, lambda x: CASE WHEN list_sum(wh) > 0 THEN x / list_sum(wh) ELSE 0.0 END) AS pw FROM h),
one AS (SELECT lang, 'c' AS kind, unnest(pc) AS x, generate_subscripts(pc, 1) AS b FROM s WHERE lang IS NOT NULL AND n_words > 0
        UNION ALL
        SELECT lang, 'w', unnest(pw), generate_subscripts(pw, 1) FROM s WHERE lang IS NOT NULL AND n_words > 0),
bins AS (SELECT lang, kind, b, sum(x) AS x FROM one GROUP BY ALL),
ref AS (SELECT lang, kind, list(x / t ORDER BY b) AS q FROM
          (SELECT *, sum(x) OVER (PARTITION BY lang, kind) AS t FROM bins) GROUP BY ALL),
far AS (SELECT doc_id, min({_sql_distance('pc', 'q')}) FILTER (WHERE kind = 'c') AS char_distance,
               min({_sql_distance('pw', 'q')}) FILTER (WHERE kind = 'w') AS word_distance
        FROM s, ref GROUP BY doc_id),
r AS (SELECT s.*, coalesce(n_rep, 0) AS n_rep, char_distance, word_distance,
        n_words < 10 OR 100 * coalesce(n_rep, 0) > 20 * n_words AS base_failed
      FROM s JOIN far USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, ch[1]::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (n_words < {MIN_WORDS} OR (char_distance <= {MAX_CHAR_DISTANCE}
         AND word_distance <= {MAX_WORD_DISTANCE})) AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM r"""


@query("op10_js_quality", oracle=_sql())
def op10_js_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_distance", "word_distance")

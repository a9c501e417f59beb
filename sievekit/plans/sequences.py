"""Token sequences over ``conversations`` and the embedding cache.

Words = lower-case letter runs (same splitter as every other word feature).
Vocabulary: 5 specials, then all words, sorted.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from ..operators import sequences as Q
from ..operators import joins, splits
from ..sources import table
from .registry import query

TOK = r"""t AS (SELECT conv_id, turn, role,
              list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS w
       FROM conversations)"""
VOCAB = """f AS (SELECT token, count(*) AS c FROM (SELECT unnest(w) AS token FROM t) GROUP BY 1),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 4 AS INTEGER) AS token_id FROM f
      UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[MASK]', 4)) s(token, token_id))"""
ENC = """x AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM t),
j AS (SELECT x.conv_id, x.turn, x.pos, coalesce(v.token_id, 1) AS tid FROM x LEFT JOIN v USING (token)),
agg AS (SELECT conv_id, turn, list(tid ORDER BY pos) AS ids FROM j GROUP BY ALL),
enc AS (SELECT t.conv_id, t.turn, list_concat([2], coalesce(agg.ids, [])[1:30], [3]) AS e
        FROM t LEFT JOIN agg USING (conv_id, turn)),
pad AS (SELECT conv_id, turn, len(e) AS n_tokens,
               list_concat(e, list_transform(range(32 - len(e)), lambda x: 0)) AS ids,
               list_concat(list_transform(range(len(e)), lambda x: 1), list_transform(range(32 - len(e)), lambda x: 0)) AS am
        FROM enc)"""
MSK = """m AS (SELECT conv_id, turn, ids,
             list_transform(ids, lambda x, i: x >= 5 AND
               substr(md5('42|' || conv_id || '|' || turn || '|' || (i - 1)), 1, 4) < '2666') AS mk FROM pad),
ml AS (SELECT conv_id, turn, list_transform(ids, lambda x, i: CASE WHEN mk[i] THEN 4 ELSE x END) AS masked,
              list_transform(ids, lambda x, i: CASE WHEN mk[i] THEN x ELSE -100 END) AS labels FROM m)"""

MAX_LEN = 32


def tokenised(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.select("conv_id", "turn", "role", words("text").alias("w"))


def encoded(spark, sf_dir):
    t = tokenised(spark, sf_dir)
    vocab = Q.vocabulary(t, "w", min_freq=1)
    return Q.encode(t, ["conv_id", "turn"], "w", vocab, MAX_LEN)


def _s(col):
    return F.array_join(F.col(col).cast("array<string>"), " ")


@query("tokens_vocab", oracle=f"""
WITH {TOK}, {VOCAB}
SELECT token, token_id, (SELECT max(len(w)) FROM t) AS max_len FROM v
""")
def tokens_vocab(spark, sf_dir):
    """X5 + X6 + A24: vocabulary file (specials first) and the longest sequence."""
    t = tokenised(spark, sf_dir)
    mx = t.agg(F.max(F.size("w")).cast("long")).scalar()
    return Q.vocabulary(t, "w", min_freq=1).select("token", "token_id", mx.alias("max_len"))


@query("encode_tokens", oracle=f"""
WITH {TOK}, {VOCAB}, {ENC}
SELECT conv_id, turn, array_to_string(ids, ' ') AS input_ids, array_to_string(am, ' ') AS attention_mask, n_tokens
FROM pad
""")
def encode_tokens(spark, sf_dir):
    """[CLS] ids [SEP] + padding to 32, unknown → [UNK], attention mask."""
    e = encoded(spark, sf_dir)
    return e.select("conv_id", "turn", _s("input_ids").alias("input_ids"),
                    _s("attention_mask").alias("attention_mask"), F.col("n_tokens").cast("long").alias("n_tokens"))


@query("mask_tokens", oracle=f"""
WITH {TOK}, {VOCAB}, {ENC}, {MSK}
SELECT conv_id, turn, array_to_string(masked, ' ') AS masked_ids, array_to_string(labels, ' ') AS labels,
       len(list_filter(labels, lambda x: x <> -100)) AS n_masked
FROM ml
""")
def mask_tokens(spark, sf_dir):
    """MLM masking with p = 0.15 by md5 threshold, seeded per (row, position)."""
    m = Q.mask_tokens(encoded(spark, sf_dir), ["conv_id", "turn"], seed=42)
    return m.select("conv_id", "turn", _s("masked_ids").alias("masked_ids"), _s("labels").alias("labels"),
                    F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_masked"))


@query("masked_accuracy", oracle=f"""
WITH {TOK}, {VOCAB}, {ENC}, {MSK},
mode AS (SELECT x AS tid FROM (SELECT unnest(ids) AS x FROM pad) WHERE x >= 5
         GROUP BY x ORDER BY count(*) DESC, x LIMIT 1),
lab AS (SELECT unnest(labels) AS l FROM ml)
SELECT count(*) FILTER (WHERE l <> -100) AS n_masked,
       count(*) FILTER (WHERE l <> -100 AND l = (SELECT tid FROM mode)) AS n_correct,
       round(coalesce(count(*) FILTER (WHERE l <> -100 AND l = (SELECT tid FROM mode))
             / nullif(count(*) FILTER (WHERE l <> -100), 0), 0.0), 6) AS accuracy
FROM lab
""")
def masked_accuracy(spark, sf_dir):
    """Accuracy of predicting the corpus' most frequent token at every
    masked position; summable (correct, masked) state; 0 when nothing is masked."""
    m = Q.mask_tokens(encoded(spark, sf_dir), ["conv_id", "turn"], seed=42)
    mode = (m.select(F.explode("input_ids").alias("x")).filter(F.col("x") >= len(Q.SPECIALS))
             .groupBy("x").count().orderBy(F.desc("count"), "x").limit(1).select("x").scalar())
    lab = m.select(F.explode("labels").alias("l")).filter(F.col("l") != -100)
    s = lab.agg(F.count(F.lit(1)).alias("n_masked"),
                F.sum((F.col("l") == mode).cast("long")).alias("n_correct"))
    s = s.select("n_masked", F.coalesce("n_correct", F.lit(0)).cast("long").alias("n_correct"))
    return s.select("n_masked", "n_correct",
                    F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_masked")),
                               F.lit(0.0)).alias("accuracy"))


@query("perplexity", oracle=f"""
WITH {TOK},
x AS (SELECT role, unnest(w) AS token FROM t),
p AS (SELECT token, count(*) / (SELECT count(*) FROM x) AS p FROM x GROUP BY token),
r AS (SELECT role, count(*) AS n_tokens, -avg(ln(p.p)) AS nll FROM x JOIN p USING (token) GROUP BY role
      UNION ALL SELECT 'all', count(*), -avg(ln(p.p)) FROM x JOIN p USING (token))
SELECT role, n_tokens, round(nll, 6) AS log_perplexity, round(exp(nll), 3) AS perplexity FROM r
""")
def perplexity(spark, sf_dir):
    """Unigram-model perplexity exp(mean NLL) per role and overall.

    Counts are pre-aggregated per (role, token) before the join with the
    global token probabilities, so a frequent token never skews the join."""
    t = tokenised(spark, sf_dir)
    rt = t.select("role", F.explode("w").alias("token")).groupBy("role", "token").agg(F.count(F.lit(1)).alias("c"))
    tot = rt.agg(F.sum("c")).scalar()
    p = rt.groupBy("token").agg((F.sum("c") / tot).alias("p"))
    j = rt.join(p, "token").withColumn("ll", F.col("c") * F.log("p"))
    per = j.groupBy("role").agg(F.sum("c").alias("n_tokens"), (-F.sum("ll") / F.sum("c")).alias("nll"))
    allr = j.agg(F.lit("all").alias("role"), F.sum("c").alias("n_tokens"), (-F.sum("ll") / F.sum("c")).alias("nll"))
    r = per.unionByName(allr)
    return r.select("role", "n_tokens", F.col("nll").alias("log_perplexity"),
                    F.round(F.exp("nll"), 3).alias("perplexity"))


@query("embedding_cache_join", oracle="""
WITH f AS (SELECT rep, vec_id, label,
             (row_number() OVER (PARTITION BY rep, label
                ORDER BY md5(CAST(rep AS VARCHAR) || '|' || CAST(vec_id AS VARCHAR))) - 1) % 5 AS fold
           FROM embeddings CROSS JOIN range(5) t(rep))
SELECT f.rep, f.fold, f.vec_id, round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm
FROM f JOIN embeddings e USING (vec_id)
""")
def embedding_cache_join(spark, sf_dir):
    """X9 + J7 + J13: vectors computed once (the embeddings table is the cache)
    and attached to the 5 × 5 fold table by a mandatory id join — no copies
    per split, no positional alignment."""
    emb = table(spark, sf_dir, "embeddings")
    folds = splits.stratified_folds(emb.select("vec_id", F.col("label").alias("stratum")), "vec_id")
    vec = emb.select("vec_id", F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0),
                                                  lambda a, x: a + x * x)).alias("norm"))
    j = joins.mandatory_lookup(folds, vec, "vec_id", "norm")
    return j.select("rep", "fold", "vec_id", "norm")


@query("encoder_registry", oracle=r"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS BIGINT)
       AS n_words, true AS same
FROM documents
""")
def encoder_registry(spark, sf_dir):
    """U1 + U4: a pluggable Arrow-batched encoder (pandas UDF) next to the
    built-in expression; both must agree row by row."""
    from ..functions.udfs import ENCODERS
    n_words_udf = ENCODERS["n_words"]

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = d.select("doc_id", n_words_udf("text").alias("n_words"), F.size(words("text")).cast("long").alias("b"))
    return x.select("doc_id", "n_words", (F.col("n_words") == F.col("b")).alias("same"))


@query("encoder_vectors", oracle="""
SELECT doc_id, array_to_string([len(lower(text)) - len(replace(lower(text), v, '')) for v in ['a', 'e', 'i', 'o', 'u']], ' ') AS vec,
       true AS same
FROM documents
""")
def encoder_vectors(spark, sf_dir):
    """An Arrow-batched encoder that gives a vector per row, beside the built-in expressions."""
    from ..functions.udfs import ENCODERS, VOWELS
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = F.array(*[F.regexp_count(F.lower("text"), F.lit(v)) for v in VOWELS])
    x = d.select("doc_id", ENCODERS["vowel_vector"]("text").alias("v"), own.alias("own"))
    return x.select("doc_id", F.array_join(F.transform("v", lambda n: n.cast("string")), " ").alias("vec"),
                    (F.col("v") == F.col("own")).alias("same"))

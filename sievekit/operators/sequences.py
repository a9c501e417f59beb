"""Token sequences: vocabulary, encoding, masking.

Everything is a DataFrame job: the vocabulary is a distributed distinct with
positions over range partitions, encoding explodes tokens with their position, joins the
vocabulary (AQE picks broadcast when it is small) and regroups per record —
each record only ever regroups its own tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_position

# Special tokens and their ids (vocabulary file order).
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
PAD, UNK, CLS, SEP, MASK = range(5)


def vocabulary(tokens: DataFrame, tok_col: str, min_freq: int = 1) -> DataFrame:
    """X6 + A24: specials first (ids 0–4), then tokens with at least
    ``min_freq`` occurrences in sorted order (ids from 5)."""
    t = (tokens.select(F.explode(tok_col).alias("token")).groupBy("token")
               .agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= min_freq))
    pos = global_position(t, ["token"])
    words = pos.select("token", (F.col("pos") + len(SPECIALS) - 1).cast("int").alias("token_id"))
    spark = tokens.sparkSession
    specials = spark.createDataFrame([(s, i) for i, s in enumerate(SPECIALS)], "token string, token_id int")
    return specials.unionByName(words)


def encode(records: DataFrame, keys: list[str], tok_col: str, vocab: DataFrame, max_length: int) -> DataFrame:
    """Tokens → ids (unknown → [UNK]), [CLS] … [SEP], truncate, pad with
    [PAD], attention mask.  Output keys + input_ids + attention_mask + n_tokens."""
    # only the tokens that truncation keeps travel; posexplode_outer keeps records without tokens (pos = NULL)
    ex = records.select(*keys, F.posexplode_outer(F.slice(tok_col, 1, max_length - 2)).alias("pos", "token"))
    j = ex.join(vocab, "token", "left").select(*keys, "pos", F.coalesce("token_id", F.lit(UNK)).alias("tid"))
    per = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "tid"))).alias("__s"))
    per = per.withColumn("__s", F.filter("__s", lambda s: s["pos"].isNotNull()))
    body = F.transform("__s", lambda s: s["tid"])
    ids = F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)))
    n = F.size(ids)
    padded = F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(max_length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return per.select(*keys, padded.alias("input_ids"), mask.alias("attention_mask"), n.alias("n_tokens"))


def mask_tokens(encoded: DataFrame, keys: list[str], seed: int = 42, threshold_hex: str = "2666") -> DataFrame:
    """Every non-special position is masked when
    md5(seed|keys|position) < threshold (0x2666/0x10000 ≈ 0.15).
    Seeded per (seed, record, position) — not one shared mask for all rows.
    Output: masked_ids, labels (original id where masked, −100 elsewhere), mask."""
    key_str = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])

    def is_masked(t: Column, i: Column) -> Column:
        h = F.substring(F.md5(F.concat(key_str, F.lit("|"), i.cast("string"))), 1, len(threshold_hex))
        maskable = t >= F.lit(len(SPECIALS))      # special ids, [UNK] among them, are never masked
        return maskable & (h < F.lit(threshold_hex))

    ids = F.col("input_ids")
    m = F.transform(ids, lambda t, i: is_masked(t, i))
    masked = F.zip_with(ids, m, lambda t, b: F.when(b, F.lit(MASK)).otherwise(t))
    labels = F.zip_with(ids, m, lambda t, b: F.when(b, t).otherwise(F.lit(-100)))
    return encoded.select(*keys, "input_ids", masked.alias("masked_ids"), labels.alias("labels"), m.alias("mask"))


def masked_accuracy(labels: Column, preds: Column) -> tuple[Column, Column]:
    """A20 state: (correct, masked) counts of one row; sum them, divide at the end."""
    pairs = F.arrays_zip(labels.alias("l"), preds.alias("p"))
    masked = F.size(F.filter(labels, lambda x: x != -100))
    correct = F.size(F.filter(pairs, lambda z: (z["l"] != -100) & (z["l"] == z["p"])))
    return correct, masked

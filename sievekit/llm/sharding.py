"""Operator 1: rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets its own draw u in (0, 1) from an MD5 digest, and a
record goes to the shard with the largest ``-weight / ln(u)``.  Shard k then
receives a share in proportion to its weight, and adding a shard moves only the
records which the new shard wins, all of them into it.

Cases: a null key is hashed as the empty string; repeated rows share a shard; an empty
table gives no rows; other columns are passed through, and ``out`` replaces a column
of that name.  One very common key lies in one shard by the law itself, while
the slots inside a shard are ranked by many tasks (``hash_ranks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .native import HEX_DIGITS, HEX_SPAN, hash_ranks, text_of
from .registry import query

N_SHARDS = 24


def _score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")))
    draw = (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / F.lit(HEX_SPAN)
    return F.lit(-float(weight)) / F.log(draw)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key; ties go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    best = [F.struct(_score(key, k, w).alias("s"), F.lit(-k).alias("k")) for k, w in enumerate(weights)]
    top = F.greatest(*best) if len(best) > 1 else best[0]
    return (-top["k"]).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Add the shard of each row; no shuffle."""
    return df.withColumn(out, rendezvous(F.col(key), weights))


@query("op1_rendezvous_shards", oracle=f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
draws AS (
  SELECT doc_id, k, -1.0 / ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || k::VARCHAR), 1, 13))::BIGINT + 0.5)
         / {HEX_SPAN}) AS s
  FROM d, range({N_SHARDS + 1}) t(k)),
best AS (
  SELECT doc_id, arg_max(k, s) FILTER (WHERE k < {N_SHARDS}) AS shard, arg_max(k, s) AS grown
  FROM draws GROUP BY doc_id),
hexed AS (SELECT doc_id, text, lower(hex(encode(text))) AS hx FROM d),
nibbles AS (
  SELECT doc_id, text, flatten(list_transform(regexp_extract_all(hx, '..'),
    lambda x: [('0x' || x[2])::BIGINT, ('0x' || x[1])::BIGINT])) AS n FROM hexed),
crcs AS (
  SELECT doc_id, strlen(text) + 8 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, n),
    lambda a, b: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108
      ][(xor(a, b) & 15) + 1]::BIGINT))) AS crc
  FROM nibbles),
j AS (SELECT *, (('0x' || substr(md5(doc_id::VARCHAR || ':' || crc::VARCHAR), 1, 13))::BIGINT)::DOUBLE / {HEX_SPAN} AS u
      FROM best JOIN crcs USING (doc_id))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY u, doc_id, crc) - 1 AS slot, grown::INTEGER AS grown_shard
FROM j
""")
def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of equal weight under the law ``key``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    narrow = docs.select(
        "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    narrow = assign(narrow, "doc_id", [1.0] * N_SHARDS)
    # one more shard either wins a record or leaves it where it is
    narrow = cut_lineage(assign(narrow, "doc_id", [1.0] * (N_SHARDS + 1), "grown_shard"))
    ranked = hash_ranks(narrow, ["shard"], ["doc_id", "text_crc32"], "slot", narrow.count())
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

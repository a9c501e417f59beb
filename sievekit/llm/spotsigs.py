"""Operator 7: document fingerprints by SpotSigs.

A signature is a common word (the anchor) with the ``CHAIN`` content words that
follow it, common words skipped.  A fingerprint is the set of a text's signatures,
written as their sorted 32-bit hashes in hex, so the likeness (Jaccard) of two
fingerprints can be worked out from the strings.  A text with words but without a
complete chain has one signature, of its whole word sequence.

``similar_pairs`` compares fingerprints: sets are partitioned by their length so that
only the same and the next partition can reach the threshold, a prefix of each
set nominates partners, and lengths prune before sets are intersected.  Copies are
reduced to one row per fingerprint before.

Cases: a null or empty text has no words and an empty fingerprint; two empty
fingerprints have likeness 1; equal texts have equal fingerprints; equal ids are
ordered by their text; a null id comes first; an empty table gives no rows; one
document alone is its own next; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .blocks import SLICE_BYTES, WINDOW_BASE, find_words, span_hashes, text_slices
from .registry import query

CHAIN = 2
BUCKETS_PER_PARTITION = 4

# fixed values: common words that anchor signatures, by language
ANCHORS = """
the of and to a in is that it for on was with be as at this by are from
de la le et les des en un du une que est pour qui dans au sur par pas
der die und den von zu das sich mit auf ist nicht im eine dem ein als
el del y los se las no con una para es su al lo
""".split()


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode("utf-8"), dtype=np.uint8)
    ends = np.cumsum([len(w.encode("utf-8")) for w in words])
    lo = ends - np.diff(np.concatenate([[0], ends]))
    return np.sort(find_words(data, np.append(lo, ends[-1]), lower=True).hashes())


_ANCHOR_HASHES = _word_hashes(sorted(set(ANCHORS)))


def signatures(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text."""
    out = []
    for a, b, data, offs in text_slices(texts):
        w = find_words(data, offs, lower=True)
        h = w.hashes()
        row = w.row
        place = np.minimum(np.searchsorted(_ANCHOR_HASHES, h), len(_ANCHOR_HASHES) - 1)
        common = _ANCHOR_HASHES[place] == h
        content = np.flatnonzero(~common)
        anchor = np.flatnonzero(common)
        # number of the first content word behind each anchor
        nxt = np.searchsorted(content, anchor)
        ok = nxt + chain <= len(content)
        ok[ok] = row[content[nxt[ok] + chain - 1]] == row[anchor[ok]]
        anchor, nxt = anchor[ok], nxt[ok]
        parts = np.stack([h[anchor], *[h[content[nxt + k]] for k in range(chain)]], axis=1)
        lo = np.arange(len(anchor)) * (chain + 1)
        sig = span_hashes(parts.ravel(), lo, lo + chain + 1, WINDOW_BASE) >> np.uint64(32)
        whole = span_hashes(h, w.first[:-1], w.first[1:], WINDOW_BASE) >> np.uint64(32)
        own = row[anchor]
        order = np.lexsort((sig, own))
        sig, own = sig[order].astype(np.uint32), own[order]
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[new], own[new]
        first = np.searchsorted(own, np.arange(b - a + 1))
        for k in range(b - a):
            mine = sig[first[k]:first[k + 1]]
            if not len(mine) and w.first[k + 1] > w.first[k]:
                mine = whole[k:k + 1].astype(np.uint32)
            out.append(mine)
    return out


def fingerprint(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two signature sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = signatures(batch.column("_t"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array([fingerprint(s) for s in sigs], pa.string()),
             pa.array([s.astype(np.int64) for s in sigs], pa.list_(pa.int64()))], names=["_id", "fingerprint", "signatures"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, signatures) of every row."""
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t"))
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(_fingerprint_rows, f"_id {kind}, fingerprint string, signatures array<long>") \
        .withColumnRenamed("_id", key)


def similar_pairs(found: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (key, rep) ties copies to one representative per fingerprint;
    pairs (a, b, likeness) are all representatives with a < b that reach the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    reps = found.groupBy("fingerprint").agg(F.min(key).alias("rep"), F.first("signatures").alias("signatures"))
    members = found.join(reps.select("fingerprint", "rep"), "fingerprint").select(key, "rep")
    sets = reps.filter(F.size("signatures") > 0).select("rep", "signatures", F.size("signatures").alias("n"))
    # partition p holds lengths in [t**-p, t**-(p + 1)): partners lie in p or p + 1
    span = math.log(1 / threshold) if threshold < 1 else 0.0
    part = F.floor(F.log("n") / F.lit(span) + 1e-9) if span else F.col("n").cast("long")
    sets = cut_lineage(sets.withColumn("part", part.cast("long")))
    heads = sets.select("rep", "n", "part", F.explode(F.expr(
        f"slice(signatures, 1, n - cast(ceil({threshold!r} * n - 1e-9) as int) + 1)")).alias("sig"))
    left = heads.select(F.col("rep").alias("a"), F.col("n").alias("na"), "part", "sig")
    reach = [0, 1] if span else [0]
    right = heads.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "sig", F.col("part").alias("pb"),
                         F.explode(F.array(*[F.col("part") - k for k in reach])).alias("part"))
    fits = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9
    near = left.join(right, ["part", "sig"]).filter((F.col("a") != F.col("b")) & fits) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sa = sets.select(F.col("rep").alias("a"), F.col("signatures").alias("sa"))
    sb = sets.select(F.col("rep").alias("b"), F.col("signatures").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = near.join(sa, "a").join(sb, "b").select(
        "a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness"))
    return members, pairs.filter(F.col("likeness") >= threshold - 1e-9)


def _route_rows(bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its id range, and the first row of a range also to the one before, as a successor."""
        low = -(1 << 63)
        last = len(bounds) - 1
        for batch in batches:
            ids = [low if x is None else x for x in batch.column("_id").to_pylist()]
            bucket = [bisect_right(bounds, x) - 1 for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array([0] * len(ids), pa.int32()), batch.column("_id"),
                 batch.column("_t")], names=["bucket", "turn", "_id", "_t"])
            head = [i for i, (x, k) in enumerate(zip(ids, bucket)) if bounds[k] == x]
            if head:
                at = pa.array(head, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket[i] - 1 if bucket[i] else last for i in head], pa.int32()),
                     pa.array([1] * len(head), pa.int32()), batch.column("_id").take(at), batch.column("_t").take(at)],
                    names=["bucket", "turn", "_id", "_t"])
    return run


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, turn, id, text): fingerprint each text, its edited text and its successor."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        mine = [(x, y) for x, y in zip(held, held[1:]) if x[0] == y[0] and x[1] == 0]
        texts = [t for _, _, _, t in held]
        edited = []
        for x, y in mine:
            h = len(x[3]) // 2
            edited.append(x[3][:len(x[3]) - h] + y[3][:h])
        sigs = signatures(pa.array(texts + edited, pa.large_string()))
        own = [i for i, (x, y) in enumerate(zip(held, held[1:])) if x[0] == y[0] and x[1] == 0]
        news = sigs[len(held):]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[2] for x, _ in mine], pa.int64()), pa.array([len(x[3]) for x, _ in mine], pa.int64()),
             pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
             pa.array([fingerprint(sigs[i]) for i in own], pa.string()),
             pa.array([fingerprint(s) for s in news], pa.string()),
             pa.array([likeness(sigs[i], s) for i, s in zip(own, news)], pa.float64()),
             pa.array([likeness(sigs[i], sigs[i + 1]) for i in own], pa.float64())],
            names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    size = 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "turn", "_id", "_t")]
        for row in zip(*cols):
            # a second successor of a range says nothing new
            if row[1] and held and held[-1][0] == row[0] and held[-1][1]:
                continue
            held.append(row)
            size += len(row[3])
            if size >= SLICE_BYTES and len(held) > 1:
                yield flush()
                held, size = held[-1:], 0
    if len(held) > 1:
        yield flush()


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, the text with its latter half replaced from the next id's text, and their likeness.

    Texts move once: id ranges are found on the ids alone, and every range also receives the first row of the
    range after it (the last one: of the first), so the next row is always at hand without a global window."""
    spark = docs.sparkSession
    # the bounds are one number per range: driver and closures hold nothing that grows with texts
    parts = BUCKETS_PER_PARTITION * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    low = F.lit(-(1 << 63)).cast("long")
    ids = docs.select(F.coalesce(F.col(key).cast("long"), low).alias("i")).repartitionByRange(parts, "i")
    bounds = sorted(r["lo"] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("i").alias("lo")).collect())
    source = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    dealt = (source.mapInArrow(_route_rows(bounds), "bucket int, turn int, _id long, _t string")
             .repartition("bucket").sortWithinPartitions("bucket", "turn", "_id", "_t"))
    return dealt.mapInArrow(
        _edit_rows, "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double").withColumnRenamed("_id", key)


@query("op7_spotsigs")
def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))

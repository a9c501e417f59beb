"""Operator 2: stupid-backoff scores of every document under the corpus.

The count table holds every word and every pair of neighbouring words of all documents,
partitioned by hash.  Documents are dealt to batches of bounded bytes; a batch explodes
its texts to n-grams and keeps one entry per distinct n-gram with its count, so a word
that a third of all places hold is sent once per batch.  Entries travel as blocks, one per
(hash partition, batch).  In a hash partition the blocks are summed to the
count table and joined back: every entry gets its total.  The totals return to their
batch, meet its n-grams there, and the logarithms are summed per document.

A document is scored by the rest of the corpus: its own counts are taken off.  With counts c
and N of the rest, the score of a word behind another is c(pair) / c(first word) if
the pair occurs there, else ``ALPHA`` times c(word) / N, with 1 / (N + 1) for a word
that does not occur there; the first word of a text has no factor ``ALPHA``.

Words are runs of non-space characters with A-Z lower-cased.

Cases: a null or empty text has n_words 0 and a null score; repeated rows are documents of
their own and count for each other; an empty table gives no rows; ids may repeat
or be null; extra columns do not matter, the result holds ``key`` and the columns it adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .blocks import WINDOW_BASE, find_words, mix, span_hashes, text_slices, windows
from .registry import query

ALPHA = 0.4
BATCH_BYTES = 8 << 20
LEAST_BATCH_BYTES = 1 << 20
ORDER = 2


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word key, pair key with the word before or 0, row, words per row) of every word, in order."""
    keys, pairs, rows, counts = [], [], [], []
    for a, _, data, offs in text_slices(texts):
        w = find_words(data, offs, lower=True)
        h = w.hashes()
        at, _ = windows(w, ORDER)
        pair = np.zeros(len(h), dtype=np.uint64)
        pair[at + 1] = span_hashes(h, at, at + ORDER, WINDOW_BASE) | np.uint64(1)
        keys.append(mix(h) & ~np.uint64(1))     # even keys are words, odd keys are pairs
        pairs.append(pair)
        rows.append(w.row + a)
        counts.append(w.counts)
    if not keys:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(pairs), np.concatenate(rows), np.concatenate(counts)


def _distinct(texts: pa.Array, parts: int):
    """Sorted distinct keys of a batch, their counts, the bounds of the hash partitions, and the n-grams."""
    word, pair, row, counts = _grams(texts)
    has = pair != 0
    keys, inverse, n = np.unique(np.concatenate([word, pair[has]]), return_inverse=True, return_counts=True)
    # a partition is a range of the key space, so it is a stretch of the sorted keys
    width = (1 << 64) // parts + 1
    bounds = np.searchsorted(keys, np.array([p * width for p in range(parts)], dtype=np.uint64))
    return keys, n, np.append(bounds, len(keys)), inverse, has, row, counts


def _planes(x: np.ndarray, width: int) -> bytes:
    """Integers as byte planes: the high planes are nearly constant and pack well."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unplanes(b: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _zip(x: np.ndarray, width: int) -> bytes:
    return pa.compress(_planes(x, width), codec="zstd", asbytes=True)


def _unzip(b: bytes, n: int, width: int) -> np.ndarray:
    return _unplanes(pa.decompress(b, decompressed_size=n * width, codec="zstd", asbytes=True), width)


def _keys_out(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)), 8)


def _keys_in(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, 8), dtype=np.uint64)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, compressed rows): the rows of one Arrow batch, by the batch that they are dealt to."""
    option = pa.ipc.IpcWriteOptions(compression="zstd")
    for rows in batches:
        to = rows.column("batch").to_numpy()
        order = np.argsort(to, kind="stable")
        rows, to = rows.take(pa.array(order)).drop_columns(["batch"]), to[order]
        edge = np.flatnonzero(np.diff(to, prepend=-1)).tolist() + [len(to)]
        out = []
        for a, b in zip(edge, edge[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=option) as w:
                w.write_batch(rows.slice(a, b - a))
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(to[edge[:-1]], pa.int32()), pa.array(out, pa.binary())],
                                         names=["batch", "rows"])


def _undeal(group: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in group.column("rows").to_pylist()])


def _size_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = words = 0
    for batch in batches:
        for _, _, data, offs in text_slices(batch.column("_t")):
            size += len(data)
            words += len(find_words(data, offs).lo)
    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([words], pa.int64())], names=["bytes", "words"])


def _request(parts: int):
    def run(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        keys, n, bounds, *_ = _distinct(_undeal(group).column("_t").combine_chunks(), parts)
        full = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
        return pa.table({
            "part": pa.array(full, pa.int32()), "batch": pa.array([batch] * len(full), pa.int32()),
            "keys": pa.array([_keys_out(keys[bounds[p]:bounds[p + 1]]) for p in full], pa.binary()),
            "counts": pa.array([_zip(n[bounds[p]:bounds[p + 1]], 8) for p in full], pa.binary())})
    return run


def _count(group: pa.Table) -> pa.Table:
    """Sum the blocks of one hash partition and give every entry its total."""
    keys = [_keys_in(x) for x in group.column("keys").to_pylist()]
    n = np.concatenate([_unzip(x, len(k), 8) for x, k in zip(group.column("counts").to_pylist(), keys)])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=n)[inverse].astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    return pa.table({
        "batch": group.column("batch"), "part": group.column("part"),
        "totals": pa.array([_zip(t, 8) for t in np.split(total, ends[:-1])], pa.binary())})


def _score(parts: int, n_corpus: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _undeal(docs)
        keys, _, bounds, inverse, has, row, counts = _distinct(docs.column("_t").combine_chunks(), parts)
        got = dict(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist()))
        total = np.concatenate([_unzip(got[p], bounds[p + 1] - bounds[p], 8) for p in sorted(got)]
                               or [np.zeros(0, "<u8")]).astype(np.float64)
        m = len(row)
        # counts of the other documents: totals less the document's own
        both = np.concatenate([row, row[has]]) * max(len(keys), 1) + inverse
        _, place, own = np.unique(both, return_inverse=True, return_counts=True)
        del both, got
        rest = total[inverse] - own[place]
        del place, own, inverse
        word = rest[:m]
        pair = np.zeros(m)
        pair[has] = rest[m:]
        others = (n_corpus - counts[row]).astype(np.float64)
        single = np.where(word > 0, word / np.maximum(others, 1), 1.0 / (others + 1))
        before = np.concatenate([[1.0], word[:-1]]) if m else word
        seen = pair > 0
        p = np.where(seen, pair / np.maximum(before, 1), np.where(has, ALPHA, 1.0) * single)
        logs = np.bincount(row, weights=np.log(p), minlength=len(counts))
        known = np.bincount(row, weights=seen, minlength=len(counts))
        score = [float(x) / int(c) if c else None for x, c in zip(logs, counts)]
        return pa.table({"_id": docs.column("_id"), "n_words": pa.array(counts, pa.int64()),
                         "n_seen_pairs": pa.array(known.astype(np.int64)), "score": pa.array(score, pa.float64())})
    return run


def backoff_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_seen_pairs, score): score is the mean natural logarithm per word."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t"))
    size = source.select("_t").mapInArrow(_size_rows, "bytes long, words long").agg(
        F.sum("bytes").alias("bytes"), F.sum("words").alias("words")).first()
    n_bytes, n_words = size["bytes"] or 0, size["words"] or 0
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = max(1, math.ceil(n_bytes / BATCH_BYTES), min(wide, math.ceil(n_bytes / LEAST_BATCH_BYTES)))
    parts = max(wide, batches)
    dealt = source.withColumn("batch", F.pmod(F.xxhash64("_id", "_t"), F.lit(batches)).cast("int")) \
        .mapInArrow(_deal, "batch int, rows binary")
    blocks = dealt.groupBy("batch").applyInArrow(
        _request(parts), "part int, batch int, keys binary, counts binary")
    answers = cut_lineage(blocks.groupBy("part").applyInArrow(_count, "batch int, part int, totals binary"))
    return (dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _score(parts, n_words), f"_id {kind}, n_words long, n_seen_pairs long, score double")
        .withColumnRenamed("_id", key))


@query("op2_stupid_backoff", oracle=rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
tok AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
c AS (
  SELECT *, count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY doc_id, b) AS cb,
         count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY doc_id, a, b) AS cab,
         count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n FROM tok),
ca AS (SELECT c.*, p.cb AS ca FROM c LEFT JOIN c p ON p.doc_id = c.doc_id AND p.i = c.i - 1),
s AS (SELECT doc_id, a IS NOT NULL AND cab > 0 AS seen,
        CASE WHEN a IS NOT NULL AND cab > 0 THEN cab / ca
             ELSE CASE WHEN a IS NULL THEN 1.0 ELSE {ALPHA}::DOUBLE END
                  * CASE WHEN cb > 0 THEN cb / n ELSE 1 / (n + 1) END END AS p FROM ca),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE seen) AS n_seen, avg(ln(p)) AS score FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_seen, 0)::BIGINT AS n_seen_pairs,
       round(score, 6) AS score
FROM documents LEFT JOIN g USING (doc_id)
""")
def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the rest of the corpus."""
    return backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Operator 9: substring dedup by difference-cover anchors.

A passage is a window of ``window`` consecutive words.  D is a difference cover
modulo ``period``: for any two positions some shift below the period brings
both into D.  Hashing the (window - period + 1)-word stretches that begin at
cover positions only (6 of 31) is therefore enough: two equal windows always
contain one stretch that is indexed at both places.

1. Rows with equal word sequences are reduced to the smallest id.  The others
   lose all words if they have a whole window, else none.
2. Stretches at cover positions -> (hash, smallest and largest sequence hash); those
   of two different word sequences are shared anchors.
3. A join brings each document its anchors; they extend to the windows around
   them, which are hashed and reduced to the smallest id per window.
4. A join returns the windows that start in a smaller document; the words they
   cover are removed.

Each reduction is a partial aggregate, so a passage that a third of all
documents share leaves a map task once, and the joins back are on written
tables, which Spark splits when a key is skewed.  No pair of documents is ever
formed.  Anchors are 64-bit hashes and only nominate; windows are judged by 96 bits.

Cases: a null or empty text has no words and keeps nothing; ids are integers;
rows with an equal id are judged against smaller ids only, and each is returned by its own text
(rows are told apart by id and a hash of the text); a
null id is smaller than none and larger than none, so such rows are kept whole;
an empty table gives no rows; other columns are passed through, those named like the
results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .blocks import WINDOW_BASE, WINDOW_BASE_2, Words, find_words, signed, span_hashes, text_slices, windows
from .registry import query

WINDOW = 50
PERIOD = 31


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues whose differences give all residues."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
        size += 1


def _sequence_hash(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = words.first[:-1], words.first[1:]
    return span_hashes(h, a, b, WINDOW_BASE), span_hashes(h, a, b, WINDOW_BASE_2)


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) of some start."""
    step = np.zeros(n + length + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step)[:n] > 0


def _is_copy(s1: np.ndarray, lists) -> list[bool]:
    """Whether each row's sequence hash is in its list of copied sequences."""
    return [x is not None and int(s) in x for s, x in zip(signed(s1), lists)]


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text hash, n_words, hash of the word sequence) per row."""
    for batch in batches:
        for a, b, data, offs in text_slices(batch.column("_t")):
            w = find_words(data, offs)
            s1, s2 = _sequence_hash(w, w.hashes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").slice(a, b - a), batch.column("_x").slice(a, b - a),
                 pa.array(w.counts.astype(np.int64)), pa.array(signed(s1)), pa.array(signed(s2))],
                names=["_id", "_x", "n_words", "s1", "s2"])


def _anchor_rows(period: int, window: int):
    cover = difference_cover(period)
    at_cover = np.zeros(period, dtype=bool)
    at_cover[cover] = True
    q = window - period + 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, id, text hash, position, sequence) at cover positions of rows that have a whole window."""
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column("_t")):
                w = find_words(data, offs)
                at, row = windows(w, q)
                pos = at - w.first[row]
                ok = at_cover[pos % period] & (w.counts[row] >= window)
                at, row, pos = at[ok], row[ok], pos[ok]
                words = w.hashes()
                h = span_hashes(words, at, at + q, WINDOW_BASE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)), batch.column("_id").slice(a, b - a).take(pa.array(row)),
                     batch.column("_x").slice(a, b - a).take(pa.array(row)),
                     pa.array(pos.astype(np.int32)), pa.array(signed(_sequence_hash(w, words)[0])[row])],
                    names=["h", "_id", "_x", "pos", "s1"])
    return anchors


def _near_windows(w: Words, h: np.ndarray, lists, window: int, period: int):
    """Starts (slice-wide), rows and hashes of the windows that contain one of a row's anchors."""
    at, row = windows(w, window)
    seed = np.zeros(len(h) + 1, dtype=np.int64)
    counts = np.fromiter((0 if x is None else len(x) for x in lists), dtype=np.int64, count=len(lists))
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists if x is not None] or [np.zeros(0, np.int64)])
    place = flat + np.repeat(w.first[:-1], counts)
    # a window that starts up to period - 1 words before the anchor holds it whole
    np.add.at(seed, np.maximum(place - (period - 1), 0), 1)
    np.add.at(seed, place + 1, -1)
    near = np.cumsum(seed)[at] > 0
    at, row = at[near], row[near]
    return at, row, span_hashes(h, at, at + window, WINDOW_BASE), \
        (span_hashes(h, at, at + window, WINDOW_BASE_2) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _window_rows(window: int, period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(window hash, id, text hash), once per row and window."""
        for batch in batches:
            lists = batch.column("_at").to_numpy(zero_copy_only=False)
            copies = batch.column("_copy").to_numpy(zero_copy_only=False)
            for a, b, data, offs in text_slices(batch.column("_t")):
                w = find_words(data, offs)
                h = w.hashes()
                copied = _is_copy(_sequence_hash(w, h)[0], copies[a:b])
                mine = [None if c else x for x, c in zip(lists[a:b], copied)]
                _, row, w1, w2 = _near_windows(w, h, mine, window, period)
                order = np.lexsort((w1, row))
                row, w1, w2 = row[order], w1[order], w2[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (w1[1:] != w1[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(w1[new])), pa.array(w2[new]),
                     batch.column("_id").slice(a, b - a).take(pa.array(row[new])),
                     batch.column("_x").slice(a, b - a).take(pa.array(row[new]))], names=["w1", "w2", "_id", "_x"])
    return run


def _cut_rows(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Remove the words covered by the windows listed in ``_drop``; ``_copy`` lists copied sequences."""
        for batch in batches:
            lists = batch.column("_drop").to_numpy(zero_copy_only=False)
            copy = batch.column("_copy").to_numpy(zero_copy_only=False)
            for a, b, data, offs in text_slices(batch.column("_t")):
                w = find_words(data, offs)
                h = w.hashes()
                copied = _is_copy(_sequence_hash(w, h)[0], copy[a:b])
                gone = np.zeros(len(w.lo), dtype=bool)
                mine = [x for x in lists[a:b] if x is not None and len(x)]
                if mine:
                    at, row = windows(w, window)
                    has = np.fromiter((x is not None and len(x) > 0 for x in lists[a:b]), bool, count=b - a)
                    at, row = at[has[row]], row[has[row]]
                    wh = signed(span_hashes(h, at, at + window, WINDOW_BASE))
                    first = np.searchsorted(row, np.arange(b - a + 1))
                    hit = [at[first[k]:first[k + 1]][np.isin(wh[first[k]:first[k + 1]], np.asarray(lists[a + k]))]
                           for k in np.flatnonzero(has)]
                    gone = _covered(len(w.lo), np.concatenate(hit), window)
                raw, texts, removed = w.data.tobytes(), [], []
                for k in range(b - a):
                    f, g = int(w.first[k]), int(w.first[k + 1])
                    if copied[k]:
                        texts.append("")
                        removed.append(g - f)
                        continue
                    removed.append(int(gone[f:g].sum()))
                    if not removed[-1]:
                        texts.append(raw[offs[k]:offs[k + 1]].decode("utf-8"))
                    else:
                        texts.append(b" ".join(raw[w.lo[i]:w.hi[i]] for i in range(f, g) if not gone[i]).decode("utf-8"))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array(w.counts.astype(np.int64)),
                     pa.array(removed, pa.int64()), pa.array(texts, pa.string()),
                     pa.array([hashlib.sha256(b" ".join(t.encode("utf-8").split())).hexdigest() for t in texts],
                              pa.string())],
                    names=[*names, "n_words", "n_removed", "kept_text", "kept_sha256"])
    return run


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """The columns other than the text, with n_words, n_removed, kept_text and kept_sha256.

    kept_text is the text where nothing is removed, else the kept words joined by one space;
    kept_sha256 is always of the kept words joined by one space."""
    if not 1 <= period <= window:
        raise ValueError("the period lies between 1 and the window")
    added = {"n_words", "n_removed", "kept_text", "kept_sha256"}
    names = [c for c in docs.columns if c not in {*added, text}]
    source = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"),
                         F.xxhash64(text).alias("_x"))

    sequences = cut_lineage(source.mapInArrow(_sequences, "_id long, _x long, n_words long, s1 long, s2 long"))
    long_ones = sequences.filter((F.col("n_words") >= window) & F.col("_id").isNotNull())
    firsts = cut_lineage(long_ones.groupBy("s1", "s2").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
                         .filter("_n > 1").select("s1", "s2", "_least"))
    copies = cut_lineage(long_ones.join(firsts, ["s1", "s2"]).filter("_id > _least")
                         .groupBy("_id", "_x").agg(F.collect_set("s1").alias("_copy")))

    spots = source.filter("_id is not null").mapInArrow(
        _anchor_rows(period, window), "h long, _id long, _x long, pos int, s1 long")
    shared = cut_lineage(spots.groupBy("h").agg(F.min("s1").alias("_lo"), F.max("s1").alias("_hi"))
                         .filter("_lo < _hi").select("h"))
    places = (spots.join(shared, "h").select("_id", "_x", "pos")
              .groupBy("_id", "_x").agg(F.sort_array(F.collect_set("pos")).alias("_at")))
    places = cut_lineage(places.join(copies, ["_id", "_x"], "left"))
    stretches = cut_lineage(source.join(places, ["_id", "_x"]).mapInArrow(
        _window_rows(window, period), "w1 long, w2 int, _id long, _x long"))
    least = cut_lineage(stretches.groupBy("w1", "w2").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
                        .filter("_lo < _hi").select("w1", "w2", "_lo"))
    drops = (stretches.join(least, ["w1", "w2"]).filter("_id > _lo")
             .groupBy("_id", "_x").agg(F.collect_set("w1").alias("_drop")))
    marks = cut_lineage(drops.join(copies, ["_id", "_x"], "full")
                        .select(F.col("_id").alias("_mark"), F.col("_x").alias("_mark_x"), "_drop", "_copy"))
    marked = (docs.select(*names, F.col(text).alias("_t"), F.col(key).cast("long").alias("_k"),
                          F.xxhash64(text).alias("_x"))
              .join(marks, (F.col("_k") == F.col("_mark")) & (F.col("_x") == F.col("_mark_x")), "left")
              .select(*names, "_t", "_drop", "_copy"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return marked.mapInArrow(
        _cut_rows(window, names), f"{fields}, n_words long, n_removed long, kept_text string, kept_sha256 string")


@query("op9_substring_dedup", oracle=rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range({WINDOW}) t(k)),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1),
word AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone
         ON word.doc_id = gone.doc_id AND word.i = gone.p GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-word passages of all documents, kept in the smallest doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")

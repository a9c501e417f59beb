"""Operator 12: document quality by random Fourier features, ridge scores and isotonic calibration.

1. One pass over the whole texts gives ``len(STATS)`` statistics per row (lengths, character-class
   shares, repetition of words and lines), written without the texts.  Nothing else is an input.
2. Statistics are centred and scaled by their training mean and deviation and clipped, then mapped
   to ``FEATURES`` random cosines whose inner products approximate a Gaussian kernel.
3. Every training partition sums its normal equations, once per fold (folds by text hash, so
   copies share one).  Partial sums meet in groups of ``FAN`` partitions, cell by cell; the driver gets
   FOLDS x FEATURES^2 / 2 numbers whatever the input.  The training sums of a fold are the total
   minus the fold, so the ridge penalty is chosen, and out-of-fold scores are made, without a second pass over texts.
4. Out-of-fold scores on a grid of 1/``GRID`` with their label sums are pooled by adjacent
   violators into a monotone curve (the counts are the input of the fit, so it covers all training rows);
   a document's score is the curve, level on a pool and linear between pools, at its ridge score,
   with a share of ``ORDER`` of the ridge score so that a pool keeps its order.

Cases: a null text counts as empty, and an empty text has a score as any other; label rows with a null
document or quality teach nothing; several labels of one document count as their mean; rows that
share a doc_id share its label; with no labels every score is 0.5, with one class that class's share;
an empty table gives no rows; equal texts share a score; other columns pass, those named like the results
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .blocks import find_words, mix, text_slices
from .registry import query

STATS = ["bytes", "words", "word_bytes", "longest", "symbol", "shout", "other_punct", "upper", "digit", "wide", "space",
         "line_words", "distinct_words", "stutter", "most_common", "bare_words", "distinct_lines", "ends"]
FEATURES = 128
WIDTH = 3.0          # of the Gaussian, in deviations over all statistics
CLIP = 4.0
FOLDS = 4
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)      # per training row
GRID = 512
FAN = 32             # partitions whose sums meet in one task
SEED = 12
ORDER = 0.01         # share of the ridge score itself, which orders the rows of one pool
THRESHOLD = 0.3
ADDED = ("score", "predicted")

# classes of bytes: 0 lower case and the rest, then symbol, shout, other punctuation, upper, digit, wide, space
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[ord(c) for c in "!\"'()+,-./:;=?@[\\]^_`{}~"]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[ord("!")] = 2
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[128:] = 6
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 7
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def _per_row(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the most common key) per row."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    both = mix(key ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    sorted_keys = both[order]
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    at = row[order[first]]
    most = np.zeros(n)
    np.maximum.at(most, at, np.diff(np.r_[first, len(both)]))
    return np.bincount(at, minlength=n).astype(float), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x statistics of a slice of whole texts."""
    n = len(offs) - 1
    size = np.diff(offs)
    row = np.repeat(np.arange(n), size)
    shares = np.bincount(row * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8) / np.maximum(size, 1)[:, None]
    words = find_words(data, offs)
    counts, of, long = words.counts, words.row, words.hi - words.lo
    per = np.maximum(counts, 1)
    keys = words.hashes()
    distinct, most = _per_row(of, keys, n)
    same = (keys[1:] == keys[:-1]) & (of[1:] == of[:-1]) if len(keys) > 1 else np.zeros(0, bool)
    stutter = np.bincount(of[1:][same], minlength=n) if len(keys) > 1 else np.zeros(n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, long)
    letter = np.r_[0, np.cumsum((_CLASS[data] == 0) | (_CLASS[data] == 4) | (_CLASS[data] == 6))]
    bare = np.bincount(of[letter[words.hi] == letter[words.lo]], minlength=n)
    ends = np.bincount(of[_ENDS[data[words.hi - 1]]], minlength=n)
    # a line is the hashes of its words, summed; its words are told apart by their place in it
    line = np.r_[0, np.cumsum(data == 10)][words.lo] if len(keys) else np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (of[1:] != of[:-1])]) if len(keys) else np.zeros(0, np.int64)
    if len(keys):
        place = np.arange(len(keys)) - np.repeat(start, np.diff(np.r_[start, len(keys)]))
        sums = np.add.reduceat(mix(keys + place.astype(np.uint64)), start)
        lines = np.bincount(of[start], minlength=n)
        distinct_lines, _ = _per_row(of[start], sums, n)
    else:
        lines, distinct_lines = np.zeros(n), np.zeros(n)
    return np.column_stack([
        np.log1p(size), np.log1p(counts), np.bincount(of, weights=long, minlength=n) / per, np.log1p(longest),
        *shares[:, 1:].T, np.log1p(counts / np.maximum(lines, 1)), distinct / per, stutter / per, most / per, bare / per,
        distinct_lines / np.maximum(lines, 1), ends / per])


def _measure(names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(text)):
                found = statistics(data, offs)
                part = batch.slice(a, b - a)
                flat = pa.array(found.ravel())
                stats = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(STATS)), flat)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], stats], names=[*names, "_stats"])
    return run


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``_stats`` and ``_fold``; one pass, no shuffle."""
    names = [c for c in docs.columns if c not in (text, "_stats", "_fold", *ADDED)]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in names)
    fold = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(FOLDS)).cast("int")
    return docs.select(*names, fold.alias("_fold"), text).mapInArrow(
        _measure([*names, "_fold"], text), f"{fields}_fold int, _stats array<double>")


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray        # FEATURES + 1, the last one the intercept
    knots: np.ndarray          # ridge scores, ascending
    values: np.ndarray         # calibrated scores at the knots

    def score(self, stats: np.ndarray) -> np.ndarray:
        ridge = fourier(stats, self.mean, self.scale) @ self.weights
        return (1 - ORDER) * np.interp(ridge, self.knots, self.values) + ORDER * np.clip((ridge + 1) / 3, 0, 1)


def _directions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((len(STATS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows x (FEATURES + 1): inner products of rows approach exp(-|x - y|^2 / 2 WIDTH^2); the last column is 1."""
    w, shift = _directions()
    x = np.clip((stats - mean) / scale, -CLIP, CLIP)
    z = np.sqrt(2 / FEATURES) * np.cos(x @ w + shift)
    return np.column_stack([z, np.ones(len(z))])


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATS))


_UPPER = np.triu_indices(FEATURES + 1)


def _normal_equations(mean: np.ndarray, scale: np.ndarray):
    """Per fold the upper half of Z'Z, then Z'y, then y'y, as one vector per partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            stats, fold, y = _stack(b.column("_stats")), b.column("_fold").to_numpy(), b.column("_y").to_numpy()
            z = fourier(stats, mean, scale)
            for k in np.unique(fold):
                zk, yk = z[fold == k], y[fold == k]
                sums[int(k)] = sums.get(int(k), 0) + np.concatenate([(zk.T @ zk)[_UPPER], zk.T @ yk, [yk @ yk]])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         names=["fold", "sums"])
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column("fold").to_pylist(), b.column("sums").to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(raw)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                     names=["fold", "sums"])


def _fold_sums(train: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """Sums per fold; tasks add FAN partitions' vectors at a time until at most FAN vectors a fold are left."""
    parts = train.select("_stats", "_fold", "_y").mapInArrow(_normal_equations(mean, scale), "fold int, sums binary")
    parts = cut_lineage(parts.withColumn("_part", F.spark_partition_id()))
    while True:
        top = parts.agg(F.max("_part")).first()[0]
        if top is None or top < FAN:
            break
        groups = top // FAN + 1
        parts = cut_lineage(parts.withColumn("_part", F.floor(F.col("_part") / FAN).cast("int"))
                            .repartition(groups, "_part").select("fold", "sums").mapInArrow(_add_up, "fold int, sums binary")
                            .withColumn("_part", F.spark_partition_id()))
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        out[r["fold"]] = out.get(r["fold"], 0) + np.frombuffer(bytes(r["sums"]))
    return out


def _unpack(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    d, half = FEATURES + 1, len(_UPPER[0])
    a = np.zeros((d, d))
    a[_UPPER] = sums[:half]
    return a + np.triu(a, 1).T, sums[half:half + d], float(sums[-1])


def _ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    a, b, _ = _unpack(sums)
    n = a[-1, -1]
    ridge = penalty * max(n, 1.0) * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9 * max(n, 1.0)
    return np.linalg.solve(a + ridge, b)


def _error(sums: np.ndarray, w: np.ndarray) -> float:
    a, b, yy = _unpack(sums)
    return float(yy - 2 * w @ b + w @ a @ w)


def isotonic(x: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: (both ends of every pool, its value at each), values not descending."""
    pools: list[tuple] = []
    for xi, w, t in zip(x, weight, total):
        pool = (xi, xi, w, t)
        while pools and pools[-1][3] * pool[2] >= pool[3] * pools[-1][2]:
            low = pools.pop()
            pool = (low[0], pool[1], low[2] + pool[2], low[3] + pool[3])
        pools.append(pool)
    ends = [(end, p[3] / p[2]) for p in pools for end in sorted({p[0], p[1]})]
    return np.array([e[0] for e in ends], dtype=float), np.array([e[1] for e in ends], dtype=float)


def _ridge_bins(mean: np.ndarray, scale: np.ndarray, weights: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, fold = fourier(_stack(b.column("_stats")), mean, scale), b.column("_fold").to_numpy()
            s = np.zeros(len(fold))
            for k, w in weights.items():
                s[fold == k] = z[fold == k] @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(s, -1, 2) * GRID).astype(np.int32)), b.column("_y")],
                                             names=["bin", "y"])
    return run


def fit(train: DataFrame) -> Model | None:
    """Model from rows (_stats, _fold, _y), read three times; None without rows."""
    moments = train.agg(F.count(F.lit(1)).alias("n"), *[
        f(F.col("_stats")[k]).alias(f"{name}{k}") for k in range(len(STATS)) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m{k}"] for k in range(len(STATS))])
    scale = np.array([moments[f"s{k}"] for k in range(len(STATS))])
    scale = np.where(scale > 1e-9, scale, 1.0)
    sums = _fold_sums(train, mean, scale)
    total = sum(sums.values())
    rest = {k: total - v if len(sums) > 1 else total for k, v in sums.items()}
    penalty = min(PENALTIES, key=lambda p: sum(_error(v, _ridge(rest[k], p)) for k, v in sums.items()))
    weights = {k: _ridge(v, penalty) for k, v in rest.items()}
    bins = train.select("_stats", "_fold", "_y").mapInArrow(_ridge_bins(mean, scale, weights), "bin int, y double") \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()   # at most 3 x GRID + 1
    bins.sort(key=lambda r: r["bin"])
    knots, values = isotonic(np.array([r["bin"] / GRID for r in bins]), np.array([float(r["n"]) for r in bins]),
                             np.array([r["y"] for r in bins]))
    return Model(mean, scale, _ridge(total, penalty), knots, np.clip(values, 0, 1))


def _scores(model: Model | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_stack(b.column("_stats"))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(s, pa.float64())], names=[*names, "score"])
    return run


def predict(measured: DataFrame, model: Model | None) -> DataFrame:
    """Add score and predicted to ``measure``'s rows; the statistics go."""
    names = [c for c in measured.columns if c not in ("_stats", "_fold")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in measured.schema.fields if f.name in names)
    found = measured.select(*names, "_stats").mapInArrow(_scores(model, names), f"{fields}score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def with_labels(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Rows that have a label, with its mean as ``_y``."""
    y = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_l")).filter("_key is not null and _l is not null") \
        .groupBy("_key").agg(F.avg("_l").alias("_y"))
    return measured.join(y, F.col(key) == F.col("_key")).drop("_key")


def held_out(key: str = "doc_id") -> Column:
    """The fifth of the documents whose labels are not learned."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """held_out, score and predicted for every row of ``docs``, learned from the labels of the others."""
    measured = cut_lineage(measure(docs.drop("held_out").withColumn("held_out", held_out(key))))
    train = cut_lineage(with_labels(measured.filter("not held_out").select(key, "_stats", "_fold"), labels, key, label)
                        .select("_stats", "_fold", "_y"))
    return predict(measured, fit(train))


@query("op12_fourier_quality")
def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")

"""Operator 3: language identification by error-correcting output codes.

Each learned language has a codeword of +1/-1 bits.  One binary n-gram
classifier per bit (log odds of hashed byte trigrams between the languages with
and without that bit) predicts the bit; loss-weighted decoding sums exp(-bit * margin)
over the bits, each weighted by how well its classifier separates the languages,
and picks the codeword of least loss.  A small lead over the second codeword
flags the text as ambiguous.

Training is a sum of trigram counts per language over all training rows: each task
sends one count vector per language, and the driver receives languages x buckets
numbers.  Texts are scored whole.

Cases: a null text or one without a letter is ``und`` with score 0; rows with a null
language teach nothing; with no labelled row every text is ``und``; with a single
language every text with a letter gets it; repeated rows count as often as they stand;
ties go to the language that sorts first; an empty table gives no rows; other
columns pass, those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .blocks import text_slices
from .registry import query

BUCKETS = 1 << 12
UNKNOWN = "und"
AMBIGUOUS_LEAD = 0.05
SHARPNESS = 4.0
MANY = 6
LONG_CODE = 8
ADDED = ("lang_pred", "score", "ambiguous")

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the byte trigrams of folded letters; none has a gap in its middle or spans rows."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _FOLD[data]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    ok = (c[1:-1] != 32) & ((c[:-2] != 32) | (c[2:] != 32)) & (row[:-2] == row[2:])
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    bucket = (code * np.uint32(2654435769)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket[ok].astype(np.int64), row[:-2][ok]


def codewords(n: int) -> np.ndarray:
    """n x bits matrix of +1/-1: every split of the languages while they are few, else the
    balanced random code with the largest least distance among seeded draws."""
    if n < 2:
        return np.ones((n, 1))
    if n <= MANY:
        splits = [s for k in range(n - 1) for s in combinations(range(1, n), k)]
        return np.stack([np.where(np.isin(np.arange(n), (0, *s)), 1.0, -1.0) for s in splits], axis=1)
    rng, bits, best, code = np.random.default_rng(7), LONG_CODE * n.bit_length(), -1, None
    for _ in range(64):
        m = np.sign(rng.permuted(np.tile(np.where(np.arange(n) % 2, 1.0, -1.0)[:, None], (1, bits)), axis=0))
        far = (m @ m.T)[np.triu_indices(n, 1)]
        if (gap := int(bits - far.max())) > best:
            best, code = gap, m
    return code


class Model:
    """Languages, codewords, trigram weights per bit, and the scale and weight of each bit."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        if not self.langs:
            return
        share = np.stack([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in self.langs])
        bits = []
        for b in range(self.code.shape[1]):
            yes = self.code[:, b] > 0
            bits.append(np.log(share[yes].mean(axis=0)) - np.log(share[~yes].mean(axis=0)) if (~yes).any()
                        else np.zeros(BUCKETS))
        self.bits = np.stack(bits)
        margin = (share @ self.bits.T) * self.code        # expected signed margin per language and bit
        self.scale = np.maximum(np.abs(margin).mean(axis=0), 1e-9)
        quality = np.clip(margin.min(axis=0) / self.scale, 0.05, None)
        self.weight = quality / quality.sum()

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, lead over the second codeword) of rows of mean bit margins."""
        z = np.clip(margins / self.scale, -4, 4)
        loss = np.exp(-z[:, None, :] * self.code[None]) @ self.weight
        best = loss.argmin(axis=1)
        p = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        p = p / p.sum(axis=1, keepdims=True)
        if loss.shape[1] < 2:
            return best, np.ones(len(best)), np.full(len(best), np.inf)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, p[np.arange(len(best)), best], two[:, 1] - two[:, 0]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.asarray(batch.column("_lang").to_pylist(), dtype=object)
        for a, b, data, offs in text_slices(batch.column("_t")):
            bucket, row = trigrams(data, offs)
            for lang in set(langs[a:b]):
                mine = bucket[(langs[a:b] == lang)[row]]
                total[lang] = total.get(lang, 0) + np.bincount(mine, minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
            names=["_lang", "bucket", "n"])


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Fit on every row with a text and a language."""
    known = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_t")).filter("_lang is not null and _t is not null")
    rows = (known.mapInArrow(_count_rows, "_lang string, bucket int, n long")
            .groupBy("_lang", "bucket").agg(F.sum("n").alias("n"))
            .groupBy("_lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect())
    counts = {}
    for r in rows:
        counts[r["_lang"]] = v = np.zeros(BUCKETS)
        for bucket, n in r["c"]:
            v[bucket] = n
    return Model(counts)


def _predict_rows(model: Model, names: list[str], lead: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(text)):
                n = b - a
                bucket, row = trigrams(data, offs)
                grams = np.bincount(row, minlength=n)
                letter = np.zeros(n, dtype=bool)
                ascii_letter = (_FOLD[data] >= 97) & (data < 128)
                full = np.flatnonzero(np.diff(offs))
                if len(full):
                    letter[full] = np.add.reduceat(ascii_letter.astype(np.int64), offs[full]) > 0
                for k in full[~letter[full]]:
                    letter[k] = any(ch.isalpha() for ch in data[offs[k]:offs[k + 1]].tobytes().decode("utf-8"))
                pred, score, doubt = [UNKNOWN] * n, np.zeros(n), np.ones(n, dtype=bool)
                if model.langs:
                    margins = np.stack([np.bincount(row, weights=w[bucket], minlength=n) for w in model.bits], axis=1)
                    margins = margins / np.maximum(grams, 1)[:, None]
                    best, p, ahead = model.decode(margins)
                    for k in np.flatnonzero(letter):
                        pred[k], score[k], doubt[k] = model.langs[best[k]], p[k], ahead[k] < lead
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(pred, pa.string()), pa.array(score), pa.array(doubt)],
                    names=[*names, *ADDED])
    return run


def predict(docs: DataFrame, model: Model, text: str = "text", lead: float = AMBIGUOUS_LEAD,
            keep_text: bool = True) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous; only the text is looked at."""
    names = [c for c in docs.columns if c not in ADDED and (keep_text or c != text)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return docs.select(*names, *([] if keep_text else [text])).mapInArrow(
        _predict_rows(model, names, lead, text), f"{fields}, lang_pred string, score double, ambiguous boolean")


def held_out(key: str = "doc_id") -> Column:
    """The quarter of the documents that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@query("op3_ecoc_language")
def op3_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from the documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")

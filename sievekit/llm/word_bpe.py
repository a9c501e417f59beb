"""Operator 8: BPE encoding and decoding over a distinct-word table.

A text's ids are the ids of its words one after another, because no merge and
no normalisation step of the vocabulary reaches over white space.  Each task keeps a
table of the distinct words that it has met: a new word is encoded once by the
tokenizers library, its ids are decoded through the id-to-piece table, and the texts are put
together by position from table slots.  Words are found and told apart by vectorised hashes.

The table stays with its task: a global word table joined back by (document, word,
position) moves several times the input through the shuffle (figures in the README),
while this plan shuffles nothing and loses at most one task with an executor.
``TABLE_WORDS`` only bounds the memory of the table, which is then started anew;
results do not depend on it.

Cases: a null or empty text has no ids; strings of special tokens inside a text
are encoded as the library does; repeated rows are encoded alike; an empty table
gives no rows; other columns pass, those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .blocks import Words, find_words, text_slices
from .registry import query

TABLE_WORDS = 400_000
CHUNK_BYTES = 2 << 20
ENCODE_WORDS = 4096
ADDED = ("n_tokens", "ids", "decoded")

_tokenizers: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file without truncation and padding, loaded once per worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _tokenizers[path] = tok
    return _tokenizers[path]


def encode_words(tok, words: list[bytes]) -> list[list[int]]:
    """Ids of each word; encodings, which are large, live for one block only."""
    out = []
    for a in range(0, len(words), ENCODE_WORDS):
        block = [w.decode("utf-8") for w in words[a:a + ENCODE_WORDS]]
        out += [e.ids for e in tok.encode_batch(block, add_special_tokens=False)]
    return out


def distinct(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(hashes, bytes, slot of every word) of the distinct words of a slice."""
    values, first, slot = np.unique(hashes, return_index=True, return_inverse=True)
    raw, lo, hi = words.data.tobytes(), words.lo[first].tolist(), words.hi[first].tolist()
    return values, [raw[a:b] for a, b in zip(lo, hi)], slot


class WordTable:
    """Distinct word -> (number of ids, ids as text, pieces as text)."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.pieces = {i: p for p, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.slots: dict[bytes, int] = {}
        self.n: list[int] = []
        self.ids: list[str] = []
        self.decoded: list[str] = []

    def lookup(self, words: list[bytes]) -> list[int]:
        if len(self.slots) > TABLE_WORDS:
            self.slots, self.n, self.ids, self.decoded = {}, [], [], []
        new = [w for w in words if w not in self.slots]
        if new:
            for w, ids in zip(new, encode_words(self.tok, new)):
                self.slots[w] = len(self.n)
                self.n.append(len(ids))
                self.ids.append(" ".join(map(str, ids)))
                self.decoded.append(" ".join([self.pieces[i] for i in ids]))
        return [self.slots[w] for w in words]


_tables: dict[str, WordTable] = {}


def _encode_rows(path: str, names: list[str], digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tables.setdefault(path, WordTable(path)) if path not in _tables else _tables[path]
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column("_t"), CHUNK_BYTES):
                w = find_words(data, offs)
                _, words, slot = distinct(w, w.hashes())
                at = np.asarray(known.lookup(words), dtype=np.int64)[slot].tolist() if words else []
                n, ids, texts = [], [], []
                for k in range(b - a):
                    mine = [s for s in at[w.first[k]:w.first[k + 1]] if known.n[s]]
                    n.append(sum([known.n[s] for s in mine]))
                    ids.append(" ".join([known.ids[s] for s in mine]))
                    texts.append(" ".join([known.decoded[s] for s in mine]))
                if digests:
                    ids, texts = ([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in xs] for xs in (ids, texts))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(texts, pa.string())], names=[*names, *ADDED])
    return run


def encode(docs: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """Add n_tokens, ids (decimal, joined by a space) and decoded; with ``digests`` their SHA-256."""
    names = [c for c in docs.columns if c not in {*ADDED, text}]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    head = f"{fields}, " if fields else ""
    return docs.select(*names, F.col(text).alias("_t")).mapInArrow(
        _encode_rows(path, names, digests), f"{head}n_tokens long, ids string, decoded string")


@query("op8_word_bpe")
def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))

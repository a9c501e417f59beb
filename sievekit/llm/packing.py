"""Operator 5: best-fit packing by a configuration linear program.

Only the length histogram (at most ``capacity`` numbers) is packed.  A
configuration is a multiset of lengths that fits one sequence.  The program
"fewest configurations that cover the histogram" is solved by multiplicative
weights: every round a knapsack dynamic program prices configurations, the (fractional)
solution takes as much of them as the unserved demand allows, and the lengths in them
lose price in proportion.  The rounds follow the number of lengths: they go on until no
configuration of the lengths left fills a sequence.  The solution is rounded to whole
sequences, the pieces left over are priced and packed likewise in whole copies, and what
fills no sequence goes, longest first, to the fullest open sequence that takes it (best
fit).  ``Plan.served`` counts the pieces of each step.

The plan is a list of (configuration, copies).  Pieces are ranked inside their
length by many tasks, and a join on (length, rank block) gives each one its sequence
and offset, so no task or driver ever sees the pieces of a length together.

Cases: a null or empty text is one piece that holds only the end id; pieces of full
capacity get sequences of their own; repeated rows are packed as often as they stand;
ties among equal lengths follow an MD5 draw of (id, piece); an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .native import hash_ranks
from .registry import query
from .word_bpe import load_tokenizer

CAPACITY = 2048
TILT = 0.25       # long lengths start dearer: short ones fit anywhere and should stay for the gaps
STEP = 0.1
STARTS = 16       # configurations that one knapsack program gives
FILL = 1 / 1024   # of a sequence may stay free in a configuration of the program
END_ID = 0

# fixed values: the split pattern of the byte-level vocabulary
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# texts of these characters only are split alike by every Unicode version
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u024f]*")


class Encoder:
    """Ids of a tokenizers file with a byte-level BPE vocabulary.

    Its ids are merge ranks, so plain texts go through the same vocabulary in tiktoken, about four
    times as fast; any other text, or one that holds a special token, goes through the file's own tokenizer."""

    def __init__(self, path: str):
        import tiktoken
        self.tok = load_tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # the byte alphabet: printable Latin-1 stands for itself, the rest follows from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tok.get_vocab(with_added_tokens=False).items()
                 if t not in self.special}
        self.check(ranks)
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def check(self, ranks: dict[bytes, int]) -> None:
        """The ids must be merge ranks: bytes first, then every token in the order of its merge."""
        by_rank = sorted(ranks, key=ranks.get)
        if any(len(t) != 1 for t in by_rank[:256]) or any(len(t) == 1 for t in by_rank[256:]):
            raise ValueError("the vocabulary's ids are not merge ranks")

    def encode(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[str, Encoder] = {}


def _piece_rows(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, piece, start, length, crc32 of the ids) of every piece of every row."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column("_t")):
                mine = np.append(encoder.encode(text.as_py() or ""), np.array([END_ID], dtype="<u4"))
                cut = len(mine) % capacity or capacity
                edges = [0, *range(cut, len(mine) + 1, capacity)]
                for p, (x, y) in enumerate(zip(edges, edges[1:])):
                    owner.append(k)
                    piece.append(p)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(mine[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_id", "piece", "start", "length", "ids_crc32"])
    return run


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest total price of lengths within every capacity, and a length that attains it (0: no more fits).

    ``price`` is indexed by length; any number of each length may be used."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        v = best[c - 1::-1] + price[1:c + 1]
        k = int(v.argmax())
        best[c] = best[c - 1]
        if v[k] > best[c]:
            best[c], choice[c] = v[k], k + 1
    return best, choice


def configuration(start: int, best: np.ndarray, choice: np.ndarray, price: np.ndarray, supply: np.ndarray,
                  capacity: int) -> dict[int, int]:
    """{length: pieces} of the greatest price that holds ``start``, traced back through the knapsack; a length
    that the supply no longer holds gives way to the best other one."""
    out, c = {start: 1}, capacity - start
    while c > 0:
        size = int(choice[c])
        if not size:
            c -= 1
            continue
        if out.get(size, 0) >= supply[size]:
            v = best[c - 1::-1] + price[1:c + 1]
            v[supply[1:c + 1] <= 0] = -np.inf
            for used, n in out.items():
                if used <= c and n >= supply[used]:
                    v[used - 1] = -np.inf
            size = int(v.argmax()) + 1
            if not np.isfinite(v[size - 1]):
                break
        out[size] = out.get(size, 0) + 1
        c -= size
    return out


def cover(rest: np.ndarray, capacity: int, whole: bool) -> list[tuple[dict[int, int], float]]:
    """Configurations and amounts (whole ones on request) that use up ``rest``, pieces by length.

    Multiplicative weights: a round prices the lengths, one knapsack program serves the ``STARTS`` longest lengths
    that have a full configuration, each takes as much as the demand left allows, and the lengths in it lose
    price by the share of their demand that was served.  Every step uses up a length or lowers its demand,
    and the rounds end when no configuration of the lengths left fills a sequence up to ``FILL``."""
    sizes = np.arange(capacity + 1)
    weight, wanted, found = (sizes / capacity) ** TILT, np.maximum(rest, 1.0), []
    while True:
        live = np.flatnonzero(rest > 1e-9)
        price = np.where(rest > 1e-9, sizes * weight, -np.inf)
        best, choice = knapsack(price, capacity) if len(live) else (price, price)
        taken = 0
        for start in live[::-1]:
            supply = np.ceil(rest - 1e-9).astype(np.int64)
            if taken == STARTS or supply[start] <= 0:
                continue
            config = configuration(int(start), best, choice, price, supply, capacity)
            amount = min(rest[x] / n for x, n in config.items())
            amount = float(int(amount + 1e-9)) if whole else amount
            if not amount or sum(x * n for x, n in config.items()) < capacity * (1 - FILL):
                continue
            taken += 1
            for x, n in config.items():
                rest[x] = max(0.0, rest[x] - n * amount)
                weight[x] *= np.exp(-STEP * n * amount / wanted[x])
            found.append((config, amount))
        if not taken:
            return found


class Plan(NamedTuple):
    configurations: list[tuple[dict[int, int], int]]    # {length: pieces} and copies
    served: dict[str, int]                              # pieces packed by each step


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations and copies that use up the histogram exactly."""
    left, out, served = np.zeros(capacity + 1, dtype=np.int64), [], {}
    for size, n in histogram.items():
        left[size] = n

    def take(config: dict[int, int], copies: int, step: str) -> None:
        for x, n in config.items():
            left[x] -= n * copies
        served[step] = served.get(step, 0) + copies * sum(config.values())
        if copies:
            out.append((config, copies))

    take({capacity: 1}, int(left[capacity]), "alone")
    amounts = cover(left.astype(float), capacity, whole=False)
    for config, amount in amounts:
        take(config, int(amount + 1e-9), "program")
    # rounded down; then one copy more where the pieces are there, the largest fractions first
    fraction = [amount - int(amount + 1e-9) for _, amount in amounts]
    for k in sorted(range(len(amounts)), key=lambda k: -fraction[k]):
        if fraction[k] > 1e-9 and all(left[x] >= n for x, n in amounts[k][0].items()):
            take(amounts[k][0], 1, "program")
    for config, copies in cover(left.astype(float), capacity, whole=True):
        take(config, int(copies), "repairs")
    # the rest: best fit by decreasing length, equal sequences handled together
    served["best fit"] = int(left.sum())
    spare: dict[int, list[list]] = {}       # free space -> [configuration, copies]
    for size in np.flatnonzero(left)[::-1]:
        size, n = int(size), int(left[size])
        while n:
            room = min((r for r in spare if r >= size and spare[r]), default=None)
            if room is None:
                config, copies, room = {}, n, capacity
            else:
                config, copies = spare[room].pop()
            each = min(room // size, n)
            use = min(copies, n // each)
            if use < copies and config:
                spare.setdefault(room, []).append([config, copies - use])
            n -= use * each
            spare.setdefault(room - each * size, []).append([{**config, size: config.get(size, 0) + each}, use])
    out += [(c, k) for groups in spare.values() for c, k in groups if k]
    return Plan(out, served)


def pieces_of(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Encoded pieces of all rows."""
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t"))
    kind = source.schema["_id"].dataType.simpleString()
    return (source.mapInArrow(_piece_rows(path, capacity),
                              f"_id {kind}, piece int, start long, length long, ids_crc32 long")
            .withColumnRenamed("_id", key))


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length``; ``pieces`` is a written table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than the capacity")
    rows, base, used = [], 0, dict.fromkeys(histogram, 0)
    for config, copies in plan(histogram, capacity).configurations:
        at = 0
        for size, n in sorted(config.items(), reverse=True):
            # n consecutive ranks a copy: rank - first = copy * n + place
            rows.append((size, used[size], used[size] + n * copies, n, base, at))
            used[size] += n * copies
            at += n * size
        base += copies
    # some thousands of configurations, by the number of lengths, whatever the number of pieces
    slots = spark.createDataFrame(
        rows, "_len long, _first long, _behind long, _each int, _base long, _at long")
    # ranks are found by the slot that begins at or before them: one equi-join on (length, slot number)
    starts = slots.groupBy("_len").agg(F.sort_array(F.collect_list("_first")).alias("_starts"))
    n_rows = sum(histogram.values())
    ranked = hash_ranks(pieces, ["length"], [key, "piece"], "_rank", n_rows, per_bucket=5_000)
    ranked = ranked.join(F.broadcast(starts), F.col("length") == F.col("_len")).drop("_len")
    ranked = ranked.withColumn("_slot", F.size(F.filter("_starts", lambda s: s <= F.col("_rank")))).drop("_starts")
    numbered = slots.join(starts.withColumnRenamed("_len", "_l2"), F.col("_len") == F.col("_l2")).select(
        "_len", F.array_position("_starts", F.col("_first")).cast("int").alias("_no"), "_first", "_each", "_base", "_at")
    out = ranked.join(F.broadcast(numbered), (F.col("length") == F.col("_len")) & (F.col("_slot") == F.col("_no")))
    copy = F.floor((F.col("_rank") - F.col("_first")) / F.col("_each"))
    place = F.col("_rank") - F.col("_first") - copy * F.col("_each")
    return (out.withColumn("sequence_id", (F.col("_base") + copy).cast("long"))
            .withColumn("offset", (F.col("_at") + place * F.col("length")).cast("long"))
            .drop("_rank", "_slot", "_len", "_no", "_first", "_each", "_base", "_at"))


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack all rows."""
    pieces = cut_lineage(pieces_of(docs, path, key, text, capacity))
    return pack(pieces, key, capacity).select(
        key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def production_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_config_lp_packing")
def op5_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), production_vocabulary())

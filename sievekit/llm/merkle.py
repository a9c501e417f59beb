"""Operator 13: Merkle manifest of a dataset, its subtrees stored in van Emde Boas order.

Every group (a language here) has a binary tree over its leaves in key order; the groups' roots, in
group order, are the leaves of one more tree of the same form.

1. Leaves are hashed in the scan and take their gapless place inside the group from range
   partitions (``ordered_position``), so a group with a third of all rows is ranked by many tasks.
2. A block is an aligned subtree of ``HEIGHT`` levels above its leaves: 256 of them.  It is one
   array of digests in van Emde Boas order: a tree of L levels is its upper L // 2 levels, then the
   lower subtrees from left to right, each laid out in the same way.  ``address`` finds a node from
   (levels, depth, number) alone, so building a block, and going up from a leaf past its siblings,
   touch neighbouring memory at every size of memory block, with no pointers.
3. The roots of a group's blocks are the leaves of its next blocks, until one block is left: 256-fold
   fewer rows per level, each level written.
4. Proofs come down the same way: a block knows the siblings above its root, and hands each of
   its leaves its own siblings inside the block before them.  No task sees more than a block at a time.

A run is two nodes, or one at the end of a level; it becomes the SHA-256 of their hex digests.

Cases: nulls in any column of a leaf are told from empty values; a null group is a group, before the
others; null keys come first; rows of one key are ordered by leaf digest, repeated rows each keep a
leaf; a lone leaf is its group's root; an empty table gives no rows; long texts are hashed whole;
columns outside the leaf do not count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import global_position, ordered_position
from ..session import cut_lineage
from ..sources.tables import table
from .native import null_safe_join
from .registry import query

HEIGHT = 8
DIGEST = 32
ALONE, RIGHT, LEFT = 0, 1, 2     # where a sibling stands
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


# --- van Emde Boas blocks -------------------------------------------------------------------------

def address(levels: int, depth: int, number: int) -> int:
    """Place of a node of a full tree of ``levels`` levels, by its depth and its number from the left."""
    at = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        low = levels - top
        below = depth - top
        at += (1 << top) - 1 + (number >> below) * ((1 << low) - 1)
        levels, depth, number = low, below, number & ((1 << below) - 1)
    return at


@lru_cache(maxsize=None)
def places(levels: int) -> list[list[int]]:
    """``address`` of every node of a block, by depth."""
    return [[address(levels, d, k) for k in range(1 << d)] for d in range(levels)]


def join_hash(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Block:
    """An aligned subtree: its leaves are at depth ``height``; nodes past the end of a level are absent."""

    def __init__(self, height: int, n: int, nodes: bytes | bytearray):
        self.height, self.n, self.nodes = height, n, nodes
        self.at = places(height + 1)

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        block = cls(height, len(leaves), bytearray(DIGEST * ((2 << height) - 1)))
        row = leaves
        for d in range(height, -1, -1):
            for k, digest in enumerate(row):
                p = DIGEST * block.at[d][k]
                block.nodes[p:p + DIGEST] = digest
            row = [join_hash(*row[k:k + 2]) for k in range(0, len(row), 2)] if d else row
        return block

    def node(self, depth: int, number: int) -> bytes:
        p = DIGEST * self.at[depth][number]
        return bytes(self.nodes[p:p + DIGEST])

    def siblings(self, leaf: int) -> bytes:
        """Per level upwards one byte for the side and, if there is a sibling, its digest."""
        out, count = [], self.n
        for d in range(self.height, 0, -1):
            other = leaf ^ 1
            if other < count:
                out.append(bytes([LEFT if leaf & 1 else RIGHT]) + self.node(d, other))
            else:
                out.append(bytes([ALONE]))
            leaf, count = leaf >> 1, (count + 1) >> 1
        return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    p = 0
    while p < len(path):
        side = path[p]
        size = DIGEST if side else 0
        yield side, path[p + 1:p + 1 + size]
        p += 1 + size


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for side, other in steps(path):
        leaf = join_hash(leaf) if side == ALONE else join_hash(leaf, other) if side == RIGHT else join_hash(other, leaf)
    return leaf


# --- a forest of grouped leaves --------------------------------------------------------------------

class Forest(NamedTuple):
    """``levels``: written tables (grp, block, single, height, n, nodes[, items]); ``roots``: (grp, root)."""
    levels: list[DataFrame]
    roots: DataFrame


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append height, n, nodes and root to rows with ``leaves`` and ``single`` (no other block in the group)."""
    for b in batches:
        heights, sizes, nodes, roots = [], [], [], []
        for leaves, single in zip(b.column("leaves").to_pylist(), b.column("single").to_pylist()):
            height = (len(leaves) - 1).bit_length() if single else HEIGHT
            block = Block.build(leaves, height)
            heights.append(height)
            sizes.append(len(leaves))
            nodes.append(bytes(block.nodes))
            roots.append(block.node(0, 0))
        at = b.schema.get_field_index("leaves")
        rest = b.remove_column(at)
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array(heights, pa.int32()), pa.array(sizes, pa.int32()), pa.array(nodes, pa.binary()),
             pa.array(roots, pa.binary())], names=[*rest.schema.names, "height", "n", "nodes", "root"])


def _level(leaves: DataFrame) -> DataFrame:
    """Blocks over (grp, idx, digest, and any ``items`` to keep beside a leaf), written."""
    item = "item" in leaves.columns
    kind = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    rows = F.array_sort(F.collect_list(F.struct("idx", "digest", *(["item"] if item else []))))
    blocks = leaves.groupBy("grp", F.shiftright("idx", HEIGHT).alias("block")).agg(rows.alias("_rows"))
    last = blocks.groupBy("grp").agg(F.max("block").alias("_last")) if item else \
        leaves.groupBy("grp").agg(F.max(F.shiftright("idx", HEIGHT)).alias("_last"))
    blocks = null_safe_join(blocks, last, ["grp"]).select(
        "grp", "block", (F.col("_last") == 0).alias("single"),
        *([F.col("_rows.item").alias("items")] if item else []), F.col("_rows.digest").alias("leaves"))
    ddl = (f"grp {kind['grp']}, block long, single boolean, " + (f"items array<{kind['item']}>, " if item else "")
           + "height int, n int, nodes binary, root binary")
    return cut_lineage(blocks.mapInArrow(_with_nodes, ddl))


def build(leaves: DataFrame) -> Forest:
    """One tree per ``grp`` over the rows (grp, idx gapless from 0, digest); ``item`` stays beside its leaf."""
    levels, roots = [], None
    while True:
        now = _level(leaves)
        levels.append(now)
        done = now.filter("single").select("grp", "root")
        roots = done if roots is None else roots.unionByName(done)
        leaves = now.filter("not single").select("grp", F.col("block").alias("idx"), F.col("root").alias("digest"))
        if leaves.isEmpty():
            return Forest(levels, cut_lineage(roots))


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the siblings above their root to (grp, block, path) of the blocks below."""
    for b in batches:
        grp, block, path = [], [], []
        cols = [b.column(c) for c in ("block", "height", "n", "nodes", "up")]
        for k, (number, height, n, nodes, up) in enumerate(zip(*[c.to_pylist() for c in cols])):
            tree = Block(height, n, nodes)
            for leaf in range(n):
                grp.append(k)
                block.append((number << HEIGHT) + leaf)
                path.append(tree.siblings(leaf) + up)
        yield pa.RecordBatch.from_arrays([b.column("grp").take(pa.array(grp, pa.int64())), pa.array(block, pa.int64()),
                                          pa.array(path, pa.binary())], names=["grp", "block", "up"])


def with_paths(forest: Forest, above: DataFrame) -> DataFrame:
    """Blocks of the lowest level with ``up``, all siblings above them; ``above``: (grp, up) beyond a group's root."""
    kind = forest.roots.schema["grp"].dataType.simpleString()
    known = None
    for n, level in reversed(list(enumerate(forest.levels))):
        tops = null_safe_join(level.filter("single").select("grp", "block"), above, ["grp"])
        known = tops if known is None else known.unionByName(tops)
        placed = null_safe_join(level, known, ["grp", "block"])
        if n == 0:
            return placed
        known = cut_lineage(placed.select("grp", "block", "height", "n", "nodes", "up")
                            .mapInArrow(_hand_down, f"grp {kind}, block long, up binary"))
    raise AssertionError


def manifest(leaves: DataFrame, group: str, order: list[str], item: Column) -> tuple[DataFrame, DataFrame, bytes]:
    """(lowest blocks with items and full paths, (grp, root of the group), root of all).

    ``leaves`` holds the group, the order columns and ``digest``; the bytes are empty where there are no rows."""
    placed = ordered_position(leaves, group, [*order, "digest"], "_pos")
    own = build(placed.select(F.col(group).alias("grp"), (F.col("_pos") - 1).alias("idx"), "digest", item.alias("item")))
    ranked = cut_lineage(global_position(own.roots, ["grp"], "_pos"))
    upper = build(ranked.select(F.lit(0).alias("grp"), (F.col("_pos") - 1).alias("idx"), F.col("root").alias("digest"),
                                F.col("_pos").alias("item")))
    root = upper.roots.first()
    top = with_paths(upper, upper.roots.select("grp", F.lit(b"").alias("up")))
    ups = top.select("block", "height", "n", "nodes", "up").mapInArrow(_leaf_paths, "_pos long, up binary")
    above = cut_lineage(ranked.join(ups, "_pos").select("grp", "up"))
    return with_paths(own, above), own.roots, bytes(root["root"]) if root else b""


def _leaf_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lowest blocks to (place from 1, path) of every leaf."""
    for b in batches:
        place, path = [], []
        for number, height, n, nodes, up in zip(*[b.column(c).to_pylist() for c in ("block", "height", "n", "nodes", "up")]):
            tree = Block(height, n, nodes)
            for leaf in range(n):
                place.append((number << HEIGHT) + leaf + 1)
                path.append(tree.siblings(leaf) + up)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(path, pa.binary())], names=["_pos", "up"])


# --- the query ------------------------------------------------------------------------------------

def leaf_digest(**changed: Column) -> Column:
    """SHA-256 over the fields, each ``-`` if null, else byte count, colon, value."""
    parts = []
    for f in FIELDS:
        value = changed.get(f, F.col(f)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


_PROOF_SCHEMA = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()),
                           ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for number, items, height, n, nodes, up, sub in zip(*[b.column(c).to_pylist() for c in (
                "block", "items", "height", "n", "nodes", "up", "sub")]):
            tree = Block(height, n, nodes)
            for leaf, item in enumerate(items):
                path = tree.siblings(leaf) + up
                digest = tree.node(height, leaf)
                rows.append((item["doc_id"], digest.hex(), sub.hex(),
                             hashlib.sha256("".join(d.hex() for _, d in steps(path)).encode()).hexdigest(),
                             fold(item["tampered"] or digest, path).hex()))
        yield _batch(list(zip(*rows)) if rows else [[]] * 5, _PROOF_SCHEMA)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    harmed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", leaf_digest().alias("digest"),
                         F.when(harmed, leaf_digest(n_chars=F.col("n_chars") + 1)).alias("tampered"))
    item = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "tampered")
    blocks, subroots, root = manifest(leaves, "lang", ["doc_id"], item)
    placed = null_safe_join(blocks, subroots.select("grp", F.col("root").alias("sub")), ["grp"])
    found = placed.select("block", "items", "height", "n", "nodes", "up", "sub").mapInArrow(
        _proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.select("doc_id", "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", "folded_root",
                        (F.col("folded_root") == root.hex()).alias("verified"))


def _sql() -> str:
    """The same manifest in DuckDB: levels, paths and folds as recursive tables."""
    fields = lambda n: " || ".join(
        f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in
        ["doc_id::VARCHAR", "source", "lang", f"({n})::VARCHAR", "text"])
    return f"""
WITH RECURSIVE
digits AS (SELECT *, list_transform(range(2 * strlen(doc_id::VARCHAR)),
    lambda i: ('0x' || hex(encode(doc_id::VARCHAR))[(i // 2) * 2 + 2 - i % 2])::BIGINT) AS nib FROM documents),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, nib),
    lambda a, b: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108
      ][(xor(a, b) & 15) + 1]::BIGINT))) AS crc FROM digits),
d AS MATERIALIZED (SELECT doc_id, lang, sha256({fields('n_chars')}) AS leaf,
             CASE WHEN crc % 7 = 0 THEN sha256({fields('n_chars + 1')}) END AS bad FROM crc),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM d),
t AS (SELECT lang, 0 AS lev, i, leaf AS h, n FROM l
      UNION ALL
      SELECT lang, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2
      FROM t WHERE n > 1 GROUP BY lang, lev, i // 2, n),
s AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, i, h, n FROM s
      UNION ALL
      SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lev, i // 2, n),
f AS (SELECT id, lang, 0 AS lev, i, n, coalesce(bad, leaf) AS h, '' AS proof FROM l
      UNION ALL
      SELECT id, f.lang, f.lev + 1, f.i // 2, (f.n + 1) // 2,
             sha256(CASE WHEN t.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || t.h ELSE t.h || f.h END),
             proof || coalesce(t.h, '')
      FROM f LEFT JOIN t ON t.lang IS NOT DISTINCT FROM f.lang AND t.lev = f.lev AND t.i = xor(f.i, 1) WHERE f.n > 1),
g AS (SELECT id, 0 AS lev, s.i, s.n, f.h, proof FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
      UNION ALL
      SELECT id, g.lev + 1, g.i // 2, (g.n + 1) // 2,
             sha256(CASE WHEN u.h IS NULL THEN g.h WHEN g.i % 2 = 0 THEN g.h || u.h ELSE u.h || g.h END),
             proof || coalesce(u.h, '')
      FROM g LEFT JOIN u ON u.lev = g.lev AND u.i = xor(g.i, 1) WHERE g.n > 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root,
       g.h = r.h AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN g ON g.id = l.id AND g.n = 1, (SELECT h FROM u WHERE n = 1) r
"""


@query("op13_veb_merkle", oracle=_sql())
def op13_veb_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and the root folded from the tampered leaf, for every document."""
    return document_manifest(table(spark, sf_dir, "documents").select(*FIELDS))

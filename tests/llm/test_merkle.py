"""Merkle manifest against a plain recursive tree; layout and proofs by themselves."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sievekit.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string, block long, up string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    """Levels of runs of two, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, k):
    """(sibling or empty, stands left) per level."""
    for row in levels[:-1]:
        other = k ^ 1
        yield (row[other] if other < len(row) else ""), bool(k & 1)
        k >>= 1


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, held = {}, {}
    for g in order:
        held[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[g] = tree([leaf_of(*r) for r in held[g]])
    top = tree([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for n, g in enumerate(order):
        for k, r in enumerate(held[g]):
            path = [*climb(trees[g], k), *climb(top, n)]
            now = leaf_of(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                now = leaf_of(*r[:3], r[3] + 1, r[4])
            for other, left in path:
                now = sha(other, now) if left else sha(now, other)
            out.append((r[0], leaf_of(*r), trees[g][-1][0], root, sha(*[o for o, _ in path]), now, now == root))
    return out


def same(df, rows):
    key = lambda r: tuple(str(x) for x in r)
    got = [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=key) == sorted(by_hand(rows), key=key)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS).collect()]
    same(queries.QUERIES["op13_veb_merkle"](spark, SF), rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (None, "s", "en", 3, "abc"), (3, "s", "en", 3, "abc"),
            (3, "s", "en", 3, "abc"), (3, "s", "en", 4, "é日本"), (-5, "s", "en", 3, "x" * 3_000_000), (9, "s", "zz", 1, "a"),
            (10, "s", "É", 1, "a"), (14, "s", None, 1, "-"), (7, "1:s", None, 7, "2:en")]
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)
    same(merkle.document_manifest(df), rows)


def test_one_row_and_none(spark):
    row = (11, "s", "en", 2, "ab")
    got = merkle.document_manifest(spark.createDataFrame([(*row, "x", "y", 1, "z")], SCHEMA)).first()
    assert got["leaf"] == got["subroot"] == got["root"] == leaf_of(*row) and got["proof_sha256"] == sha("")
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [257, 66_000])
def test_blocks_over_blocks(spark, n):
    """One group of one, two and three levels of blocks beside many groups of one leaf."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                 F.lit(1).cast("long").alias("n_chars"), F.col("id").cast("string").alias("text"))
    docs = docs.unionByName(spark.range(300).select((-F.col("id") - 1).alias("doc_id"), F.lit("s").alias("source"),
                            F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"),
                            F.lit(None).cast("long").alias("n_chars"), F.lit("").alias("text")))
    same(merkle.document_manifest(docs), [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("levels", range(1, 11))
def test_addresses(levels):
    """Every place once; the upper half first, every lower subtree in one stretch."""
    at = merkle.places(levels)
    assert sorted(p for row in at for p in row) == list(range((1 << levels) - 1))
    if levels > 1:
        top = levels // 2
        assert sorted(p for row in at[:top] for p in row) == list(range((1 << top) - 1))
        size = (1 << (levels - top)) - 1
        for k in range(1 << top):
            mine = sorted(at[d][x] for d in range(top, levels) for x in range(1 << d) if x >> (d - top) == k)
            assert mine == list(range((1 << top) - 1 + k * size, (1 << top) - 1 + (k + 1) * size))


def test_block_proofs():
    for n in (1, 2, 3, 7, 130, 256):
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        block = merkle.Block.build(leaves, merkle.HEIGHT)
        for k in range(n):
            assert merkle.fold(leaves[k], block.siblings(k)) == block.node(0, 0)
            assert merkle.fold(leaves[k][::-1], block.siblings(k)) != block.node(0, 0)

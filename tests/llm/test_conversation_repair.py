"""Conversation repair against an exhaustive search over edit scripts, on sf0.001 and on planted conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sievekit.llm import conversation_repair as cr, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, cost string, piece string"
SPACE = "[\x20\x09-\x0d]"


def cheapest(rows, faults):
    """Least (cost, audit) over all scripts, by a search on (rows read, initials emitted so far mod the grammar)."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, k, tail, out = heapq.heappop(heap)
        if (k, tail) in seen:
            continue
        seen.add((k, tail))
        if k == len(rows) and tail in ("", "a"):
            return cost, audit, list(out)
        ways = []
        for role in ("user", "assistant"):
            ways.append((5, "I", k, role, ""))
        if k < len(rows):
            role, text = rows[k]
            extra = 5 if faults[k] == "truncated" else 0
            ways.append((2, "D", k + 1, None, None))
            if faults[k] not in ("blank", "duplicate"):
                ways.append((extra, "K", k + 1, role, text))
                ways += [(1 + extra, "R", k + 1, r, text) for r in ("user", "assistant")]
        for price, letter, n, role, text in ways:
            if role is None:
                heapq.heappush(heap, (cost + price, audit + letter, n, tail, out))
            elif role and (tail + role[0]) in ("s", "u", "su", "ua", "au"):
                heapq.heappush(heap, (cost + price, audit + letter, n, role[0], out + ((role, text),)))
    raise AssertionError


def by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        say = lambda x: " " if x is None else str(x)
        harm = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        convs[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    found = {}
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in got:
            body = re.sub(f"{SPACE}+$", "", text)
            faults.append("blank" if not re.sub(SPACE, "", text) else "duplicate" if (role, text) in seen
                          else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in got if r[0] is not None]
        initials = [r[1][:1] for r in got]
        cost, audit, out = cheapest([r[1:] for r in got], faults)
        found[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}
    return found


def same(df, rows):
    want = by_hand(rows)
    got = {r["conv_id"]: r.asDict() for r in df.collect()}
    assert set(got) == set(want)
    for conv, w in want.items():
        assert {k: got[conv][k] for k in w} == w, conv


def invented(seed, n_conv, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n_conv):
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]) if seed % 2 else turn,
                         rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         rng.choice(["Hello there.", "And", "why?", "", " \n", None, f"word {rng.random()}!", "x " * rng.randint(1, 9)])))
    return rows


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.QUERIES["op11_grammar_repair"](spark, SF), rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_invented(spark, seed):
    rows = invented(seed, 120, 14)
    df = spark.createDataFrame([(*r, "c", "p") for r in rows], SCHEMA)
    same(cr.repair_digest(df), rows)


def test_conversations_of_many_pieces(spark):
    """Pieces of 4 rows and nodes of 3 children: every level of the tree is used, and ranges cut conversations."""
    rows = invented(4, 6, 90) + invented(6, 3, 8)
    rows += [(None, k, "user", f"text {k // 2}.") for k in range(40)]
    df = spark.createDataFrame([(*r, "c", "p") for r in rows], SCHEMA).repartition(3)
    same(cr.repair_digest(df, piece_rows=4, fan=3), rows)


def test_repeated_rows_and_null_turns(spark):
    rows = [(1, None, "user", "same text.")] * 300 + [(2, 5, None, None), (2, 5, "assistant", "ok."), (3, 0, "system", "a.")]
    same(cr.repair_digest(spark.createDataFrame([(*r, "c", "p") for r in rows], SCHEMA)), rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair_digest(none).count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = cr.repair_digest(spark.createDataFrame([(lost, 0, "user", "gone.", "c", "p")], SCHEMA)).first()
    assert (row["cost"], row["gaps"], row["audit"]) == (0, 0, "")
    assert row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_text(spark):
    rows = [(1, 0, "user", "long word. " * 300_000), (1, 1, "assistant", "yes.")]
    same(cr.repair_digest(spark.createDataFrame([(*r, "c", "p") for r in rows], SCHEMA)), rows)


def test_rules_share_halves(spark):
    seqs = ["suauaua", "uaua", "uUaxua", "ua"] * 5 + ["o" * 9]
    g = cr.induce(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    reader = cr.Reader(g)
    assert g.halves and set(g.halves) == set(g.matrices) - set("suaoSUAOx")
    for s in seqs:
        short, ms = reader.matrices(s)
        assert len(short) < len(s)
        plain = cr.Reader(cr.Grammar([], {}, g.matrices))
        assert reader.conversation(s) == plain.conversation(s)


def test_repaired_rows_follow_the_grammar(spark):
    rows = invented(2, 60, 20)
    found = cr.repair(spark.createDataFrame([(*r, "c", "p") for r in rows], SCHEMA))
    initials = cr.repaired_rows(found.pieces).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda x: F.substring(x["role"], 1, 1)), "")
        .alias("s")).collect()
    assert initials and all(re.fullmatch("(s?(ua)+)?", r["s"]) for r in initials)

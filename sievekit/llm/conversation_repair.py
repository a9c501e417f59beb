"""Operator 11: cheapest repair of conversation structure by grammar-compressed dynamic programming.

Rows of a conversation, by turn, become symbols of a small alphabet (role initial, must go,
truncated).  An edit script walks the states of ``(s?(ua)+)?``; a symbol, and every sequence of
symbols, is a 4 x 4 min-plus transfer matrix from the state before to the state behind it.

1. Rows are range-partitioned by (conversation, turn), so a conversation with a third of all rows
   spans many tasks, and cut into pieces of at most ``PIECE`` rows, written once.
2. Re-Pair over the distinct symbol sequences of all pieces: each round counts adjacent pairs in
   Spark, takes the most frequent ones that cannot overlap (at most ``PAIRS`` of them reach the
   driver) and writes the shortened sequences, until no pair occurs twice or a round would replace
   less than ``GAIN`` of the symbols.  What is then left in a sequence is multiplied symbol by symbol.
3. One matrix per rule, bottom-up, shared by all conversations.  An entry holds the least cost, the
   rank of its audit among the entries of its row, and the state between both halves: the audit is a
   rope over the rule's halves, spelt out only for the entry that a conversation needs.
   Audits of one row are never prefixes of each other (each ends in the letter of the last row), so
   (cost, rank of the left half, rank of the right half) compares whole audits, ASCII-least first.
4. Conversations inside one piece are repaired in one pass over the written pieces.  Those of several
   pieces, or at the edge of a range, multiply their pieces' matrices up a tree of ``FAN`` children
   and take start and end states back down it; no task holds more than ``FAN`` matrices.

``repair`` returns texts; only the contract's SHA-256 and audit run through one conversation as a
whole, in order (pieces are hashed as a stream, a digest has no parallel form).

Cases: nulls in conversation, turn, role and text count as one space, null turns come first and
null conversations are one; rows of one turn are ordered by role, the text's first 64 characters and
its hash, repeated rows stand side by side; an empty role has no initial of the grammar and is
reroled or deleted; a conversation without rows costs nothing; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from .native import null_safe_join
from .registry import query

PIECE = 128      # rows of a piece
FAN = 128        # children of a node above the pieces
PAIRS = 1024     # pairs a round looks at
GAIN = 0.01      # least share of the symbols that a round must replace

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 50

BLANK, REPEAT, GONE = "b", "d", "x"
LEGAL = {"su", "ua", "au"}
CLOSING = ["", "II", "I", ""]   # inserts from each state to an end of the grammar

_SPACES = " \t\n\x0b\x0c\r"
_TERMINALS = "suaoSUAO" + GONE


class Matrix(NamedTuple):
    """Row-major 4 x 4: least cost, rank of the audit among the finite entries of its row, state between the halves."""
    cost: list[int]
    rank: list[int]
    mid: list[int]


class Grammar(NamedTuple):
    rounds: list[dict[str, str]]          # per round: pair to symbol, no two pairs of a round overlap
    halves: dict[str, str]                # symbol to pair
    matrices: dict[str, Matrix]


class Repaired(NamedTuple):
    conversations: DataFrame              # conv_id and the figures
    pieces: DataFrame                     # conv_id, piece, edge, audit, roles and texts after repair


def _next_user(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _terminal(symbol: str) -> tuple[list[int], list[str]]:
    """Cost and audit of inserts before a row and the row itself, from each state to each state."""
    cost, audit = [NEVER] * 16, [""] * 16
    broken = TRUNCATED if symbol.isupper() else 0
    own = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
    for i in range(4):
        state = i
        for inserts in range(3):
            steps = [(DELETE, "D", state)]
            if symbol != GONE:
                steps.append((REROLE + broken, "R", _next_user(state)))
                if state in own.get(symbol.lower(), {}):
                    steps.append((KEEP + broken, "K", own[symbol.lower()][state]))
            for price, letter, j in steps:
                new = (price + inserts * INSERT, "I" * inserts + letter)
                at = 4 * i + j
                if new < (cost[at], audit[at]):
                    cost[at], audit[at] = new
            state = _next_user(state)
    return cost, audit


def _ranked(keys: list, cost: list[int]) -> list[int]:
    rank = [0] * 16
    for i in range(0, 16, 4):
        for k, at in enumerate(sorted((x for x in range(i, i + 4) if cost[x] < NEVER), key=lambda x: keys[x])):
            rank[at] = k
    return rank


_AUDITS: dict[str, list[str]] = {}
_BASE: dict[str, Matrix] = {}
for _s in _TERMINALS:
    _c, _a = _terminal(_s)
    _AUDITS[_s], _BASE[_s] = _a, Matrix(_c, _ranked(_a, _c), [-1] * 16)


def product(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product; equal costs go to the ASCII-least audit."""
    cost, mid, keys = [NEVER] * 16, [-1] * 16, [(0, 0)] * 16
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for m in range(4):
                price = x.cost[i + m] + y.cost[4 * m + j]
                if price < NEVER and (best is None or (price, x.rank[i + m]) < best[:2]):
                    best = (price, x.rank[i + m], m)
            if best:
                cost[i + j], mid[i + j] = best[0], best[2]
                keys[i + j] = (best[1], y.rank[4 * best[2] + j])
    return Matrix(cost, _ranked(keys, cost), mid)


def path(matrices: list[Matrix], start: int, end: int | None) -> tuple[int, list[int]]:
    """Cost and the states (one more than matrices) of the cheapest, ASCII-least way; ``end`` None: to any end,
    where the closing inserts count."""
    now = {start: (0, 0)}
    back = []
    for x in matrices:
        ways = {}
        for j in range(4):
            found = [(c + x.cost[4 * m + j], r, x.rank[4 * m + j], m) for m, (c, r) in now.items() if x.cost[4 * m + j] < NEVER]
            if found:
                ways[j] = min(found)
        order = {j: k for k, j in enumerate(sorted(ways, key=lambda j: ways[j][1:3]))}
        now = {j: (w[0], order[j]) for j, w in ways.items()}
        back.append({j: w[3] for j, w in ways.items()})
    if end is None:
        end = min(now, key=lambda j: (now[j][0] + INSERT * len(CLOSING[j]), now[j][1]))
        cost = now[end][0] + INSERT * len(CLOSING[end])
    else:
        cost = now[end][0]
    states = [end]
    for step in reversed(back):
        states.append(step[states[-1]])
    return cost, states[::-1]


# --- grammar ------------------------------------------------------------------------------------

def _symbol(k: int) -> str:
    """The k-th rule's symbol: a code point behind Latin-1, without the surrogates."""
    at = 0x100 + k
    return chr(at if at < 0xD800 else at + 0x800)


def _shorten(seq: str, pairs: dict[str, str], pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: pairs[m.group()], seq)


def _pattern(pairs: dict[str, str]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, pairs)), re.S)


def _choose(counted: list[tuple[str, int]]) -> tuple[list[str], int]:
    """Most frequent pairs first; a symbol begins chosen pairs or ends them, so that none overlap."""
    firsts, seconds, taken, gain = set(), set(), [], 0
    for pair, n in counted:
        a, b = pair
        if n < 2 or a in seconds or b in firsts or (a == b and (a in firsts or a in seconds)):
            continue
        firsts.add(a)
        seconds.add(b)
        taken.append(pair)
        gain += n
    return taken, gain


def induce(sequences: DataFrame, seq: str = "seq") -> Grammar:
    """Re-Pair over all sequences; equal ones are counted together and shortened once."""
    now = cut_lineage(sequences.groupBy(F.col(seq).alias("seq")).agg(F.count(F.lit(1)).alias("n")))
    rounds, halves, matrices = [], {}, dict(_BASE)
    while True:
        pairs = now.filter("char_length(seq) > 1").select(
            F.explode(F.expr("transform(sequence(1, char_length(seq) - 1), i -> substring(seq, i, 2))")).alias("pair"), "n")
        top = (pairs.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(PAIRS).collect())
        size = now.agg(F.sum(F.char_length("seq") * F.col("n"))).first()[0] or 0
        taken, gain = _choose([(r["pair"], r["n"]) for r in top])
        if not taken or gain < GAIN * size:
            return Grammar(rounds, halves, matrices)
        rules = {p: _symbol(len(halves) + k) for k, p in enumerate(taken)}
        for p, s in rules.items():
            halves[s], matrices[s] = p, product(matrices[p[0]], matrices[p[1]])
        rounds.append(rules)

        def shorten(batches, rules=rules):
            pattern = _pattern(rules)
            for b in batches:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_shorten(s, rules, pattern) for s in b.column(0).to_pylist()], pa.string()),
                     b.column(1).cast(pa.int64())], names=["seq", "n"])
        now = cut_lineage(now.select("seq", "n").mapInArrow(shorten, "seq string, n long"))


class Reader:
    """A grammar at work in one task: shortens sequences and spells out audits, both remembered within bounds."""
    KEPT = 1 << 16

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.patterns = [_pattern(r) for r in grammar.rounds]
        self.ropes: dict[tuple, str] = {}
        self.whole: dict[str, tuple[int, str]] = {}

    def matrices(self, seq: str) -> tuple[str, list[Matrix]]:
        for rules, pattern in zip(self.grammar.rounds, self.patterns):
            seq = _shorten(seq, rules, pattern)
        return seq, [self.grammar.matrices[s] for s in seq]

    def rope(self, symbol: str, i: int, j: int) -> str:
        if symbol in _AUDITS:
            return _AUDITS[symbol][4 * i + j]
        key = (symbol, i, j)
        if key not in self.ropes:
            if len(self.ropes) >= self.KEPT:
                self.ropes.clear()
            a, b = self.grammar.halves[symbol]
            m = self.grammar.matrices[symbol].mid[4 * i + j]
            self.ropes[key] = self.rope(a, i, m) + self.rope(b, m, j)
        return self.ropes[key]

    def audit(self, seq: str, start: int, end: int | None) -> tuple[int, str]:
        short, matrices = self.matrices(seq)
        cost, states = path(matrices, start, end)
        text = "".join(self.rope(s, states[k], states[k + 1]) for k, s in enumerate(short))
        return cost, text + (CLOSING[states[-1]] if end is None else "")

    def conversation(self, seq: str) -> tuple[int, str]:
        if seq not in self.whole:
            if len(self.whole) >= self.KEPT:
                self.whole.clear()
            self.whole[seq] = self.audit(seq, START, None)
        return self.whole[seq]


def rebuild(audit: str, start: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts that an audit leaves of a piece."""
    state, k, new_roles, new_texts = start, 0, [], []
    for letter in audit:
        if letter == "D":
            k += 1
            continue
        role, text = ("assistant" if state == USER else "user"), ""
        if letter != "I":
            text = texts[k]
            role = roles[k] if letter == "K" else role
            k += 1
        new_roles.append(role)
        new_texts.append(text)
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
    return new_roles, new_texts


# --- pieces -------------------------------------------------------------------------------------

def _sequence(codes: str) -> str:
    return codes.replace(BLANK, GONE).replace(REPEAT, GONE)


def _code(role: str, text: str) -> str:
    body = text.strip(_SPACES)
    if not body:
        return BLANK
    code = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return code if body[-1] in ".!?" else code.upper()


class _Piece:
    def __init__(self, chunk: int):
        self.chunk = chunk
        self.turns, self.roles, self.texts, self.keys, self.codes = [], [], [], [], []
        self.seen: set = set()

    def add(self, turn, role, text, key) -> None:
        code = _code(role, text)
        if code != BLANK and key in self.seen:
            code = REPEAT
        self.seen.add(key)
        for held, value in zip((self.turns, self.roles, self.texts, self.keys, self.codes), (turn, role, text, key, code)):
            held.append(value)

    def row(self, conv, part: int, edge: bool) -> tuple:
        told = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        wrong = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return (conv, part, self.chunk, edge, "".join(self.codes), min(told, default=None), max(told, default=None),
                len(set(told)), wrong, initials[0], initials[-1], self.roles, self.texts,
                [k[0] for k in self.keys] if edge else [], [k[1] for k in self.keys] if edge else [])


def _piece_schema(rows: DataFrame) -> str:
    kinds = dict(rows.dtypes)
    return (f"conv_id {kinds['conv_id']}, part long, chunk long, edge boolean, codes string, low {kinds['turn']}, "
            f"high {kinds['turn']}, n_turns long, illegal long, first string, last string, roles array<string>, "
            "texts array<string>, h1 array<long>, h2 array<long>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(schema: pa.Schema, piece_rows: int, most: int = 16 << 20):
    """Sorted rows to pieces; a piece is marked ``edge`` unless its conversation surely ends with it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece, conv, first = None, None, True
        rows, weight = [], 0
        for b in batches:
            for c, turn, role, text, h1, h2 in zip(*[b.column(k).to_pylist() for k in range(6)]):
                if piece is not None and c != conv:
                    if piece.codes:
                        rows.append(piece.row(conv, part, first or piece.chunk > 0))
                    piece, first = None, False
                if piece is None:
                    piece, conv = _Piece(0), c
                piece.add(turn, role, text, (h1, h2))
                weight += len(text)
                if len(piece.codes) == piece_rows:
                    rows.append(piece.row(conv, part, True))
                    piece = _Piece(piece.chunk + 1)
                if weight > most:
                    yield _batch(rows, schema)
                    rows, weight = [], 0
        if piece is not None and piece.codes:
            rows.append(piece.row(conv, part, True))
        yield _batch(rows, schema)
    return cut


def cut_pieces(rows: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """Pieces of every conversation of ``rows`` (conv_id, turn, role, text), written."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    # the row's number tells repeated rows apart, so that a group of them can span several ranges
    rows = rows.withColumn("_row", F.monotonically_increasing_id()) \
        .withColumn("_h1", F.xxhash64("role", "text")).withColumn("_h2", F.xxhash64("text", "role", F.lit(11))) \
        .withColumn("_start", F.substring("text", 1, 64))
    keys = ["conv_id", "turn", "role", "_start", "_h1", "_row"]
    schema = _piece_schema(rows)
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in _schema_of(rows.sparkSession, schema)])
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut_lineage(ranged.select("conv_id", "turn", "role", "text", "_h1", "_h2").mapInArrow(_cut(arrow, piece_rows), schema))


def _schema_of(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl).fields


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


# --- conversations of several pieces --------------------------------------------------------------

def _numbered(edges: DataFrame) -> DataFrame:
    """Edge pieces with their gapless number inside the conversation."""
    sizes = edges.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("conv_id", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return null_safe_join(edges, offs, ["conv_id", "part"]).withColumn("piece", F.col("_off") + F.col("chunk")).drop("_off")


def _repeats(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, again): places of rows whose role and text stand in an earlier piece or place."""
    keys = pieces.select("conv_id", "piece", F.posexplode(F.arrays_zip("h1", "h2"))) \
        .select("conv_id", "col.h1", "col.h2", F.struct("piece", "pos").alias("at"))
    first = keys.groupBy("conv_id", "h1", "h2").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    later = null_safe_join(keys, first, ["conv_id", "h1", "h2"]).filter("at > _first")
    return later.groupBy("conv_id", F.col("at.piece").alias("piece")).agg(F.collect_list("at.pos").alias("again"))


def _mark(codes: str, again: list[int] | None) -> str:
    if not again:
        return codes
    out = list(codes)
    for k in again:
        out[k] = out[k] if out[k] == BLANK else REPEAT
    return "".join(out)


def _nodes(grammar: Grammar, kind: str):
    def leaves(batches):
        reader = Reader(grammar)
        for pdf in batches:
            found = []
            for codes in pdf["codes"]:
                _, matrices = reader.matrices(_sequence(codes))
                x = matrices[0]
                for y in matrices[1:]:
                    x = product(x, y)
                found.append(x)
            yield pdf[["conv_id"]].assign(node=pdf["piece"], cost=[x.cost for x in found], rank=[x.rank for x in found])
    return leaves, f"conv_id {kind}, node long, cost array<long>, rank array<long>"


def _matrix(cost, rank) -> Matrix:
    return Matrix([int(v) for v in cost], [int(v) for v in rank], [-1] * 16)


def _up(fan: int):
    def up(pdf):
        pdf = pdf.sort_values("node")
        found = [_matrix(c, r) for c, r in zip(pdf["cost"], pdf["rank"])]
        x = found[0]
        for y in found[1:]:
            x = product(x, y)
        return pdf.iloc[:1][["conv_id"]].assign(node=pdf["node"].iloc[0] // fan, cost=[x.cost], rank=[x.rank])
    return up


def _down(pdf):
    pdf = pdf.sort_values("node")
    end = int(pdf["_end"].iloc[0])
    cost, states = path([_matrix(c, r) for c, r in zip(pdf["cost"], pdf["rank"])], int(pdf["_start"].iloc[0]),
                        None if end < 0 else end)
    return pdf[["conv_id", "node"]].assign(start=states[:-1], end=states[1:], total=cost)


def _states(pieces: DataFrame, grammar: Grammar, fan: int) -> DataFrame:
    """(conv_id, piece, start, end, total): the states around every piece on its conversation's cheapest way."""
    kind = dict(pieces.dtypes)["conv_id"]
    leaves, schema = _nodes(grammar, kind)
    levels = [cut_lineage(pieces.select("conv_id", "piece", "codes").mapInPandas(leaves, schema))]
    width = levels[0].agg(F.max("node")).first()[0]
    while width:
        up = levels[-1].withColumn("_up", F.floor(F.col("node") / fan)).groupBy("conv_id", "_up")
        levels.append(cut_lineage(up.applyInPandas(_up(fan), schema)))
        width //= fan
    ways = levels[-1].select("conv_id", F.col("node"), F.lit(START).alias("_start"), F.lit(-1).alias("_end"),
                             F.lit(None).cast("long").alias("_total"))
    out = f"conv_id {kind}, node long, start int, end int, total long"
    for n, level in enumerate(reversed(levels)):
        here = level.withColumn("_at", F.col("node") if n == 0 else F.floor(F.col("node") / fan))
        above = ways.select("conv_id", F.col("node").alias("_at"), "_start", "_end", "_total")
        step = null_safe_join(here, above, ["conv_id", "_at"])
        found = cut_lineage(null_safe_join(step.groupBy("conv_id", "_at").applyInPandas(_down, out)
                                  .withColumn("_at", F.col("node") if n == 0 else F.floor(F.col("node") / fan)),
                                  above.select("conv_id", "_at", "_total"), ["conv_id", "_at"]))
        ways = found.select("conv_id", "node", F.col("start").alias("_start"), F.col("end").alias("_end"),
                            F.coalesce("_total", "total").alias("_total"))
    return ways.select("conv_id", F.col("node").alias("piece"), F.col("_start").alias("start"),
                       F.col("_end").alias("end"), F.col("_total").alias("total"))


def _arrow_map(kind: str, grammar: Grammar):
    """Repair of pieces; ``start`` null: the piece is a conversation of its own."""
    ddl = (f"conv_id {kind}, piece long, edge boolean, audit string, cost long, blank long, duplicate long, "
           "truncated long, roles array<string>, texts array<string>")
    schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in _schema_of(None, ddl)])

    def run(batches):
        reader = Reader(grammar)
        for b in batches:
            rows = []
            for conv, n, edge, codes, roles, texts, start, end, last in zip(*[c.to_pylist() for c in b.columns]):
                seq = _sequence(codes)
                if start is None:
                    cost, audit = reader.conversation(seq)
                else:
                    cost, audit = reader.audit(seq, start, end)
                    audit += CLOSING[end] if last else ""
                new = rebuild(audit, start or START, roles, texts)
                rows.append((conv, n, edge, audit, cost, codes.count(BLANK), codes.count(REPEAT),
                             sum(map(str.isupper, codes)), *new))
            yield _batch(rows, schema)
    return run, ddl


def repair(rows: DataFrame, piece_rows: int = PIECE, fan: int = FAN) -> Repaired:
    """Figures, audits and repaired texts of all conversations that have rows.

    ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, edge.
    ``pieces``: conv_id, piece (order inside the conversation), edge, audit, roles, texts; written.
    """
    pieces = cut_pieces(rows, piece_rows)
    kind = dict(pieces.dtypes)["conv_id"]
    grammar = induce(pieces.select(F.translate("codes", BLANK + REPEAT, GONE * 2).alias("seq")))
    figures = ["codes", "low", "high", "n_turns", "illegal", "first", "last"]
    run, ddl = _arrow_map(kind, grammar)

    lone = pieces.filter(~F.col("edge"))
    none = F.lit(None).cast("int")
    done = lone.select("conv_id", F.lit(0).cast("long").alias("piece"), "edge", "codes", "roles", "texts",
                       none.alias("start"), none.alias("end"), F.lit(True).alias("last")).mapInArrow(run, ddl)

    edges = cut_lineage(_numbered(pieces.filter("edge")))
    mark = F.udf(_mark, "string")
    edges = cut_lineage(null_safe_join(edges.drop("h1", "h2"), _repeats(edges), ["conv_id", "piece"], "left")
                        .withColumn("codes", mark("codes", "again")).drop("again"))
    states = cut_lineage(_states(edges, grammar, fan))
    tail = states.groupBy("conv_id").agg(F.max("piece").alias("_tail"))
    placed = null_safe_join(null_safe_join(edges, states, ["conv_id", "piece"]), tail, ["conv_id"])
    many = placed.select("conv_id", "piece", "edge", "codes", "roles", "texts", "start", "end",
                         (F.col("piece") == F.col("_tail")).alias("last")).mapInArrow(run, ddl)
    repaired = cut_lineage(done.unionByName(many))

    # between neighbouring pieces: one more adjacent pair, and a turn that both hold
    ahead = edges.select("conv_id", (F.col("piece") + 1).alias("piece"), F.col("last").alias("_last"), F.col("high").alias("_high"))
    met = null_safe_join(edges.select("conv_id", "piece", "edge", *figures), ahead, ["conv_id", "piece"], "left")
    seam = ~F.concat("_last", "first").isin(*LEGAL)
    met = met.withColumn("illegal", F.col("illegal") + F.coalesce(seam.cast("long"), F.lit(0))) \
        .withColumn("n_turns", F.col("n_turns") - F.coalesce((F.col("_high") == F.col("low")).cast("long"), F.lit(0)))
    parts = lone.select("conv_id", "edge", *figures).unionByName(met.select("conv_id", "edge", *figures))
    size = F.char_length("codes")
    lacks = lambda chars: size - F.char_length(F.translate("codes", chars, ""))
    sums = parts.groupBy("conv_id").agg(
        F.min("low").alias("_low"), F.max("high").alias("_high"), F.sum("n_turns").alias("_n"),
        F.sum("illegal").alias("illegal"), F.max("edge").alias("edge"),
        F.sum(lacks(BLANK)).alias("blank"), F.sum(lacks(REPEAT)).alias("duplicate"), F.sum(lacks("SUAO")).alias("truncated"))
    costs = repaired.filter("not edge").select("conv_id", "cost").unionByName(
        states.groupBy("conv_id").agg(F.max("total").alias("cost")))
    whole = null_safe_join(sums, costs, ["conv_id"]).select(
        "conv_id", F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_n"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "edge")
    return Repaired(whole, repaired)


def repaired_rows(pieces: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations; places ascend inside a conversation."""
    rows = pieces.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")))
    return rows.select("conv_id", (F.col("piece") * (4 * piece_rows) + F.col("pos")).alias("place"),
                       F.col("col.roles").alias("role"), F.col("col.texts").alias("text"))


# --- the query ------------------------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage, fixed by conversation and turn."""
    blank = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"),
                       (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("_harm"))
    harm = F.col("_harm")
    text = F.when(harm == 1, F.lit("")).when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(harm != 0).select(
        "conv_id", "turn", F.when(harm == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        copies.alias("_copy")).drop("_copy")


def _stream_digest(kind: str):
    """Pieces sorted by conversation and number to one digest each; only one hash state is held."""
    def run(batches):
        now, state = None, None
        for b in batches:
            rows = []
            for conv, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        rows.append((now, state[0].hexdigest()))
                    now, state = conv, [hashlib.sha256(), False]
                if body is not None:
                    state[0].update((("\n" if state[1] else "") + body).encode())
                    state[1] = True
            yield _batch(rows, schema)
        yield _batch([(now, state[0].hexdigest())] if state is not None else [], schema)
    ddl = f"conv_id {kind}, repaired_sha256 string"
    schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in _schema_of(None, ddl)])
    return run, ddl


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of every conversation."""
    lines = F.when(F.size("roles") > 0,
                   F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n"))
    text = pieces.select("conv_id", "piece", "edge", "audit", lines.alias("body"))
    lone = text.filter("not edge").select("conv_id", "audit", F.sha2(F.coalesce("body", F.lit("")), 256).alias("repaired_sha256"))
    many = text.filter("edge")
    run, ddl = _stream_digest(dict(pieces.dtypes)["conv_id"])
    hashed = many.select("conv_id", "piece", "body").repartition("conv_id").sortWithinPartitions("conv_id", "piece") \
        .select("conv_id", "body").mapInArrow(run, ddl)
    audits = many.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    return lone.unionByName(null_safe_join(audits, hashed, ["conv_id"]).select("conv_id", "audit", "repaired_sha256"))


@query("op11_grammar_repair")
def op11_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and repaired text of every conversation after the damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_digest(rows)


def repair_digest(rows: DataFrame, piece_rows: int = PIECE, fan: int = FAN) -> DataFrame:
    """The contract's columns for every conversation of ``rows``."""
    found = repair(damage(rows), piece_rows, fan)
    whole = null_safe_join(found.conversations, digests(found.pieces), ["conv_id"])
    every = rows.select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return null_safe_join(every, whole, ["conv_id"], "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

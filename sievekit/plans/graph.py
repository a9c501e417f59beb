"""Reaction graphs, chains, pairs at known distances, hierarchies, equations.

Stand-in: an order is a pathway; its lines in total order
(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) are the
reaction steps.  Part types are the graph nodes for the transition graphs,
parts (``'P' || l_partkey``) are the molecules of the distance pairs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, graph, joins, ranking, splits
from ..sources import table
from .registry import query

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

LT = """lt AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_type,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
                                                             l.l_quantity, l.l_extendedprice) AS pos
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

OP = """op AS (SELECT a.l_orderkey, 'P' || a.l_partkey AS mol1, 'P' || b.l_partkey AS mol2,
              CAST(b.pos - a.pos AS VARCHAR) AS separation
       FROM lt a JOIN lt b ON a.l_orderkey = b.l_orderkey AND b.pos - a.pos BETWEEN 1 AND 6)"""

TE = """te AS (SELECT a.l_orderkey AS g, a.p_type AS s, b.p_type AS d,
              'R' || a.l_linenumber || '-' || a.l_partkey AS attr, a.pos
       FROM lt a JOIN lt b ON a.l_orderkey = b.l_orderkey AND b.pos = a.pos + 1)"""

TREE = """e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation
       UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer),
cl(root, node, depth) AS (
  SELECT parent, child, 1 FROM e WHERE parent LIKE 'R%'
  UNION ALL SELECT cl.root, e.child, cl.depth + 1 FROM cl JOIN e ON e.parent = cl.node)"""


def line_chain(spark, sf_dir):
    """(l_orderkey, pos, l_linenumber, l_partkey, p_type): positions by
    ``ordered_position`` — no whole-order window; the chains are written once."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    x = li.join(pa, li.l_partkey == pa.p_partkey).drop("p_partkey")
    return ranking.ordered_position(x, "l_orderkey", LINE_ORDER)


def type_edges(spark, sf_dir):
    """Consecutive-line type transitions (g, s, d, attr, pos): the pairs at distance 1 along each chain."""
    lc = line_chain(spark, sf_dir).select(
        "l_orderkey", "pos", "p_type",
        F.concat(F.lit("R"), F.col("l_linenumber").cast("string"), F.lit("-"),
                 F.col("l_partkey").cast("string")).alias("attr"))
    p = ranking.offset_pairs(lc.withColumn("at", F.col("pos")), "l_orderkey", "pos", "p_type", 1, carry=("attr", "at"))
    return p.select(F.col("l_orderkey").alias("g"), F.col("mol1").alias("s"), F.col("mol2").alias("d"),
                    F.col("attr_1").alias("attr"), F.col("at_1").alias("pos"))


def molecules(spark, sf_dir):
    return line_chain(spark, sf_dir).select(
        "l_orderkey", "pos", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("mol"))


def offset_pairs(spark, sf_dir):
    p = ranking.offset_pairs(molecules(spark, sf_dir), "l_orderkey", "pos", "mol", 6)
    return p.withColumn("separation", F.col("separation").cast("string"))


@query("reaction_edges", oracle=f"""
WITH {LT}, {TE}
SELECT g AS l_orderkey, s AS src, d AS dst, arg_max(attr, pos) AS attr FROM te GROUP BY ALL
""")
def reaction_edges(spark, sf_dir):
    """G1: per order, type → next type; duplicate edges collapse, last attribute wins."""
    e = graph.edge_set(type_edges(spark, sf_dir), "g", "s", "d", "attr", "pos")
    return e.select(F.col("g").alias("l_orderkey"), F.col("s").alias("src"), F.col("d").alias("dst"), "attr")


@query("acyclic_groups", oracle="""
SELECT l_orderkey, count(*) = count(DISTINCT p_type) AS acyclic
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def acyclic_groups(spark, sf_dir):
    """Acyclicity of every order's transition graph (Kahn rounds).
    Oracle: a walk's edge graph is acyclic iff no node repeats on the walk."""
    e = type_edges(spark, sf_dir)
    cyc = graph.cyclic_groups(e, "g", "s", "d").withColumn("cyclic", F.lit(True))
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g")).distinct()
    return (orders.join(cyc, "g", "left")
                  .select(F.col("g").alias("l_orderkey"), F.col("cyclic").isNull().alias("acyclic")))


@query("longest_chain_dag", oracle="""
SELECT l_orderkey, greatest(count(DISTINCT l_linenumber), 1) AS chain_len, count(DISTINCT l_linenumber) > 6 AS long_chain
FROM lineitem GROUP BY 1
""")
def longest_chain_dag(spark, sf_dir):
    """G3 + G6: DAG per order over distinct nodes line‖part, edge u → v when
    u's line number is smaller than v's; longest path by DP rounds; flag > 6 nodes.
    Oracle (closed form): distinct line numbers (a node without one is a chain by itself)."""
    best = line_chains(spark, sf_dir, F.col("a.l_linenumber") < F.col("b.l_linenumber"))
    return best.select(F.col("g").alias("l_orderkey"), F.col("chain_len").cast("long").alias("chain_len"),
                       (F.col("chain_len") > 6).alias("long_chain"))


def consecutive_chains(spark, sf_dir):
    """The longest path per order over edges from each line number to the next integer only."""
    return line_chains(spark, sf_dir, F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)


def line_chains(spark, sf_dir, linked):
    """The longest path of every order's distinct nodes line‖part, with an edge a → b where ``linked`` holds."""
    from ..session import cut_lineage
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nodes = li.select(F.col("l_orderkey").alias("g"), "l_linenumber",
                      F.format_string("%03d:%d", "l_linenumber", "l_partkey").alias("n")).distinct()
    nodes = cut_lineage(nodes)                                  # read for both ends of the edges and for single nodes
    a = nodes.alias("a")
    b = nodes.alias("b")
    e = a.join(b, (F.col("a.g") == F.col("b.g")) & linked) \
         .select(F.col("a.g").alias("g"), F.col("a.n").alias("src"), F.col("b.n").alias("dst"))
    return graph.dag_longest_paths(e, "g", "src", "dst", nodes=nodes.select("g", "n"))


@query("long_chains", oracle="""
WITH d AS (SELECT l_orderkey, l_linenumber, min(printf('%03d:%d', l_linenumber, l_partkey)) AS node FROM lineitem GROUP BY ALL),
i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS grp FROM d),
q AS (SELECT l_orderkey, grp, count(*) AS c, min(l_linenumber) AS lo FROM i GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, lo) AS k FROM q) WHERE k = 1 AND c > 6)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos, node
FROM i JOIN r USING (l_orderkey, grp)
""")
def long_chains(spark, sf_dir):
    """Only chains of more than six nodes are kept, one row per node and position."""
    return graph.chains_longer_than(consecutive_chains(spark, sf_dir), "g", 6).select(
        F.col("g").alias("l_orderkey"), F.col("pos").cast("long").alias("pos"), "node")




@query("longest_chain", oracle=f"""
WITH RECURSIVE {LT}, {TE},
e AS (SELECT DISTINCT g, s, d FROM te),
n AS (SELECT g, s AS node FROM e UNION SELECT g, d FROM e),
p(g, last, path) AS (
  SELECT g, node, [node] FROM n
  UNION ALL
  SELECT p.g, e.d, list_append(p.path, e.d) FROM p JOIN e ON e.g = p.g AND e.s = p.last
  WHERE NOT list_contains(p.path, e.d)),
m AS (SELECT g, max(len(path)) AS L FROM p GROUP BY g)
SELECT p.g AS l_orderkey, m.L AS chain_len, array_to_string(min(path), '>') AS chain
FROM p JOIN m ON p.g = m.g AND len(p.path) = m.L GROUP BY p.g, m.L
""")
def longest_chain(spark, sf_dir):
    """G4 + G5: longest simple path of every order's (possibly cyclic) type graph, ties → smallest
    node list; large acyclic groups go by rounds of the DAG, large cyclic ones by their components."""
    best = graph.longest_chains(type_edges(spark, sf_dir), "g", "s", "d")
    return best.select(F.col("g").alias("l_orderkey"), F.col("chain_len").cast("long").alias("chain_len"),
                       F.array_join("chain", ">").alias("chain"))


@query("strong_components", oracle=f"""
WITH RECURSIVE {LT}, {TE},
e AS (SELECT DISTINCT g, s, d FROM te),
n AS (SELECT g, s AS node FROM e UNION SELECT g, d FROM e),
r(g, a, b) AS (SELECT g, node, node FROM n UNION SELECT r.g, r.a, e.d FROM r JOIN e ON e.g = r.g AND e.s = r.b)
SELECT x.g AS l_orderkey, x.a AS node, min(x.b) AS component
FROM r x JOIN r y ON y.g = x.g AND y.a = x.b AND y.b = x.a GROUP BY ALL
""")
def strong_components(spark, sf_dir):
    """G2 + G4: strongly connected component of every node of every order's type graph."""
    c = graph.strong_components(type_edges(spark, sf_dir), "g", "s", "d")
    return c.select(F.col("g").alias("l_orderkey"), F.col("n").alias("node"), F.col("comp").alias("component"))


@query("chain_survival", oracle="""
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
i AS (SELECT l_orderkey, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS grp FROM d),
r AS (SELECT l_orderkey, grp, count(*) AS c FROM i GROUP BY ALL),
ch AS (SELECT l_orderkey, max(c) AS len FROM r GROUP BY 1)
SELECT t.L, count(ch.len) AS n_chains FROM range(0, 11) t(L) LEFT JOIN ch ON ch.len > t.L GROUP BY t.L
""")
def chain_survival(spark, sf_dir):
    """Number of chains longer than L, L = 0..10 (zero rows kept)."""
    from ..operators.aggs import survival_counts
    ch = consecutive_chains(spark, sf_dir)
    return survival_counts(ch, "chain_len", 10).withColumn("L", F.col("L").cast("long"))


@query("pair_offsets", oracle=f"""
WITH {LT}, {OP} SELECT l_orderkey, mol1, mol2, separation FROM op
""")
def pair_offsets(spark, sf_dir):
    """W2 + P10: (node_i, node_i+k), k = 1..6, along each order's chain; the
    column-shuffled null pairs (separation '-1') are unioned in and the
    sentinel rows dropped, as the reference's pair table is cleaned."""
    from ..session import cut_lineage
    p = cut_lineage(offset_pairs(spark, sf_dir))                # read for the pairs, both samples and their size
    nulls = _null_pairs(p).select(F.lit(None).cast("long").alias("l_orderkey"), "mol1", "mol2", "separation")
    both = p.unionByName(nulls)
    return both.filter(F.col("separation") != "-1")


@query("pair_roles", oracle=f"""
WITH {LT}, {OP}
SELECT op.*, p1.p_type AS p_type_mol1, p1.p_brand AS p_brand_mol1,
       p2.p_type AS p_type_mol2, p2.p_brand AS p_brand_mol2
FROM op LEFT JOIN part p1 ON 'P' || p1.p_partkey = op.mol1 LEFT JOIN part p2 ON 'P' || p2.p_partkey = op.mol2
""")
def pair_roles(spark, sf_dir):
    """The part dimension joined once per pair role, columns suffixed."""
    pa = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key"), "p_type", "p_brand")
    return joins.role_join(offset_pairs(spark, sf_dir), pa, "key",
                           {"mol1": "_mol1", "mol2": "_mol2"}, ["p_type", "p_brand"])


@query("pair_frequency_filter", oracle=f"""
WITH {LT}, {OP},
cnt AS (SELECT v, count(*) AS c FROM (SELECT mol1 AS v FROM op UNION ALL SELECT mol2 FROM op) GROUP BY v),
hot AS (SELECT v FROM cnt WHERE c > (SELECT quantile_cont(c, 0.99) FROM cnt))
SELECT * FROM op WHERE mol1 NOT IN (SELECT v FROM hot) AND mol2 NOT IN (SELECT v FROM hot)
""")
def pair_frequency_filter(spark, sf_dir):
    """P14 + A8: drop pairs touching a molecule counted (over both roles) above
    the exact 0.99 quantile of counts."""
    from ..session import cut_lineage
    return clean.over_frequent_filter(cut_lineage(offset_pairs(spark, sf_dir)), "mol1", "mol2", 0.99)


@query("random_negative_pairs", oracle=f"""
WITH {LT}, {OP},
v AS (SELECT mol1 AS n FROM op INTERSECT SELECT mol2 FROM op),
r AS (SELECT n, row_number() OVER (ORDER BY md5('neg|' || n)) - 1 AS pos, count(*) OVER () AS m FROM v),
c AS (SELECT a.n AS mol1, b.n AS mol2, s.s AS shift, a.pos AS pos
      FROM r a CROSS JOIN range(1, 33) s(s) JOIN r b ON b.pos = (a.pos + s.s) % a.m),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.mol1 = c.mol1 AND op.mol2 = c.mol2))
SELECT mol1, mol2, 'random pairs' AS separation FROM f ORDER BY shift, pos LIMIT 600
""")
def random_negative_pairs(spark, sf_dir):
    """T5 + J11 + O2 + O4: 600 distinct ordered pairs (a ≠ b) of molecules seen
    in both roles that are not existing pairs.

    Candidate generation without all pairs: molecules get a seeded position
    0..m-1; candidate s pairs position i with (i + s) mod m.  Candidates are tried in the order of (shift,
    position), twice 600 first and twice as many more only while fewer than 600 remain beside the existing pairs,
    so a round looks for a bounded number of candidates among the pairs.  The first 600 are taken with a
    distributed top-n.  A molecule with a pair in a role has one at distance 1, so those tell the molecules.
    """
    from ..session import cut_lineage
    op = cut_lineage(offset_pairs(spark, sf_dir).select("mol1", "mol2", "separation"))          # reused by every round
    near = op.filter("separation = '1'")
    v = near.select(F.col("mol1").alias("n")).intersect(near.select(F.col("mol2").alias("n")))
    r = cut_lineage(splits.shuffle_positions(v, "n", seed="neg").withColumn("pos", F.col("pos") - 1))
    m, want, last = r.count(), 600, 0
    step, every = 2 * want, m * max(m - 1, 1)
    found = []
    while True:
        first, last = last, min(every, last + step)
        a = spark.range(first, last).select((F.col("id") % max(m, 1)).alias("pos"), F.expr(f"id div {max(m, 1)} + 1").alias("shift"))
        a = cut_lineage(a.withColumn("bpos", (F.col("pos") + F.col("shift")) % F.lit(max(m, 1))))
        a = cut_lineage(r.select(F.col("n").alias("mol1"), "pos").join(a, "pos"))
        c = cut_lineage(r.select(F.col("n").alias("mol2"), F.col("pos").alias("bpos")).join(a, "bpos").filter("mol1 != mol2"))
        taken = cut_lineage(joins.semi_join(op.select("mol1", "mol2"), c, ["mol1", "mol2"]))
        c = joins.anti_join(c, taken, ["mol1", "mol2"])
        found.append(cut_lineage(c.orderBy("shift", "pos").limit(want).select("mol1", "mol2", "shift", "pos")))
        want -= found[-1].count()
        step *= 2
        if want <= 0 or last >= every:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("mol1", "mol2", F.lit("random pairs").alias("separation"))


def _null_pairs(op, k: int = 6):
    """T4: sample each column independently (fraction 1/k) and pair the samples by rank."""
    rid = F.concat_ws("|", F.col("l_orderkey").cast("string"), "mol1", "mol2", "separation")
    keep = op.count() // k
    a, b = (splits.first_positions(op.select(c, rid.alias("__rid")), "__rid", s, keep, 1 / k, "r").select(c, "r")
            for c, s in (("mol1", "a"), ("mol2", "b")))
    return a.join(b, "r").select("mol1", "mol2", F.lit("-1").alias("separation"))


@query("column_shuffle_pairs", oracle=f"""
WITH {LT}, {OP},
x AS (SELECT *, l_orderkey || '|' || mol1 || '|' || mol2 || '|' || separation AS rid FROM op),
a AS (SELECT mol1, row_number() OVER (ORDER BY md5('a|' || rid)) AS r FROM x),
b AS (SELECT mol2, row_number() OVER (ORDER BY md5('b|' || rid)) AS r FROM x),
k AS (SELECT count(*) // 6 AS k FROM op)
SELECT a.mol1, b.mol2, '-1' AS separation FROM a JOIN b USING (r) WHERE r <= (SELECT k FROM k)
""")
def column_shuffle_pairs(spark, sf_dir):
    """T4: null pairs from independently shuffled columns (separation '-1')."""
    from ..session import cut_lineage
    return _null_pairs(cut_lineage(offset_pairs(spark, sf_dir)))


def tree_edges(spark, sf_dir):
    na = table(spark, sf_dir, "nation")
    cu = table(spark, sf_dir, "customer")
    e1 = na.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"),
                   F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"))
    e2 = cu.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent"),
                   F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("child"))
    return e1.unionByName(e2)


@query("hierarchy_members", oracle=f"""
WITH RECURSIVE {TREE} SELECT root, node, depth FROM cl
""")
def hierarchy_members(spark, sf_dir):
    """Closure of the region → nation → customer tree below every region."""
    roots = table(spark, sf_dir, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("root"))
    return graph.closure(tree_edges(spark, sf_dir), roots)


@query("hierarchy_membership", oracle=f"""
WITH RECURSIVE {TREE},
m AS (SELECT node FROM cl WHERE root = 'R1'),
t AS (SELECT o_orderkey, unnest(['N' || (o_custkey % 25), 'C' || o_custkey]) AS node, unnest([0, 1]) AS pos
      FROM orders)
SELECT o_orderkey, arg_min(node, pos) AS matched_type FROM t WHERE node IN (SELECT node FROM m) GROUP BY 1
""")
def hierarchy_membership(spark, sf_dir):
    """Orders whose type list (a nation code, then the customer) has a
    member below region R1; the first matching type is reported."""
    roots = spark.range(1).select(F.lit("R1").alias("root"))
    members = graph.closure(tree_edges(spark, sf_dir), roots)
    od = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array(F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")),
                              F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("types"))
    return graph.first_member_type(od, "o_orderkey", "types", members)


EQ_SQL = r"""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_quantity > 25 THEN CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS VARCHAR) || ' ' ELSE '' END
  || 'P' || l_partkey || ' + S' || l_suppkey || ' <=> O' || l_orderkey
  || CASE WHEN l_linenumber > 3 THEN ' + L' || l_linenumber ELSE '' END AS eq FROM lineitem),
s AS (SELECT *, string_split(eq, '<=>') AS sides FROM q),
lr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  list_filter(list_transform(string_split(trim(sides[1]), ' + '), lambda x: regexp_replace(trim(x), '^\S+\s+', '')), lambda x: x <> '') AS lft,
  list_filter(list_transform(string_split(trim(sides[2]), ' + '), lambda x: regexp_replace(trim(x), '^\S+\s+', '')), lambda x: x <> '') AS rgt
  FROM s),
a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rgt, unnest(lft) AS src FROM lr)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, src, unnest(rgt) AS dst FROM a
"""


def _equation(col_q, pk, sk, ok, ln):
    coef = F.when(col_q > 25, F.concat(F.floor(col_q / 10).cast("long").cast("string"), F.lit(" "))).otherwise("")
    tail = F.when(ln > 3, F.concat(F.lit(" + L"), ln.cast("string"))).otherwise("")
    return F.concat(coef, F.lit("P"), pk.cast("string"), F.lit(" + S"), sk.cast("string"),
                    F.lit(" <=> O"), ok.cast("string"), tail)


def parse_side(side):
    """F8: split one equation side on ' + ', trim, drop empties, strip a
    leading stoichiometric coefficient."""
    parts = F.transform(F.split(F.trim(side), r" \+ "),
                        lambda x: F.regexp_replace(F.trim(x), r"^\S+\s+", ""))
    return F.filter(parts, lambda x: x != "")


@query("equation_edges", oracle=EQ_SQL)
def equation_edges(spark, sf_dir):
    """F8 + J8 + U5: synthetic reaction equation per line → (left × right) edges."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_quantity")
    eq = _equation(F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"),
                   F.col("l_orderkey"), F.col("l_linenumber"))
    sides = F.split(eq, "<=>")
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                  parse_side(sides[0]).alias("lft"), parse_side(sides[1]).alias("rgt"))
    return joins.explode_cross(x, "lft", "rgt").drop("lft", "rgt")


@query("equation_edges_lateral", oracle=EQ_SQL)
def equation_edges_lateral(spark, sf_dir):
    """The same edges through a Python table function, joined laterally in SQL."""
    from ..functions import udtfs
    udtfs.register(spark)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    eq = _equation(F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber"))
    return spark.sql("""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e.src, e.dst
        FROM {lines} AS l, LATERAL equation_edges(l.equation) AS e""", lines=li.withColumn("equation", eq))


@query("primaries_parse", oracle=r"""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  '(R' || l_orderkey || '-' || l_linenumber || ' (:LEFT-PRIMARIES P' || l_partkey || ' S' || l_suppkey
  || ') (:RIGHT-PRIMARIES O' || l_orderkey || ') :DIRECTION :L2R)' AS layout FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  list_concat(regexp_extract_all(regexp_extract(layout, '\(:LEFT-PRIMARIES ([^)]*)\)', 1), '\S+'),
              regexp_extract_all(regexp_extract(layout, '\(:RIGHT-PRIMARIES ([^)]*)\)', 1), '\S+')) AS cs FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS compound
FROM c
""")
def primaries_parse(spark, sf_dir):
    """compounds of the LEFT-PRIMARIES then RIGHT-PRIMARIES groups of a
    reaction layout string, with their position."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = lambda c: F.col(c).cast("string")
    layout = F.concat(F.lit("(R"), s("l_orderkey"), F.lit("-"), s("l_linenumber"),
                      F.lit(" (:LEFT-PRIMARIES P"), s("l_partkey"), F.lit(" S"), s("l_suppkey"),
                      F.lit(") (:RIGHT-PRIMARIES O"), s("l_orderkey"), F.lit(") :DIRECTION :L2R)"))
    # a layout without a side has no compounds there
    left = F.regexp_extract_all(F.regexp_extract(layout, r"\(:LEFT-PRIMARIES ([^)]*)\)", 1), F.lit(r"\S+"), 0)
    right = F.regexp_extract_all(F.regexp_extract(layout, r"\(:RIGHT-PRIMARIES ([^)]*)\)", 1), F.lit(r"\S+"), 0)
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(left, right).alias("cs"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.posexplode("cs").alias("pos", "compound")).withColumn("pos", F.col("pos").cast("long"))

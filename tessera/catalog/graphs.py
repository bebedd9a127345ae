"""Graph traversal, algorithms, Cypher, triples and names over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import fp, names
from tessera.operators import graph, triples
from tessera.plans.cypher import cypher
from tessera.sources import store
from tessera.sources.star import edges, table
from tessera.sources.star import graph as star_graph

EDGES = """edges AS (
    SELECT 'n' || n_nationkey AS source, 'PART_OF' AS verb, 'r' || n_regionkey AS target, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS amplification FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'LOCATED_IN', 'n' || c_nationkey, 1.0, 1.0 FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'LOCATED_IN', 'n' || s_nationkey, 1.0, 1.0 FROM supplier
    UNION ALL SELECT 'c' || o_custkey, 'PLACED', 'o' || o_orderkey, 1.0, 1.0 FROM orders
    UNION ALL SELECT 'o' || l_orderkey, 'CONTAINS', 'p' || l_partkey, sum(l_quantity), 1.0 - avg(l_discount) FROM lineitem GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT 's' || l_suppkey, 'SUPPLIES', 'p' || l_partkey, sum(l_quantity), 1.0 FROM lineitem GROUP BY l_suppkey, l_partkey)"""


@query(f"WITH {EDGES} SELECT source, verb, target, round(weight, 4) AS weight, round(amplification, 6) AS amplification FROM edges")
def edge_scan(spark, sf_dir):
    return edges(spark, sf_dir).select("source", "verb", "target", F.round("weight", 4).alias("weight"), F.round("amplification", 6).alias("amplification"))


@query(f"WITH {EDGES} SELECT source, count(*) AS n FROM edges WHERE verb = 'PLACED' GROUP BY source")
def one_hop(spark, sf_dir):
    return edges(spark, sf_dir).where("verb = 'PLACED'").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT a.source AS customer, b.target AS part, count(*) AS ways FROM edges a JOIN edges b ON a.target = b.source WHERE a.verb = 'PLACED' AND b.verb = 'CONTAINS' GROUP BY ALL")
def two_hop(spark, sf_dir):
    e = edges(spark, sf_dir)
    a, b = e.where("verb = 'PLACED'").alias("a"), e.where("verb = 'CONTAINS'").alias("b")
    rows = a.join(b, F.col("a.target") == F.col("b.source"))
    return rows.groupBy(F.col("a.source").alias("customer"), F.col("b.target").alias("part")).agg(F.count("*").alias("ways"))


@query(f"WITH {EDGES}, ends AS (SELECT source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM ends GROUP BY node")
def degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(
    f"WITH {EDGES}, h1 AS (SELECT DISTINCT source AS node FROM edges WHERE target = 'r0' AND verb IN ('PART_OF', 'LOCATED_IN')),"
    " h2 AS (SELECT DISTINCT e.source AS node FROM edges e JOIN h1 ON e.target = h1.node WHERE verb IN ('PART_OF', 'LOCATED_IN') AND e.source NOT IN (SELECT node FROM h1) AND e.source <> 'r0')"
    " SELECT 1::BIGINT AS hop, node AS target FROM h1 UNION ALL SELECT 2, node FROM h2"
)
def bfs_first_visit(spark, sf_dir):
    starts = spark.sql("SELECT 'r0' AS start")
    out = graph.first_visit(edges(spark, sf_dir), starts, 3, ["PART_OF", "LOCATED_IN"], "in")
    return out.select(F.col("hop").cast("long").alias("hop"), "target")


STEPS = (
    "steps AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, ts FROM events),"
    " moves AS (SELECT a AS source, b AS target, count(*) AS n FROM steps WHERE b IS NOT NULL AND a <> b GROUP BY a, b)"
)


def moves(spark, sf_dir):
    """(source, verb, target, n): transitions between the types of a user's consecutive events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target"))
    rows = rows.where("target is not null and source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))
    return rows.select("source", F.lit("THEN").alias("verb"), "target", "n")


@query(
    f"WITH RECURSIVE {STEPS}, p AS (SELECT source AS start, target, 1::BIGINT AS depth, [source, target] AS path FROM moves"
    " UNION ALL SELECT p.start, m.target, p.depth + 1, list_append(p.path, m.target) FROM p JOIN moves m ON p.target = m.source WHERE p.depth < 3 AND NOT list_contains(p.path, m.target))"
    " SELECT start, target, depth, array_to_string(path, '>') AS path FROM p WHERE depth >= 2"
)
def var_length(spark, sf_dir):
    rows = moves(spark, sf_dir)
    starts = rows.select(F.col("source").alias("start")).distinct()
    out = graph.paths(rows.drop("n"), starts, 2, 3)
    return out.select("start", "target", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


def pagerank_sql(rounds: int, tables: str = STEPS, edges: str = "moves") -> str:
    sql = f"WITH {tables}, e AS (SELECT DISTINCT source, target FROM {edges}), nodes AS (SELECT source AS node FROM e UNION SELECT target FROM e), c AS (SELECT count(*) AS k FROM nodes),"
    sql += " d AS (SELECT source AS node, count(*) AS degree FROM e GROUP BY source), r0 AS (SELECT node, 1.0::DOUBLE / k AS rank FROM nodes, c)"
    for i in range(rounds):
        sql += (
            f", s{i} AS (SELECT e.target AS node, sum(r.rank / d.degree) AS sent FROM r{i} r JOIN e ON e.source = r.node JOIN d ON d.node = r.node GROUP BY e.target),"
            f" l{i} AS (SELECT coalesce(sum(rank), 0.0) AS lost FROM r{i} WHERE node NOT IN (SELECT node FROM d)),"
            f" r{i + 1} AS (SELECT n.node, (1 - 0.85::DOUBLE) / k + 0.85::DOUBLE * (coalesce(sent, 0.0) + lost / k) AS rank FROM nodes n LEFT JOIN s{i} USING (node), l{i}, c)"
        )
    return sql + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(pagerank_sql(5))
def pagerank(spark, sf_dir):
    return graph.pagerank(moves(spark, sf_dir), rounds=5).select("node", F.round("rank", 6).alias("rank"))


@query(
    f"WITH {STEPS}, v0 AS (SELECT 'purchase' AS node, 0::BIGINT AS value), v1 AS (SELECT m.target AS node, min(value + n) AS value FROM v0 JOIN moves m ON m.source = v0.node GROUP BY m.target),"
    " v2 AS (SELECT m.target AS node, min(value + n)::BIGINT AS value FROM v1 JOIN moves m ON m.source = v1.node GROUP BY m.target) SELECT node, value FROM v2"
)
def semiring_shortest(spark, sf_dir):
    rows = moves(spark, sf_dir).withColumnRenamed("n", "distance")
    return graph.semiring_walk(rows, spark.sql("SELECT 'purchase' AS node, 0L AS value"), "shortest", 2)


@query(
    f"WITH {STEPS}, w AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS weight FROM moves), v1 AS (SELECT target AS node, sum(weight) AS value FROM w WHERE source = 'purchase' GROUP BY target)"
    " SELECT w.target AS node, round(sum(value * weight), 6) AS value FROM v1 JOIN w ON w.source = v1.node GROUP BY w.target"
)
def semiring_sum(spark, sf_dir):
    from pyspark.sql import Window

    rows = moves(spark, sf_dir).withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    out = graph.semiring_walk(rows, spark.sql("SELECT 'purchase' AS node, 1D AS value"), "sum", 2)
    return out.select("node", F.round("value", 6).alias("value"))


@query(
    f"WITH {EDGES}, a1 AS (SELECT target AS node, 0.5::DOUBLE AS a FROM edges WHERE source = 'c1' GROUP BY target), a2 AS (SELECT e.target AS node, 0.25::DOUBLE AS a FROM edges e JOIN a1 ON e.source = a1.node GROUP BY e.target),"
    " u AS (SELECT 'c1' AS node, 1.0::DOUBLE AS a UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2) SELECT node AS target, max(a) AS activation FROM u GROUP BY node"
)
def spreading_activation(spark, sf_dir):
    return graph.spreading(edges(spark, sf_dir), spark.sql("SELECT 'c1' AS target, 1D AS activation"), 0.5, 0.25, 3)


SHARED = (
    "lines AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),"
    " shared AS MATERIALIZED (SELECT a.p AS source, b.p AS target FROM lines a JOIN lines b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p HAVING count(*) >= 2)"
)


def bought_together(spark, sf_dir):
    """Parts that two orders or more share."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col("a.o") == F.col("b.o")) & (F.col("a.p") < F.col("b.p")))
    return pairs.groupBy(F.col("a.p").alias("source"), F.col("b.p").alias("target")).count().where("count >= 2").drop("count")


@query(
    f"WITH RECURSIVE {SHARED}, e AS (SELECT source, target FROM shared UNION SELECT target, source FROM shared),"
    " r(node, other) AS (SELECT source, source FROM e UNION SELECT r.node, e.target FROM r JOIN e ON r.other = e.source) SELECT node, min(other) AS component FROM r GROUP BY node"
)
def connected_components(spark, sf_dir):
    return graph.connected(bought_together(spark, sf_dir))


@query(pagerank_sql(8, SHARED, "shared").replace("round(rank, 6)", "round(rank, 8)"))
def pagerank_parts(spark, sf_dir):
    """Ranks of parts that were bought together: hubs, dangling nodes and some depth."""
    return graph.pagerank(bought_together(spark, sf_dir), rounds=8).select("node", F.round("rank", 8).alias("rank"))


@query(f"WITH {SHARED} SELECT x.source AS a, x.target AS b, y.target AS c FROM shared x JOIN shared y ON x.target = y.source JOIN shared z ON z.source = x.source AND z.target = y.target")
def triangles(spark, sf_dir):
    return graph.triangles(bought_together(spark, sf_dir))


@query("SELECT c.c_name AS name, n.n_name AS nation FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' AND (c.c_acctbal > 5000 OR c.c_mktsegment IN ('BUILDING', 'MACHINERY')) AND NOT c.c_name LIKE '%7'")
def cypher_filters(spark, sf_dir):
    text = (
        "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation)-[:PART_OF]->(r:Region {r_name: 'ASIA'}) "
        "WHERE (c.c_acctbal > 5000 OR c.c_mktsegment IN ['BUILDING', 'MACHINERY']) AND NOT c.c_name LIKE '%7' "
        "RETURN c.c_name AS name, n.n_name AS nation"
    )
    return cypher(star_graph(spark, sf_dir), text)


@query("SELECT c_custkey AS id, count(*) AS orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderpriority) AS kinds FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' GROUP BY c_custkey ORDER BY total DESC, id LIMIT 20 OFFSET 10")
def cypher_aggregates(spark, sf_dir):
    text = (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_orderstatus <> $status "
        "RETURN c.c_custkey AS id, count(*) AS orders, sum(o.o_totalprice) AS total, count(DISTINCT o.o_orderpriority) AS kinds ORDER BY total DESC, id SKIP 10 LIMIT 20"
    )
    return cypher(star_graph(spark, sf_dir), text, {"status": "F"}).withColumn("total", F.round("total", 2))


@query("SELECT DISTINCT n_name AS name, p_brand AS brand FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size > 45")
def cypher_reverse(spark, sf_dir):
    text = "MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier)-[:SUPPLIES]->(p:Part) WHERE p.p_size > 45 RETURN DISTINCT n.n_name AS name, p.p_brand AS brand"
    return cypher(star_graph(spark, sf_dir), text)


@query(
    "WITH t AS (SELECT n_nationkey AS k, n_name AS name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 10)"
    " SELECT name, customers, count(s_suppkey) AS suppliers FROM t JOIN supplier ON s_nationkey = k GROUP BY name, customers"
)
def cypher_with(spark, sf_dir):
    text = (
        "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation) WITH n, count(c) AS customers WHERE customers > 10 "
        "MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_name AS name, customers, count(s) AS suppliers"
    )
    return cypher(star_graph(spark, sf_dir), text)


@query("SELECT r_name AS region, c_name AS customer, 2::BIGINT AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0")
def cypher_variable_length(spark, sf_dir):
    text = "MATCH (c:Customer)-[w:LOCATED_IN|PART_OF*1..2]->(r:Region) WHERE c.c_acctbal < 0 RETURN r.r_name AS region, c.c_name AS customer, w.hops AS hops"
    return cypher(star_graph(spark, sf_dir), text).withColumn("hops", F.col("hops").cast("long"))


@query("SELECT x AS k, n_name AS name FROM (SELECT unnest([1, 3, 5]) AS x) JOIN nation ON n_nationkey = x")
def cypher_unwind(spark, sf_dir):
    return cypher(star_graph(spark, sf_dir), "UNWIND [1, 3, 5] AS x MATCH (n:Nation) WHERE n.n_nationkey = x RETURN x AS k, n.n_name AS name")


HASH = lambda x: ", ".join(f"('0x' || substr(md5({x} || ':{i}'), 1, 8))::BIGINT AS {{0}}{i}" for i in (0, 1))
TRIPLES = (
    "trip AS (SELECT 'c' || o_custkey AS s, 'PLACED' AS p, 'o' || o_orderkey AS o FROM orders),"
    f" rec AS (SELECT s || '>' || o AS id, s, o, {HASH('s').format('x')}, {HASH('p').format('y')}, {HASH('o').format('z')} FROM trip)"
)


def triple_store(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("s"), F.lit("PLACED").alias("p"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("o"))
    return rows.select(
        F.concat_ws(">", "s", "o").alias("id"), "s", "o", fp.hash_words(F.col("s")).alias("x"), fp.hash_words(F.col("p")).alias("y"), fp.hash_words(F.col("o")).alias("z"),
        F.struct(F.lit(0.9).alias("f"), F.lit(0.6).alias("c")).alias("truth"),
    )


@query(f"WITH {TRIPLES} SELECT id, floor((bit_count(xor(r.x0, q.x0)) + bit_count(xor(r.x1, q.x1))) / 2.0)::BIGINT AS distance FROM rec r, (SELECT x0, x1 FROM rec WHERE s = 'c1' LIMIT 1) q WHERE floor((bit_count(xor(r.x0, q.x0)) + bit_count(xor(r.x1, q.x1))) / 2.0) <= 9")
def spo_forward(spark, sf_dir):
    out = triples.axis_query(triple_store(spark, sf_dir), ("x", fp.hash_words(F.lit("c1"))), ("y", fp.hash_words(F.lit("PLACED"))), 9, "strong")
    return out.select("id", "distance")


@query(f"WITH {TRIPLES} SELECT s AS subject, count(*) AS objects FROM rec GROUP BY s")
def spo_permutation(spark, sf_dir):
    return triple_store(spark, sf_dir).groupBy(F.col("s").alias("subject")).agg(F.count("*").alias("objects"))


NAMES = "dns AS (SELECT c_custkey AS id, ((r_regionkey + 1)::UBIGINT << 56) | ((n_nationkey + 1)::UBIGINT << 48) | ((c_custkey % 255 + 1)::UBIGINT << 40) AS dn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def named(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), names.name(F.col("n_regionkey"), F.col("n_nationkey"), F.col("c_custkey") % 255).alias("dn"))


@query(f"WITH {NAMES} SELECT id, dn::BIGINT AS dn, 3::BIGINT AS depth, (dn & ~((255::UBIGINT) << 40))::BIGINT AS parent, 2::BIGINT AS ancestors FROM dns")
def dn_navigation(spark, sf_dir):
    dn = F.col("dn")
    return named(spark, sf_dir).select("id", "dn", names.depth(dn).alias("depth"), names.parent(dn).alias("parent"), F.size(names.ancestors(dn)).cast("long").alias("ancestors"))


@query(f"WITH {NAMES} SELECT id FROM dns WHERE dn >> 56 = 2")
def dn_subtree(spark, sf_dir):
    return store.subtree(named(spark, sf_dir), F.col("dn"), 2 << 56).select("id")

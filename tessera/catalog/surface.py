"""What users call: further Cypher forms, the engine, the traversal builder, versions by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.graphs import EDGES, SHARED, bought_together
from tessera.catalog.signatures import NEAR, signed
from tessera.catalog.timelines import HISTORY, history, middle
from tessera.functions import fp
from tessera.operators import graph, versions
from tessera.plans.builder import Traversal
from tessera.plans.cypher import cypher
from tessera.plans.engine import Engine
from tessera.session import materialise
from tessera.sources.star import edges, table
from tessera.sources.star import graph as star_graph


@query("SELECT c_name AS name, upper(c_mktsegment) AS segment FROM customer WHERE c_name LIKE '%7' AND c_mktsegment ILIKE '%build%' AND c_acctbal IS NOT NULL AND c_name LIKE 'Cust%' AND contains(c_name, '#0')")
def cypher_strings(spark, sf_dir):
    text = (
        "MATCH (c:Customer) WHERE c.c_name ENDS WITH '7' AND c.c_mktsegment ILIKE '%build%' AND EXISTS(c.c_acctbal) AND c.c_name STARTS WITH 'Cust' AND c.c_name CONTAINS '#0'"
        " RETURN c.c_name AS name, toUpper(c.c_mktsegment) AS segment"
    )
    return cypher(star_graph(spark, sf_dir), text)


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 9")
def cypher_undirected(spark, sf_dir):
    """A hop in either direction, and a parameter."""
    return cypher(star_graph(spark, sf_dir), "MATCH (n:Nation)-[:PART_OF]-(r:Region) WHERE n.n_nationkey < $most RETURN n.n_name AS name, r.r_name AS region", {"most": 9})


@query("SELECT r_name AS region, array_to_string(list_sort(list(n_name)), ',') AS nations, max(n_nationkey) AS last FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def cypher_collect(spark, sf_dir):
    out = cypher(star_graph(spark, sf_dir), "MATCH (n:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS region, collect(n.n_name) AS nations, max(n.n_nationkey) AS last")
    return out.select("region", F.array_join(F.array_sort("nations"), ",").alias("nations"), "last")


@query(NEAR + "SELECT vec_id, round(1 - distance / 64.0::DOUBLE, 6) AS similarity FROM near WHERE 1 - distance / 64.0::DOUBLE >= 0.6 ORDER BY distance, vec_id LIMIT 12")
def engine_resonate(spark, sf_dir):
    """Similar rows of a registered table."""
    engine = Engine(spark)
    rows = signed(spark, sf_dir)
    engine.register("resonant", rows.where("vec_id <> 0"))
    out = engine.resonate("resonant", "words", F.lit(rows.where("vec_id = 0").head()["words"]), 0.6, "vec_id", 12)
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 4 AND c_acctbal > 100.5")
def engine_sql(spark, sf_dir):
    """SQL over an in-memory table, with named parameters."""
    engine = Engine(spark)
    engine.register("held_customers", table(spark, sf_dir, "customer"))
    return engine.sql("SELECT c_custkey, c_name FROM held_customers WHERE c_nationkey = :nation AND c_acctbal > :least", nation=4, least=100.5)


@query(
    f"WITH {EDGES}, p AS (SELECT a.source AS start, b.target, a.amplification * b.amplification AS amplification FROM edges a JOIN edges b ON a.target = b.source WHERE a.verb = 'LOCATED_IN' AND b.verb = 'PART_OF')"
    " SELECT start, target, 2::BIGINT AS depth FROM p WHERE amplification > 0.5 UNION ALL SELECT source, target, 1 FROM edges WHERE verb IN ('LOCATED_IN', 'PART_OF') AND amplification > 0.5 AND source LIKE 'c%'"
    " UNION ALL SELECT source, target, 1 FROM edges WHERE FALSE"
)
def traversal_builder(spark, sf_dir):
    rows = edges(spark, sf_dir)
    starts = rows.where("verb = 'LOCATED_IN'").select(F.col("source").alias("start"))
    out = Traversal(rows, starts.distinct()).along("LOCATED_IN", "PART_OF").depth(1, 2).amplifies(0.5).run()
    # suppliers are in nations too
    return out.where("start like 'c%' or depth = 2").select("start", "target", F.col("depth").cast("long").alias("depth"))


@query(
    f"WITH RECURSIVE {SHARED}, e AS (SELECT source, target FROM shared), r(node) AS (SELECT source FROM (SELECT min(source) AS source FROM e) UNION SELECT e.target FROM r JOIN e ON e.source = r.node),"
    " a AS (SELECT min(source) AS s FROM e) SELECT (SELECT count(*) FROM r) - 1 AS reached, (SELECT count(*) FROM e, a WHERE source = s) AS butterflies"
)
def impact(spark, sf_dir):
    """How many nodes a first part leads to, and its amplifying edges."""
    engine = Engine(spark)
    rows = materialise(bought_together(spark, sf_dir), "impact")
    first = rows.agg(F.min("source")).head()[0]
    starts = spark.range(1).select(F.lit(first).alias("start"))
    engine.register("impact_edges", rows.select("source", F.lit("NEAR").alias("verb"), "target"))
    reached = engine.reach("impact_edges", starts, 100).select("target").distinct()
    loud = rows.withColumn("verb", F.lit("AMPLIFIES")).withColumn("weight", F.lit(2.0))
    paths = graph.butterfly(loud, starts, 1.5, 1)
    return reached.agg(F.count("*").alias("reached")).crossJoin(paths.agg(F.count("*").alias("butterflies")))  # one row each


@query("WITH v AS (SELECT event_id AS version, ts FROM events), m AS (SELECT to_timestamp((epoch(min(ts)) + epoch(max(ts))) // 2) AT TIME ZONE 'UTC' AS m FROM events) SELECT max(version) AS version FROM v, m WHERE ts <= m")
def version_at_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("version"), F.col("ts").cast("timestamp").alias("ts"))
    return versions.version_at(rows, F.lit(middle(rows)))


@query(f"WITH {HISTORY}, i AS (SELECT user_id, event_type, value, version AS a, lead(version) OVER (PARTITION BY user_id, event_type ORDER BY version) AS b FROM history) SELECT user_id, event_type, value FROM i WHERE a <= 4 AND (b IS NULL OR b > 4)")
def visible_rows(spark, sf_dir):
    return versions.visible(versions.intervals(history(spark, sf_dir), ["user_id", "event_type"]), 4).select("user_id", "event_type", "value")


@query(f"WITH {EDGES} SELECT source, verb, target FROM edges WHERE source = 'c2' OR target = 'n3'")
def edges_of_nodes(spark, sf_dir):
    """Out-edges of one node and in-edges of another."""
    rows = edges(spark, sf_dir)
    return rows.where("source = 'c2' or target = 'n3'").select("source", "verb", "target")


@query(NEAR + "SELECT vec_id, distance FROM near WHERE distance <= 27")
def bounded_search(spark, sf_dir):
    """Through the query builder: rows at less than a distance."""
    engine = Engine(spark)
    rows = signed(spark, sf_dir)
    q = F.lit(rows.where("vec_id = 0").head()["words"])
    engine.register("bounded_rows", rows.where("vec_id <> 0"))
    return engine.query("bounded_rows").near("words", q, 28).run().select("vec_id", fp.hamming(F.col("words"), q).alias("distance"))

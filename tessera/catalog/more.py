"""Further operators: chains and changes of triples, deltas, gates, mutual neighbours, amplified paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.evidence import TRUTHS, truths
from tessera.catalog.graphs import EDGES, STEPS, moves
from tessera.catalog.signatures import NEAR, SIGS, H, against, signed
from tessera.catalog.timelines import HISTORY, history
from tessera.functions import fp, truth
from tessera.operators import evidence, graph, search, triples, versions
from tessera.session import materialise
from tessera.sources.star import edges, table


@query("SELECT 'c' || o_custkey || '>' || 'o' || o_orderkey AS id, count(DISTINCT l_partkey) AS followers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def spo_chain(spark, sf_dir):
    """Records whose subject is another record's object, one step of a walk."""
    rows = edges(spark, sf_dir).where("verb in ('PLACED', 'CONTAINS')")
    store = rows.select(F.concat_ws(">", "source", "target").alias("id"), fp.hash_words(F.col("source")).alias("x"), fp.hash_words(F.col("target")).alias("z"))
    links = triples.successors(store, 0)
    return links.groupBy("id").agg(F.count("*").alias("followers"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'removed' WHEN c_nationkey >= 20 THEN 'added' WHEN c_acctbal < 0 THEN 'modified' ELSE 'same' END AS change FROM customer")
def merkle_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = triples.digests(c.where("c_nationkey < 20"), "c_custkey", ["c_name", "c_acctbal"])
    new = c.where("c_nationkey >= 5").withColumn("c_acctbal", F.abs("c_acctbal"))
    return triples.changes(old, triples.digests(new, "c_custkey", ["c_name", "c_acctbal"]), "c_custkey")


@query(
    f"WITH {SIGS}, o AS (SELECT * FROM sigs WHERE label < 8), n AS (SELECT vec_id, CASE WHEN label = 4 THEN xor(w0, 3) ELSE w0 END AS w0, w1 FROM sigs WHERE label > 1)"
    " SELECT coalesce(o.vec_id, n.vec_id) AS vec_id, CASE WHEN o.vec_id IS NULL THEN 'created' WHEN n.vec_id IS NULL THEN 'deleted' ELSE 'changed' END AS change,"
    " CASE WHEN o.vec_id IS NULL THEN n.w0 WHEN n.vec_id IS NULL THEN o.w0 ELSE xor(o.w0, n.w0) END AS mask"
    " FROM o FULL JOIN n ON o.vec_id = n.vec_id WHERE o.vec_id IS NULL OR n.vec_id IS NULL OR o.w0 <> n.w0"
)
def xor_deltas(spark, sf_dir):
    rows = signed(spark, sf_dir).select("vec_id", "label", "words")
    changed = F.when(F.col("label") == 4, F.array(F.col("words")[0].bitwiseXOR(F.lit(3).cast("long")), F.col("words")[1])).otherwise(F.col("words"))
    out = versions.deltas(rows.where("label < 8"), rows.where("label > 1").withColumn("words", changed), ["vec_id"], "words")
    return out.select("vec_id", "change", F.col("mask")[0].alias("mask"))


@query(f"WITH {HISTORY} SELECT user_id, event_type, 2::BIGINT AS version, max(version) AS written FROM history GROUP BY user_id, event_type HAVING max(version) > 2 AND count(*) >= 2")
def version_conflicts(spark, sf_dir):
    """Reads of version 2 that later writes have overtaken."""
    rows = history(spark, sf_dir)
    reads = rows.where("version = 2").select("user_id", "event_type", "version")
    return versions.conflicts(reads, rows, ["user_id", "event_type"])


@query(
    f"WITH {STEPS}, w AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS weight FROM moves), v1 AS (SELECT target AS node, max(weight) AS value FROM w WHERE source = 'purchase' GROUP BY target)"
    " SELECT w.target AS node, round(max(value * weight), 6) AS value FROM v1 JOIN w ON w.source = v1.node GROUP BY w.target"
)
def semiring_best(spark, sf_dir):
    rows = moves(spark, sf_dir).withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    out = graph.semiring_walk(rows, spark.sql("SELECT 'purchase' AS node, 1D AS value"), "best", 2)
    return out.select("node", F.round("value", 6).alias("value"))


@query(f"WITH {STEPS}, v1 AS (SELECT DISTINCT target AS node FROM moves WHERE source = 'purchase') SELECT DISTINCT m.target AS node, TRUE AS value FROM v1 JOIN moves m ON m.source = v1.node")
def semiring_reachability(spark, sf_dir):
    return graph.semiring_walk(moves(spark, sf_dir), spark.sql("SELECT 'purchase' AS node, true AS value"), "reachability", 2)


@query(
    f"WITH {EDGES}, p AS (SELECT a.source AS start, b.target, a.amplification * b.amplification AS amplification FROM edges a JOIN edges b ON a.target = b.source WHERE a.verb = 'PLACED' AND b.verb = 'CONTAINS')"
    " SELECT start, target, count(*) AS paths, round(sum(amplification), 4) AS total FROM p WHERE amplification > 0.95 GROUP BY start, target"
)
def amplification_paths(spark, sf_dir):
    rows = edges(spark, sf_dir)
    starts = rows.where("verb = 'PLACED'").select(F.col("source").alias("start")).distinct()
    out = graph.paths(rows, starts, 2, 2, ["PLACED", "CONTAINS"]).where("amplification > 0.95")
    return out.groupBy("start", "target").agg(F.count("*").alias("paths"), F.round(F.sum("amplification"), 4).alias("total"))


@query(
    f"WITH {SIGS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, {H('a', 'b')} AS d FROM sigs a, sigs b WHERE a.vec_id <> b.vec_id),"
    " r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM p)"
    " SELECT x.a, x.b, x.rank AS forward, y.rank AS backward FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.rank <= 3 AND y.rank <= 3 AND x.a < x.b"
)
def reciprocal_topk(spark, sf_dir):
    """Pairs that are among each other's three nearest."""
    rows = signed(spark, sf_dir)
    top = search.nearest(rows, "vec_id", "words", 3)
    top = materialise(top.select("a", "b", F.col("rank").cast("long").alias("rank")), "nearest")
    back = top.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("rank").alias("backward"))
    return top.withColumnRenamed("rank", "forward").join(back, ["a", "b"]).where("a < b").select("a", "b", "forward", "backward")


@query(
    f"WITH {TRUTHS}, l AS (SELECT source, f, c, substr(source, 1, 4) AS g FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f DESC, source) AS k FROM l)"
    " SELECT g, round(CASE WHEN sum(f) > 0 THEN sum(f * f) / sum(f) ELSE 0.5 END, 6) AS f, round(CASE WHEN sum(f) > 0 THEN sum(f * c) / sum(f) ELSE 0.1 END, 6) AS c FROM r WHERE k <= 5 GROUP BY g"
)
def weighted_judgement(spark, sf_dir):
    rows = truths(spark, sf_dir).select(F.substring("source", 1, 4).alias("g"), "source", "t", F.col("t.f").alias("s"))
    out = evidence.judgement(rows, ["g"], "s", "t", "source")
    return out.select("g", F.round("f", 6).alias("f"), F.round("c", 6).alias("c"))


@query(
    "SELECT label, CASE WHEN stddev_pop(x) < 0.15 THEN 'flow' WHEN stddev_pop(x) > 0.35 THEN 'block' ELSE 'hold' END AS state FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label"
)
def dispersion_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.element_at("embedding", 1).cast("double").alias("x"))
    return rows.groupBy("label").agg(truth.dispersion_gate(F.stddev_pop("x")).alias("state"))


@query(NEAR + "SELECT s.vec_id, distance FROM near s, sigs q WHERE q.vec_id = 0 AND bit_count(xor(s.w0, q.w0)) <= 14 AND distance <= 28")
def staged_search(spark, sf_dir):
    """A stage over the first word, then the exact distance."""
    return search.staged(against(spark, sf_dir), "words", F.col("q"), [(0, 1, 14)], 28).select("vec_id", "distance")


@query(
    "WITH d AS (SELECT user_id, max(ts) AS ts, 0.5 * count(*) / 10.0 AS c FROM events GROUP BY user_id)"
    " SELECT user_id, round(c * 0.9, 6) AS c FROM d WHERE c * 0.9 >= 0.1 AND epoch(TIMESTAMP '2100-01-01') - floor(epoch(ts)) >= 60"
)
def expiry_and_decay(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"), (0.5 * F.count("*") / 10.0).alias("c"))
    out = versions.decayed(versions.expired(rows, "2100-01-01", 60), "c", 0.9)
    return out.select("user_id", F.round("c", 6).alias("c"))

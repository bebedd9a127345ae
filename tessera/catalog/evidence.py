"""Truth values over `labels`: a source's documents are evidence for and against its quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import fp, truth
from tessera.operators import causal, evidence
from tessera.sources.star import table

TRUTHS = (
    "truths AS (SELECT source, sum(quality)::DOUBLE AS p, sum(1 - quality)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source),"
    " t AS (SELECT source, p / (p + n) AS f, (p + n) / (p + n + 1.0) AS c FROM truths)"
)


def truths(spark, sf_dir):
    """(source, t)"""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sums = rows.where("source is not null").groupBy("source").agg(F.sum("quality").alias("p"), F.sum(1 - F.col("quality")).alias("n"))
    return sums.select("source", truth.from_evidence(F.col("p").cast("double"), F.col("n").cast("double")).alias("t"))


def pairs(spark, sf_dir):
    t = truths(spark, sf_dir)
    a, b = (t.withColumnsRenamed({"source": x, "t": f"t{x}"}) for x in "ab")
    return a.join(b, F.col("a") < F.col("b"))


def rule(name, f, c):
    sql = f"WITH {TRUTHS} SELECT a.source AS a, b.source AS b, round({f}, 6) AS f, round({c}, 6) AS c FROM t a JOIN t b ON a.source < b.source"

    def run(spark, sf_dir):
        out = getattr(truth, name)(F.col("ta"), F.col("tb"))
        return pairs(spark, sf_dir).withColumn("t", out).select("a", "b", F.round("t.f", 6).alias("f"), F.round("t.c", 6).alias("c"))

    run.__name__ = name
    query(sql)(run)


E = lambda x: f"(least({x}.c, 1.0 - 1.0 / 1001.0) / (1.0 - least({x}.c, 1.0 - 1.0 / 1001.0)))"
V = lambda x: f"(least({x}.c, 0.999) / (1.0 - least({x}.c, 0.999)))"
JOINT = "(a.f * b.f / greatest(a.f + b.f - a.f * b.f, 1.1920928955078125e-07))"
rule("truth_deduction", "a.f * b.f", "a.c * b.c * a.f * b.f")
rule("truth_induction", "b.f", "a.f * a.c * b.c")
rule("truth_abduction", "a.f", "b.f * a.c * b.c")
rule("truth_analogy", "a.f * b.f", "a.c * b.c * b.f")
rule("truth_comparison", JOINT, f"a.c * b.c * {JOINT}")
rule("truth_intersection", "a.f * b.f", "a.c * b.c")
rule("truth_union", "1.0 - (1.0 - a.f) * (1.0 - b.f)", "a.c * b.c")
rule("truth_revision", f"({E('a')} * a.f + {E('b')} * b.f) / ({E('a')} + {E('b')})", f"({E('a')} + {E('b')}) / ({E('a')} + {E('b')} + 1.0)")
rule("nars_induction", "b.f", "least(0.99, b.f)")
rule("nars_abduction", "a.f", "least(0.99, a.f)")
rule("nars_revision", f"({V('a')} * a.f + {V('b')} * b.f) / ({V('a')} + {V('b')})", f"least(0.99, ({V('a')} + {V('b')}) / ({V('a')} + {V('b')} + 1.0))")
rule("weak_induction", "a.f", "(b.f * a.c * b.c) / (b.f * a.c * b.c + 1.0)")


@query(f"WITH {TRUTHS} SELECT source, round(c * (f - 0.5) + 0.5, 6) AS expectation, f >= 0.7 AND c >= 0.5 AS strong FROM t")
def truth_gate(spark, sf_dir):
    t = F.col("t")
    return truths(spark, sf_dir).select("source", F.round(truth.expectation(t), 6).alias("expectation"), truth.gate(t, "strong").alias("strong"))


@query(
    "WITH e AS (SELECT lang, least(0.8, 1.0 - 1.0 / 1001.0) AS c, quality::DOUBLE AS f FROM labels JOIN documents USING (doc_id)),"
    " s AS (SELECT lang, sum(c / (1.0 - c) * f) AS p, sum(c / (1.0 - c) * (1.0 - f)) AS n, count(*) AS beliefs FROM e GROUP BY lang)"
    " SELECT lang, round(p / (p + n), 6) AS f, round((p + n) / (p + n + 1.0), 6) AS c, beliefs FROM s"
)
def truth_revision_agg(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.select("lang", truth.truth(F.col("quality"), F.lit(0.8)).alias("t"))
    out = evidence.revised(rows, ["lang"], "t")
    return out.select("lang", F.round("t.f", 6).alias("f"), F.round("t.c", 6).alias("c"), "beliefs")


@query(
    f"WITH {TRUTHS} SELECT a.source AS a, b.source AS b, CASE WHEN a.c * (a.f - 0.5) + 0.5 >= b.c * (b.f - 0.5) + 0.5 THEN a.source ELSE b.source END AS chosen FROM t a JOIN t b ON a.source < b.source"
)
def truth_choice(spark, sf_dir):
    first = truth.expectation(F.col("ta")) >= truth.expectation(F.col("tb"))
    return pairs(spark, sf_dir).select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"))


@query(
    "WITH r AS (SELECT source, quality::DOUBLE AS f FROM labels JOIN documents USING (doc_id)), n AS (SELECT source, count(*) AS beliefs, sum(f) AS ones FROM r GROUP BY source)"
    " SELECT source, beliefs, round(CASE WHEN beliefs < 2 THEN 1.0 ELSE 1.0 - ones * (beliefs - ones) / (beliefs * (beliefs - 1) / 2.0) END, 6) AS coherence FROM n"
)
def belief_coherence(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = evidence.coherence(rows.select("source", F.col("quality").cast("double").alias("f")), ["source"], "f")
    return out.select("source", "beliefs", F.round("coherence", 6).alias("coherence"))


HASHED = "[('0x' || substr(md5(CASE WHEN i < 7 THEN substr(source, 1, 4) ELSE source END || ':' || i), 1, 8))::BIGINT for i in range(0, 8)]"
APART = "list_sum([bit_count(xor(a.w[i], b.w[i])) for i in range(1, 9)])::BIGINT"


@query(
    f"WITH {TRUTHS}, s AS (SELECT *, {HASHED} AS w FROM t)"
    f" SELECT a.source AS a, b.source AS b, {APART} AS distance, round(abs(a.f - b.f), 6) AS conflict FROM s a JOIN s b ON a.source < b.source WHERE {APART} <= 16 AND abs(a.f - b.f) > 0.01"
)
def contradiction_pairs(spark, sf_dir):
    """Signatures of 256 bits, all but 32 of which come from the beginning of a source's name."""
    part = lambda i: F.substring("source", 1, 4) if i < 7 else F.col("source")
    word = lambda i: F.conv(F.substring(F.md5(F.concat(part(i), F.lit(f":{i}"))), 1, 8), 16, 10).cast("long")
    rows = truths(spark, sf_dir).withColumn("words", F.array(*(word(i) for i in range(8))))
    out = evidence.contradictions(rows, "source", "words", "t", 16, 0.01, 256)
    return out.select("a", "b", "distance", F.round("conflict", 6).alias("conflict"))


EDGES = (
    "counts AS (SELECT c_mktsegment AS state, o_orderpriority AS action, o_orderstatus AS outcome, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),"
    " edges AS (SELECT *, n / sum(n) OVER (PARTITION BY state, action) AS weight FROM counts)"
)


def causal_edges(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.groupBy(F.col("c_mktsegment").alias("state"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("outcome")).count()
    weight = F.col("count") / F.sum("count").over(Window.partitionBy("state", "action"))
    return rows.withColumn("weight", weight).withColumn("kind", F.lit("do"))


@query(f"WITH {EDGES} SELECT state, action, outcome, round(weight, 6) AS weight FROM edges WHERE state = 'BUILDING' AND action = '1-URGENT'")
def do_lookup(spark, sf_dir):
    out = causal.outcomes(causal_edges(spark, sf_dir), "BUILDING", "1-URGENT")
    return out.select("state", "action", "outcome", F.round("weight", 6).alias("weight"))


@query(f"WITH {EDGES} SELECT DISTINCT state FROM edges WHERE outcome = 'F' AND state IN (SELECT state FROM edges WHERE outcome = 'P')")
def confounders(spark, sf_dir):
    return causal.confounders(causal_edges(spark, sf_dir), "F", "P")


@query(
    f"WITH {EDGES} SELECT state, outcome, round(avg(weight) FILTER (WHERE action = '1-URGENT') - avg(weight) FILTER (WHERE action = '5-LOW'), 6) AS effect FROM edges GROUP BY state, outcome"
)
def average_effect(spark, sf_dir):
    out = causal.treatment_effect(causal_edges(spark, sf_dir), ["state", "outcome"], "1-URGENT", "5-LOW")
    return out.select("state", "outcome", F.round("effect", 6).alias("effect"))


@query(
    "WITH s AS (SELECT c_mktsegment, count(*) AS n, avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') - avg(o_totalprice) FILTER (WHERE o_orderpriority <> '1-URGENT') AS d"
    " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment) SELECT round(sum(n * d) / sum(n), 4) AS effect, count(*) AS strata FROM s WHERE d IS NOT NULL"
)
def backdoor_adjusted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = causal.adjusted_effect(orders, ["c_mktsegment"], F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))
    return out.select(F.round("effect", 4).alias("effect"), "strata")


@query(f"WITH {EDGES} SELECT state, action, outcome, round(max(weight) OVER (PARTITION BY state) - weight, 6) AS regret FROM edges")
def causal_regret(spark, sf_dir):
    return causal.regret(causal_edges(spark, sf_dir)).withColumn("regret", F.round("regret", 6))


@query(
    "WITH o AS (SELECT c_mktsegment AS s, o_orderpriority AS p, o_orderstatus AS y FROM orders JOIN customer ON o_custkey = c_custkey),"
    " ps AS (SELECT s, count(*) / sum(count(*)) OVER () AS q FROM o GROUP BY s), py AS (SELECT s, p, y, count(*) / sum(count(*)) OVER (PARTITION BY s, p) AS q FROM o GROUP BY s, p, y)"
    " SELECT y, round(sum(ps.q * py.q), 6) AS p FROM ps JOIN py USING (s) WHERE py.p = '1-URGENT' GROUP BY y"
)
def cpt_intervention(spark, sf_dir):
    """P(status | do(priority = urgent)) of the model segment -> priority -> status <- segment."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_mktsegment").alias("s"), F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("y"))

    def cpt(v, parents):
        rows = o.groupBy(*parents, v).count()
        return rows.select(*parents, v, (F.col("count") / F.sum("count").over(Window.partitionBy(*parents))).alias("p"))

    model = [("s", [], cpt("s", [])), ("pr", ["s"], cpt("pr", ["s"])), ("y", ["s", "pr"], cpt("y", ["s", "pr"]))]
    out = causal.marginal(causal.joint(causal.intervened(model, "pr", "1-URGENT")), ["y"])
    return out.select("y", F.round("p", 6).alias("p"))

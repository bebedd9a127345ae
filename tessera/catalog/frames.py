"""Further relational forms: outer and natural joins, all window functions, group frames, dates, arrays and maps, names of
the evidence rules in SQL text, parameters, and the query builder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import fp, names, truth
from tessera.operators import stats
from tessera.plans.builder import Query
from tessera.sources.star import table


def t(spark, sf_dir, *wanted):
    out = [table(spark, sf_dir, n) for n in wanted]
    return out if len(out) > 1 else out[0]


@query(
    "SELECT 'left' AS kind, c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey"
    " UNION ALL SELECT 'right', c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) RIGHT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey"
)
def join_left_right(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    o, on = o.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey")
    left = c.join(o, on, "left").select(F.lit("left").alias("kind"), "c_custkey", "o_orderkey")
    return left.union(c.where("c_nationkey < 5").join(o, on, "right").select(F.lit("right"), "c_custkey", "o_orderkey"))


@query("SELECT r_name, n_name, r_regionkey * 100 + n_nationkey AS pair FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    r, n = t(spark, sf_dir, "region", "nation")
    # two tables of fixed size
    return r.crossJoin(n).select("r_name", "n_name", (F.col("r_regionkey") * 100 + F.col("n_nationkey")).alias("pair"))


NATURAL = "SELECT k, c, s FROM (SELECT c_nationkey AS k, count(*) AS c FROM {} GROUP BY 1) NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM {} GROUP BY 1)"


@query(NATURAL.format("customer", "supplier"))
def join_natural(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    return spark.sql(NATURAL.format("{c}", "{s}"), c=c, s=s)


ANALYTIC = (
    "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, last_value(o_orderkey) OVER whole AS last, nth_value(o_orderkey, 2) OVER whole AS second"
    " FROM {} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), whole AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
)


@query(ANALYTIC.format("orders"))
def window_analytic(spark, sf_dir):
    return spark.sql(ANALYTIC.format("{orders}"), orders=t(spark, sf_dir, "orders"))


@query(
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS two,"
    " round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS rest FROM orders"
)
def window_groups(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", F.col("o_orderdate").cast("timestamp_ntz")))
    two = stats.over_groups(F.sum("o_totalprice"), ["o_custkey"], ["month"], -1, 0)
    rest = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(0, Window.unboundedFollowing)
    rows = stats.with_group_number(rows, ["o_custkey"], ["month"])
    return rows.select("o_orderkey", F.round(two, 2).alias("two"), F.round(F.sum("o_totalprice").over(rest), 2).alias("rest"))


@query(
    "SELECT o_orderkey, (o_orderdate + INTERVAL 10 DAY)::TIMESTAMP AS later, (o_orderdate - INTERVAL 1 MONTH)::TIMESTAMP AS earlier, strftime(o_orderdate, '%Y/%m/%d') AS said, strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d')::TIMESTAMP AS parsed,"
    " date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS days, o_orderdate < TIMESTAMP '1995-01-01' AS old, extract(quarter FROM o_orderdate)::INT AS quarter, extract(hour FROM o_orderdate)::INT AS hour, now() > o_orderdate AS past FROM orders"
)
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate").cast("timestamp_ntz")
    said = F.date_format(d, "yyyy/MM/dd")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", (d + F.expr("INTERVAL 10 DAY")).alias("later"), (d - F.expr("INTERVAL 1 MONTH")).alias("earlier"), said.alias("said"),
        F.to_timestamp_ntz(said, F.lit("yyyy/MM/dd")).alias("parsed"), F.date_diff(F.lit("2000-01-01").cast("date"), d.cast("date")).alias("days"),
        (d < F.lit("1995-01-01").cast("timestamp_ntz")).alias("old"), F.quarter(d).alias("quarter"), F.hour(d).alias("hour"), (F.now() > d.cast("timestamp")).alias("past"),
    )


@query(
    "WITH a AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS p FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_append(p, 'x'), ',') AS appended, array_to_string(list_sort(list_distinct(p)), ',') AS kinds,"
    " p[2] AS second, len(p) AS n, list_position(p, '5-LOW')::INT AS low, array_to_string(list_slice(p, 2, 3), ',') AS cut, array_to_string(list_reverse(p), ',') AS turned FROM a"
)
def array_forms(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("p"))
    said = lambda a: F.array_join(a, ",")
    return rows.select(
        "o_custkey", said(F.array_append("p", F.lit("x"))).alias("appended"), said(F.array_sort(F.array_distinct("p"))).alias("kinds"), F.try_element_at("p", F.lit(2)).alias("second"),
        F.size("p").cast("long").alias("n"), F.nullif(F.array_position("p", "5-LOW"), F.lit(0)).cast("int").alias("low"), said(F.slice("p", 2, 2)).alias("cut"), said(F.reverse("p")).alias("turned"),
    )


@query(
    "WITH m AS (SELECT o_custkey, o_orderstatus AS k, count(*) AS v FROM orders GROUP BY ALL), a AS (SELECT o_custkey, map_from_entries(list((k, v) ORDER BY k)) AS m FROM m GROUP BY 1)"
    " SELECT o_custkey, array_to_string(map_keys(m), ',') AS keys, list_sum(map_values(m))::BIGINT AS total, m['O'] AS open, cardinality(m)::INT AS n, map_contains(m, 'P') AS pending FROM a"
)
def map_functions(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("v"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))
    rows = rows.groupBy("o_custkey").agg(m.alias("m"))
    return rows.select(
        "o_custkey", F.array_join(F.map_keys("m"), ",").alias("keys"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.try_element_at("m", F.lit("O")).alias("open"), F.size("m").alias("n"), F.map_contains_key("m", "P").alias("pending"),
    )


@query(
    "SELECT s_suppkey, round(exp(s_acctbal / 10000), 6) AS e, round(log2(abs(s_acctbal) + 1), 6) AS l, round(log10(abs(s_acctbal) + 1), 6) AS t, sign(s_acctbal)::INT AS s, (s_suppkey % 7)::BIGINT AS m,"
    " greatest(s_acctbal, 100.0) AS g, least(s_acctbal, 100.0) AS k, round(s_acctbal, 1) AS r FROM supplier"
)
def more_math(spark, sf_dir):
    b = F.col("s_acctbal")
    return t(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(F.exp(b / 10000), 6).alias("e"), F.round(F.log2(F.abs(b) + 1), 6).alias("l"), F.round(F.log10(F.abs(b) + 1), 6).alias("t"), F.signum(b).cast("int").alias("s"),
        (F.col("s_suppkey") % 7).alias("m"), F.greatest(b, F.lit(100.0)).alias("g"), F.least(b, F.lit(100.0)).alias("k"), F.round(b, 1).alias("r"),
    )


@query("SELECT l_returnflag, abs(count(DISTINCT l_partkey) - count(DISTINCT l_partkey)) <= 0 AS near FROM lineitem GROUP BY 1")
def approximate_distinct(spark, sf_dir):
    """Whether the estimate is within a tenth of the exact count."""
    exact, rough = F.count_distinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.abs(rough - exact) <= 0.1 * exact).alias("near"))


@query(
    "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS var, min(value) AS low, max(value) AS high,"
    " round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY user_id"
)
def online_statistics(spark, sf_dir):
    out = stats.online(t(spark, sf_dir, "events"), ["user_id"], "value")
    return out.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"), "low", "high", *(F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")))


SQL_RULES = (
    "SELECT c_custkey, round({d}.f, 6) AS df, round({d}.c, 6) AS dc, round({i}.f, 6) AS nf, round({i}.c, 6) AS nc, round({a}.f, 6) AS af, round({a}.c, 6) AS ac, round({r}.f, 6) AS rf, round({r}.c, 6) AS rc"
    " FROM (SELECT c_custkey, c_custkey % 10 / 10.0 AS f, c_custkey % 9 / 10.0 AS c FROM customer)"
)


@query(
    "WITH x AS (SELECT c_custkey, c_custkey % 10 / 10.0::DOUBLE AS f, c_custkey % 9 / 10.0::DOUBLE AS c FROM customer), w AS (SELECT *, c / (1 - c) AS w, 0.5::DOUBLE / 0.5 AS v FROM x)"
    " SELECT c_custkey, round(f * 0.8, 6) AS df, round(f * 0.8 * c * 0.5, 6) AS dc, 0.8::DOUBLE AS nf, 0.8::DOUBLE AS nc, round(f, 6) AS af, round(least(0.99, f), 6) AS ac,"
    " round((w * f + v * 0.8) / (w + v), 6) AS rf, round(least(0.99, (w + v) / (w + v + 1)), 6) AS rc FROM w"
)
def sql_rules(spark, sf_dir):
    """The evidence rules under their names in SQL text."""
    fp.register(spark)
    t(spark, sf_dir, "customer").createOrReplaceTempView("rule_rows")
    made = {x: f"nars_{n}(f, c, 0.8D, 0.5D)" for x, n in zip("diar", ("deduction", "induction", "abduction", "revision"), strict=True)}
    text = SQL_RULES.format(**made).replace("FROM customer", "FROM rule_rows").replace("% 10 / 10.0 AS f", "% 10 / 10D AS f").replace("% 9 / 10.0 AS c", "% 9 / 10D AS c")
    return spark.sql(text)


@query(
    "WITH x AS (SELECT c_custkey, (c_custkey % 11) / 10.0::DOUBLE AS f, (c_custkey % 10) / 10.0::DOUBLE AS c, ['deduction', 'induction', 'abduction', 'analogy', 'other'][c_custkey % 5 + 1] AS rule FROM customer)"
    " SELECT c_custkey, rule, round(CASE rule WHEN 'deduction' THEN f * 0.7 WHEN 'induction' THEN 0.7 WHEN 'abduction' THEN f WHEN 'analogy' THEN f * 0.7 END, 6) AS f,"
    " round(CASE rule WHEN 'deduction' THEN c * 0.6 * f * 0.7 WHEN 'induction' THEN f * c * 0.6 WHEN 'abduction' THEN 0.7 * c * 0.6 WHEN 'analogy' THEN c * 0.6 * 0.7 END, 6) AS c,"
    " round(f * c * 0.6 / (f * c * 0.6 + 1), 6) AS weak, least(0.99, c + 0.6) AS store, round(1 - f, 6) AS negated FROM x"
)
def rules_by_name(spark, sf_dir):
    key = F.col("c_custkey")
    a = truth.truth((key % 11) / 10.0, (key % 10) / 10.0)
    b = truth.truth(F.lit(0.7), F.lit(0.6))
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*map(F.lit, ("deduction", "induction", "abduction", "analogy", "other"))), (key % 5).cast("int")).alias("rule"), a.alias("a"), b.alias("b"))
    made = truth.by_rule(F.col("rule"), F.col("a"), F.col("b"))
    return rows.select(
        "c_custkey", "rule", F.round(made["f"], 6).alias("f"), F.round(made["c"], 6).alias("c"), F.round(truth.weak_abduction(F.col("a"), F.col("b"))["c"], 6).alias("weak"),
        truth.capped_sum(F.col("a")["c"], F.col("b")["c"]).alias("store"), F.round(truth.truth_negation(F.col("a"))["f"], 6).alias("negated"),
    )


@query("SELECT c_custkey, CASE WHEN (c_custkey * 37) % 65536 // 256 < 16 THEN 'surface' WHEN (c_custkey * 37) % 65536 // 256 < 128 THEN 'fluid' ELSE 'node' END AS zone FROM customer ORDER BY 1")
def address_zones(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", names.zone((F.col("c_custkey") * 37) % 65536).alias("zone"))


@query("SELECT n_name, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 GROUP BY n_name ORDER BY n DESC, n_name LIMIT 7")
def builder_query(spark, sf_dir):
    """The query builder: join, filter, group, order, limit."""
    c, n = t(spark, sf_dir, "customer", "nation")
    out = Query(c).join(n, F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > 100")
    rows = out.run().groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return rows.orderBy(F.desc("n"), "n_name").limit(7)

"""Relational operators over the star schema: joins, grouping, windows, set operations, scalar families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.sources import store
from tessera.sources.star import table


def t(spark, sf_dir, *names):
    out = [table(spark, sf_dir, n) for n in names]
    return out if len(out) > 1 else out[0]


Q1 = (
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,"
    " round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"
)


@query(Q1)
def pricing_summary(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_inner(spark, sf_dir):
    c, o, li, s, n = t(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def join_outer(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, 'buys' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi_anti(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").select("c_custkey", F.lit("buys").alias("kind")).union(c.join(o, on, "left_anti").select("c_custkey", F.lit("idle")))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE length(r_name) > length(n_name)")
def join_theta(spark, sf_dir):
    r, n = t(spark, sf_dir, "region", "nation")
    return r.join(n, F.length("r_name") > F.length("n_name")).select("r_name", "n_name")


GROUPED = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {}(o_orderstatus, o_orderpriority)"


@query(GROUPED.format("ROLLUP"))
def rollup(spark, sf_dir):
    return t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(GROUPED.format("CUBE"))
def cube(spark, sf_dir):
    return t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@query(SETS.format("orders"))
def grouping_sets(spark, sf_dir):
    return spark.sql(SETS.format("{orders}"), orders=t(spark, sf_dir, "orders"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def having(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n >= 12")


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var, median(l_quantity) AS median, quantile_cont(l_extendedprice, 0.9) AS p90, mode(l_linenumber) FILTER (WHERE l_linenumber = 1) AS one, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def statistics(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_samp("l_quantity"), 6).alias("var"), F.median("l_quantity").alias("median"),
        F.percentile("l_extendedprice", 0.9).alias("p90"), F.mode(F.when(F.col("l_linenumber") == 1, F.col("l_linenumber"))).alias("one"),
        F.count_distinct("l_partkey").alias("parts"),
    )


RANKED = (
    "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after,"
    " first_value(o_orderkey) OVER w AS first FROM {} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
)


@query(RANKED.format("orders").replace("row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter", "(row_number() OVER w)::INT AS rn, (rank() OVER w)::INT AS rk, (dense_rank() OVER w)::INT AS dr, (ntile(4) OVER w)::INT AS quarter"))
def window_rank(spark, sf_dir):
    return spark.sql(RANKED.format("{orders}"), orders=t(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three, count(*) OVER (PARTITION BY o_custkey ORDER BY floor(epoch(o_orderdate))::BIGINT RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS month FROM orders")
def window_frame(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    rows = w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    span = w.orderBy(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).rangeBetween(-2592000, 0)
    return t(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(rows), 2).alias("three"), F.count("*").over(span).alias("month"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topn_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)"
    " UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except all', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)"
    " UNION ALL SELECT 'intersect all', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)"
)
def set_ops(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    a, b = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except all": a.exceptAll(b), "intersect all": a.intersectAll(b)}
    out = None
    for name, df in ops.items():
        df = df.select(F.lit(name).alias("op"), "k")
        out = df if out is None else out.union(df)
    return out


@query("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, substr(c_name, 1, 4) AS s, regexp_replace(c_name, '[0-9]+', '#') AS r, split_part(c_name, '#', 2) AS p, trim('  ' || c_mktsegment || ' ') AS t, length(c_name)::INT AS n, levenshtein(c_name, c_mktsegment)::INT AS d FROM customer WHERE c_name ILIKE 'cust%' AND contains(c_mktsegment, 'U')")
def string_functions(spark, sf_dir):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return t(spark, sf_dir, "customer").where(n.ilike("cust%") & m.contains("U")).select(
        "c_custkey", F.upper(n).alias("u"), F.lower(m).alias("l"), F.substring(n, 1, 4).alias("s"), F.regexp_replace(n, "[0-9]+", "#").alias("r"),
        F.split_part(n, F.lit("#"), F.lit(2)).alias("p"), F.trim(F.concat(F.lit("  "), m, F.lit(" "))).alias("t"), F.length(n).alias("n"), F.levenshtein(n, m).alias("d"),
    )


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, extract(year FROM o_orderdate)::INT AS year, count(*) AS n, max(date_diff('day', o_orderdate::DATE, DATE '1999-01-01'))::INT AS oldest FROM orders GROUP BY 1, 2")
def date_buckets(spark, sf_dir):
    d = F.col("o_orderdate").cast("timestamp_ntz")
    return t(spark, sf_dir, "orders").groupBy(F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), F.year(d).alias("year")).agg(
        F.count("*").alias("n"), F.max(F.date_diff(F.lit("1999-01-01").cast("date"), d.cast("date"))).alias("oldest")
    )


@query("SELECT s_suppkey, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 6) AS q, floor(s_acctbal)::BIGINT AS f, ceil(s_acctbal)::BIGINT AS c, round(ln(abs(s_acctbal) + 1), 6) AS g, round(pow(s_acctbal / 1000, 2), 6) AS p, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE coalesce(nullif('ok', 'no'), '-') END AS state FROM supplier")
def math_functions(spark, sf_dir):
    b = F.col("s_acctbal")
    return t(spark, sf_dir, "supplier").select(
        "s_suppkey", F.abs(b).alias("a"), F.round(F.sqrt(F.abs(b)), 6).alias("q"), F.floor(b).alias("f"), F.ceil(b).alias("c"), F.round(F.log(F.abs(b) + 1), 6).alias("g"),
        F.round(F.pow(b / 1000, 2), 6).alias("p"), F.when(b < 0, "debt").otherwise(F.coalesce(F.nullif(F.lit("ok"), F.lit("no")), F.lit("-"))).alias("state"),
    )


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.page')) AS pages FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.page")).alias("pages"))


@query("SELECT o_custkey, list_sort(list(o_orderkey)) [1] AS first, len(list(DISTINCT o_orderpriority))::INT AS kinds, list_contains(list(o_orderstatus), 'P') AS pending FROM orders GROUP BY o_custkey")
def array_functions(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("first"), F.size(F.collect_set("o_orderpriority")).alias("kinds"), F.array_contains(F.collect_set("o_orderstatus"), "P").alias("pending")
    )


@query("SELECT event_type, count(*) FILTER (WHERE extract(dow FROM ts) = 0) AS sunday, count(*) FILTER (WHERE extract(dow FROM ts) = 1) AS monday FROM events GROUP BY event_type")
def pivot(spark, sf_dir):
    rows = t(spark, sf_dir, "events").withColumn("d", F.dayofweek("ts"))
    return rows.groupBy("event_type").pivot("d", [1, 2]).count().fillna(0).withColumnsRenamed({"1": "sunday", "2": "monday"})


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey > 50 ORDER BY p_partkey LIMIT 25")
def cursor_page(spark, sf_dir):
    return store.page(t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 50, 25)


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://.*\\.example\\.net/en/.*$')")
def path_match(spark, sf_dir):
    return store.matching(t(spark, sf_dir, "pages").select("page_id", "url"), "url", "https://*.example.net/en/*")


@query("SELECT c_custkey, CASE WHEN n_regionkey = 2 THEN 'moved' ELSE c_mktsegment END AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def upsert(spark, sf_dir):
    c, n = t(spark, sf_dir, "customer", "nation")
    old = c.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.join(n.where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lit("moved").alias("segment"))
    return store.upsert(old, new, ["c_custkey"])

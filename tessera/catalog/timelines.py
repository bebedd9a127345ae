"""Versions, windows and learning over `events`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import response
from tessera.operators import learning, stats, versions
from tessera.sources.star import table
from tessera.streaming import windows

HISTORY = "history AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version, value FROM events)"


def history(spark, sf_dir):
    """Each (user, type)'s values by version."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(w).cast("long").alias("version"), "value")
    return rows.withColumn("deleted", F.lit(False))


KEYS = ["user_id", "event_type"]
AT = "a{0} AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY version DESC) AS r FROM history WHERE version <= {0}) WHERE r = 1)"


@query(f"WITH {HISTORY}, {AT.format(3)} SELECT * FROM a3")
def as_of(spark, sf_dir):
    return versions.as_of(history(spark, sf_dir), KEYS, 3).drop("version")


@query(f"WITH {HISTORY} SELECT user_id, event_type, version AS created_version, lead(version) OVER (PARTITION BY user_id, event_type ORDER BY version) AS deleted_version FROM history")
def version_intervals(spark, sf_dir):
    return versions.intervals(history(spark, sf_dir), KEYS).drop("value")


def seconds(ts):
    """Seconds since 1970 with their fraction, as a double."""
    return F.unix_micros(ts) / 1e6


def middle(rows):
    """The moment between the first ts and the last, to the microsecond."""
    mean = (seconds(F.min("ts")) + seconds(F.max("ts"))) / 2
    return rows.agg(F.timestamp_micros(F.rint(mean * 1e6).cast("long"))).head()[0]


def until(spark, sf_dir, share):
    """(user, value): each user's last event until a moment, a share of the way from the first event to the last."""
    rows = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = rows.agg(F.min("s").alias("first"), F.max("s").alias("last"))
    rows = rows.crossJoin(F.broadcast(ends)).where(F.col("s") <= F.col("first") + (F.col("last") - F.col("first")) * share / 100)  # ends is one row
    return rows.groupBy("user_id").agg(F.max_by("value", F.struct("s", "event_id")).alias("value"))


SIDE = "(SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events, (SELECT epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events) WHERE epoch_us(ts) <= first + (last - first) * {} / 100 GROUP BY user_id)"


@query(
    f"WITH o AS {SIDE.format(40)}, n AS {SIDE.format(80)} SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'removed' ELSE 'modified' END AS change, o.value AS old, n.value AS new"
    " FROM o FULL JOIN n ON o.user_id = n.user_id WHERE o.user_id IS NULL OR n.user_id IS NULL OR o.value IS DISTINCT FROM n.value"
)
def version_diff(spark, sf_dir):
    return versions.diff(until(spark, sf_dir, 40), until(spark, sf_dir, 80), ["user_id"], "value")


@query(f"WITH {HISTORY}, {AT.format(2)}, {AT.format(5)} SELECT a2.user_id, a2.event_type, 6::BIGINT AS version, a2.value, FALSE AS deleted FROM a2")
def rollback(spark, sf_dir):
    return versions.rollback(history(spark, sf_dir), KEYS, 2, 6)


@query(f"WITH o AS {SIDE.format(40)}, n AS {SIDE.format(80)} SELECT user_id, value FROM n UNION ALL SELECT user_id, value FROM o WHERE user_id NOT IN (SELECT user_id FROM n)")
def what_if(spark, sf_dir):
    overlay = until(spark, sf_dir, 80).withColumn("deleted", F.lit(False))
    return versions.what_if(until(spark, sf_dir, 40), overlay, ["user_id"])


def windowed_sql(size: int, slide: int) -> str:
    return (
        f"WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events), w AS (SELECT *, (s // {slide} - k) * {slide} AS a FROM e, range(0, {size // slide}) r(k))"
        f" SELECT make_timestamp(a * 1000000) AS start, make_timestamp((a + {size}) * 1000000) AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL"
    )


def times(df):
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), *[c for c in df.columns if c not in ("start", "end", "total", "lowest", "highest")], F.round("total", 4).alias("total"))


@query(windowed_sql(21600, 21600))
def tumbling(spark, sf_dir):
    return times(windows.windowed(table(spark, sf_dir, "events"), "ts", "6 hours", ["event_type"], "value"))


@query(windowed_sql(86400, 21600))
def sliding(spark, sf_dir):
    return times(windows.windowed(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value", slide="6 hours"))


@query(
    "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    " r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)"
    ' SELECT min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, run'
)
def session(spark, sf_dir):
    return times(windows.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], "value"))


@query(
    "SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 6) AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
)
def rolling_stats(spark, sf_dir):
    out = stats.rolling(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5, 0.5)
    return out.select("event_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(
    "WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY day) AS share FROM d)"
    " SELECT day::TIMESTAMP AS day, event_type, n, round(share - lag(share) OVER (PARTITION BY event_type ORDER BY day), 6) AS shift FROM s"
)
def distribution_shift(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return windows.distribution_shift(rows, "day", ["event_type"]).select("day", "event_type", "n", F.round("shift", 6).alias("shift"))


@query(
    "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS after FROM events)"
    " SELECT user_id, round(sum(0.1 * pow(0.9, after) * value), 6) AS q, count(*) AS visits FROM r GROUP BY user_id"
)
def q_values(spark, sf_dir):
    out = learning.q_values(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value"), 0.1)
    return out.select("user_id", F.round("q", 6).alias("q"), "visits")


@query(
    "SELECT user_id, round(ln(count(*)) - 0.5 * ln((SELECT max(floor(epoch(ts))::BIGINT) FROM events) - min(floor(epoch(ts))::BIGINT) + 1.0), 6) AS activation FROM events GROUP BY user_id"
)
def base_activation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    last = rows.agg(F.max("s").alias("last"))
    out = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("s").alias("first")).crossJoin(F.broadcast(last))  # one row
    return out.select("user_id", F.round(response.activation(F.col("n"), F.col("last") - F.col("first")), 6).alias("activation"))


PAIR = "WITH i AS (SELECT user_id, min(floor(epoch(ts))::BIGINT) AS s, max(floor(epoch(ts))::BIGINT) AS e FROM events GROUP BY user_id)"


@query(
    PAIR + " SELECT b.user_id, CASE WHEN a.e < b.s THEN 'before' WHEN a.e = b.s THEN 'meets' WHEN a.s > b.e THEN 'after' WHEN a.s = b.e THEN 'met by' WHEN a.s = b.s AND a.e = b.e THEN 'equals'"
    " WHEN a.s = b.s AND a.e < b.e THEN 'starts' WHEN a.s = b.s THEN 'started by' WHEN a.e = b.e AND a.s > b.s THEN 'finishes' WHEN a.e = b.e THEN 'finished by' WHEN a.s > b.s AND a.e < b.e THEN 'during'"
    " WHEN a.s < b.s AND a.e > b.e THEN 'contains' WHEN a.s < b.s THEN 'overlaps' ELSE 'overlapped by' END AS relation FROM i a, i b WHERE a.user_id = (SELECT min(user_id) FROM events)"
)
def allen_relations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    spans = rows.groupBy("user_id").agg(F.min("t").alias("s"), F.max("t").alias("e"))
    one = spans.orderBy("user_id").limit(1).select(F.col("s").alias("s0"), F.col("e").alias("e0"))
    relation = response.allen(F.col("s0"), F.col("e0"), F.col("s"), F.col("e"))
    return spans.crossJoin(F.broadcast(one)).select("user_id", relation.alias("relation"))  # one row

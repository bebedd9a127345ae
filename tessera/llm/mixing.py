"""Mixing sources to target weights by hash-threshold histograms.

A source's target is reached by whole copies of all its documents and, for the rest, by the documents whose hash is
under a threshold. Tokens are summed by source and hash bucket; the running sum finds the bucket that holds the
threshold, and only that bucket's documents are summed again by the next digits of the hash. No document is sorted.
After the last refinement the boundary bucket, one document as a rule, is taken if that is nearer to the target.

The choice depends on the ids and sizes alone, so reruns and any partitioning agree. A null text has size 0 and a null
source is a source of its own, last in order. Rows of one id share a hash and are taken together. A source without
tokens has target 0. An empty table gives an empty result. A document is taken at most twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: Words.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeated as often as needed, the share of all tokens to take, the most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Digits of the hash, by levels of refinement: 4096 buckets each.
LEVELS, DIGIT = 3, 12


def hashed(key: Column) -> Column:
    """36 bits of a document's hash."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":mix"))), 1, 9), 16, 10).cast("long")


def digit(level: int) -> Column:
    return F.shiftright("hash", DIGIT * (LEVELS - 1 - level)) % (1 << DIGIT)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with target: share of all tokens split by weight, at most `most` times a source's size;
    what is over goes to the others by weight. A target is the smaller of its limit and weight * level; the level is
    read off sums over the sources in the order in which they meet their limits."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    every = F.array(*(F.lit(w) for w in weights))
    rows = sources.withColumn("weight", F.get(every, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    rows = rows.withColumn("limit", F.col("source_size") * most)
    meets = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = meets.rowsBetween(Window.unboundedPreceding, -1)
    onwards = meets.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        / F.sum("weight").over(onwards),
    )
    rows = rows.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")))
    rows = rows.withColumn("level", F.first("open", ignorenulls=True).over(meets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """By source: source_size, target, whole copies, and the hash up to which documents are taken once more (-1: none).

    sizes: doc_id, source, size, hash."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = targets(sources, weights, share, most)
    at = at.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    at = at.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    at = at.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        bits = DIGIT * (LEVELS - level)
        # the documents of the boundary bucket, by the next digits
        inside = sizes.join(at.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.where(F.shiftright("hash", bits) == F.col("prefix"))
        sums = inside.groupBy("source", digit(level).alias("digit")).agg(F.sum("size").alias("tokens"))
        w = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("tokens").over(w)).withColumnRenamed("source", "s")
        sums = sums.join(at.select(F.col("source").alias("s2"), "below", "budget"), F.col("s").eqNullSafe(F.col("s2")))
        over = sums.where(F.col("below") + F.col("upto") > F.col("budget"))
        # the first bucket that goes over the budget; without one, a digit beyond the last
        edge = over.groupBy("s").agg(
            F.min_by(F.struct("digit", "tokens", (F.col("below") + F.col("upto")).alias("upto")), "digit").alias("edge")
        )
        at = at.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        found = F.col("edge").isNotNull()
        at = at.select(
            "source", "source_size", "target", "copies", "budget",
            F.when(found, F.col("prefix") * (1 << DIGIT) + F.col("edge.digit"))
            .otherwise((F.col("prefix") + 1) * (1 << DIGIT)).alias("prefix"),
            F.when(found, F.col("edge.upto") - F.col("edge.tokens")).otherwise(F.col("below")).alias("below"),
            F.when(found, F.col("edge.upto")).alias("upto"),
        )
        at = materialise(at, "thresholds")
    nearer = F.coalesce(F.col("upto") - F.col("budget") < F.col("budget") - F.col("below"), F.lit(False))
    # empty documents have any threshold above them, so a source already at its most copies has none
    upto = F.when(F.col("copies") < most, F.col("prefix") - 1 + nearer.cast("long")).otherwise(-1)
    return at.select("source", "source_size", "target", "copies", upto.alias("upto_hash"))


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, hash) of every document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    return materialise(rows.withColumn("hash", hashed(F.col("doc_id"))), "sizes")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes = sized(docs)
    at = thresholds(sizes).withColumnRenamed("source", "s")
    return sizes.join(at, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + (F.col("hash") <= F.col("upto_hash")).cast("long"))).alias("taken")
    )


def mixed(docs: DataFrame, most_sources: int = 10000) -> DataFrame:
    """The rows of docs, all columns as they are, as often as the mix takes them."""
    at = thresholds(sized(docs))
    # names that no input has
    own = {name: f"{name}_{uuid.uuid4().hex}" for name in ("source", "copies", "upto_hash", "turn")}
    at = materialise(at.select(*(F.col(name).alias(own[name]) for name in ("source", "copies", "upto_hash"))), "mix")
    if at.limit(most_sources + 1).count() <= most_sources:  # else the join shuffles
        at = F.broadcast(at)
    taken = F.col(own["copies"]) + (hashed(F.col("doc_id")) <= F.col(own["upto_hash"])).cast("long")
    out = docs.join(at, F.col("source").cast("string").eqNullSafe(F.col(own["source"])))
    return out.withColumn(own["turn"], F.explode(F.array_repeat(F.lit(0), taken.cast("int")))).select(*docs.columns)


MIX_SQL = r"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 9))::BIGINT AS hash FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    source_size * 2 AS cap, sum(source_size) OVER () AS total FROM sources),
levels AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
chosen AS (SELECT min(level) FILTER (WHERE level * weight <= cap) AS level FROM (
    SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r FROM levels)
    WHERE r = (SELECT min(r) FROM (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r FROM levels)
        WHERE level * weight <= cap)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(chosen.level * weight, cap::DOUBLE)) AS target FROM levels, chosen),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets),
rest AS (SELECT *, target - copies * source_size AS budget FROM budgets),
buckets AS (SELECT source, hash, sum(size)::BIGINT AS tokens FROM sizes GROUP BY source, hash),
running AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY hash) AS upto FROM buckets),
-- the first hash that goes over the budget is taken if that is nearer
edges AS (SELECT r.source, min(r.hash) AS hash FROM running r JOIN rest b ON r.source IS NOT DISTINCT FROM b.source
    WHERE r.upto > b.budget GROUP BY r.source),
limits AS (SELECT b.*, CASE WHEN e.hash IS NULL THEN 1::BIGINT << 40
    WHEN r.upto - b.budget < b.budget - (r.upto - r.tokens) THEN e.hash ELSE e.hash - 1 END AS upto_hash
    FROM rest b LEFT JOIN edges e ON b.source IS NOT DISTINCT FROM e.source
    LEFT JOIN running r ON r.source IS NOT DISTINCT FROM e.source AND r.hash = e.hash)
SELECT doc_id, size::BIGINT AS size, source_size, target, size * (copies + (hash <= upto_hash)::BIGINT) AS taken
FROM sizes s JOIN limits l ON s.source IS NOT DISTINCT FROM l.source"""

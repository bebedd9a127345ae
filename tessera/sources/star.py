"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all tables."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, verb, target, weight, amplification); ids are a prefix and the key."""
    read = lambda name: table(spark, sf_dir, name)
    one = F.lit(1.0)

    def made(df, source, verb, target, weight=one, amplification=one):
        (p, s), (q, t) = source, target
        return df.select(
            F.concat(F.lit(p), F.col(s).cast("string")).alias("source"), F.lit(verb).alias("verb"),
            F.concat(F.lit(q), F.col(t).cast("string")).alias("target"), weight.alias("weight"), amplification.alias("amplification"),
        )

    lines = read("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    supplies = read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    every = [
        made(read("nation"), ("n", "n_nationkey"), "PART_OF", ("r", "n_regionkey")),
        made(read("customer"), ("c", "c_custkey"), "LOCATED_IN", ("n", "c_nationkey")),
        made(read("supplier"), ("s", "s_suppkey"), "LOCATED_IN", ("n", "s_nationkey")),
        made(read("orders"), ("c", "o_custkey"), "PLACED", ("o", "o_orderkey")),
        made(lines, ("o", "l_orderkey"), "CONTAINS", ("p", "l_partkey"), F.col("q"), 1.0 - F.col("d")),
        made(supplies, ("s", "l_suppkey"), "SUPPLIES", ("p", "l_partkey"), F.col("q")),
    ]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


#: Labels: (table, id column). Relationships: (table, source column, target column, source label, target label).
LABELS = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"),
    "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"),
}
RELATIONSHIPS = {
    "PART_OF": ("nation", "n_nationkey", "n_regionkey", "Nation", "Region"),
    "LOCATED_IN": ("customer", "c_custkey", "c_nationkey", "Customer", "Nation"),
    "BASED_IN": ("supplier", "s_suppkey", "s_nationkey", "Supplier", "Nation"),
    "PLACED": ("orders", "o_custkey", "o_orderkey", "Customer", "Order"),
    "CONTAINS": ("lineitem", "l_orderkey", "l_partkey", "Order", "Part"),
    "SUPPLIES": ("lineitem", "l_suppkey", "l_partkey", "Supplier", "Part"),
}


def graph(spark: SparkSession, sf_dir: str):
    """The mapping of labels and relationship types to tables, for Cypher."""
    from tessera.plans.cypher import Graph

    out = Graph()
    for label, (name, key) in LABELS.items():
        out.node(label, table(spark, sf_dir, name), key)
    for kind, (name, source, target, a, b) in RELATIONSHIPS.items():
        out.relationship(kind, table(spark, sf_dir, name), source, target, a, b)
    return out

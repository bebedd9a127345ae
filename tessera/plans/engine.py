"""One surface for SQL, Cypher, similarity search and traversal over registered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fp
from tessera.operators import graph, search, versions
from tessera.plans.builder import Query, Traversal
from tessera.plans.cypher import Graph, cypher


class Engine:
    def __init__(self, spark: SparkSession, mapping: Graph | None = None):
        self.spark, self.mapping = spark, mapping or Graph()
        fp.register(spark)

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def sql(self, text: str, **params) -> DataFrame:
        """SQL with named parameters (:name)."""
        return self.spark.sql(text, args=params or None)

    def cypher(self, text: str, **params) -> DataFrame:
        return cypher(self.mapping, text, params)

    def query(self, name: str) -> Query:
        return Query(self.table(name))

    def resonate(self, name: str, words: str, query: Column, least: float, key: str, k: int, width: int = fp.WIDTH) -> DataFrame:
        """Rows of at least a similarity, most similar first."""
        rows = self.table(name).withColumn("similarity", fp.similarity(F.col(words), query, width))
        return rows.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(k)

    def vector_search(self, name: str, vector: str, query: Column, key: str, k: int, metric: str = "cosine") -> DataFrame:
        return search.vector_top_k(self.table(name), vector, query, key, k, metric)

    def traverse(self, edges: str, starts: DataFrame) -> Traversal:
        return Traversal(self.table(edges), starts)

    def reach(self, edges: str, starts: DataFrame, depth: int, verbs: list[str] | None = None, direction: str = "out") -> DataFrame:
        return graph.first_visit(self.table(edges), starts, depth, verbs, direction)

    def impact(self, edges: str, starts: DataFrame, amplification: float = 1.0) -> dict[str, int]:
        """How many nodes are reached within ten hops, and how many amplifying paths there are."""
        table = self.table(edges)
        return {
            "reached": graph.first_visit(table, starts, 10).select("target").distinct().count(),
            "butterflies": graph.butterfly(table, starts, amplification).count(),
        }

    def at_version(self, name: str, keys: list[str], version: int) -> DataFrame:
        return versions.as_of(self.table(name), keys, version)

    def fork(self, name: str, overlay: DataFrame, keys: list[str]) -> DataFrame:
        return versions.what_if(self.table(name), overlay, keys)

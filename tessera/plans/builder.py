"""A fluent query: select, join, filters on values, distance and similarity, order, limit, offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fp


class Query:
    def __init__(self, df: DataFrame):
        self.df = df

    def select(self, *columns) -> Query:
        return Query(self.df.select(*columns))

    def join(self, other: DataFrame, on, how: str = "inner") -> Query:
        return Query(self.df.join(other, on, how))

    def where(self, condition) -> Query:
        return Query(self.df.where(condition))

    def near(self, words: str, query: Column, distance: int) -> Query:
        """Rows at less than a distance."""
        return Query(self.df.where(fp.hamming(F.col(words), query) < distance))

    def similar(self, words: str, query: Column, similarity: float, width: int = fp.WIDTH) -> Query:
        """Rows at less than (1 - similarity) * width bits, cut to a whole number; the boundary is outside."""
        return self.near(words, query, int((1.0 - similarity) * width))

    def order_by(self, *columns) -> Query:
        return Query(self.df.orderBy(*columns))

    def limit(self, n: int) -> Query:
        return Query(self.df.limit(n))

    def offset(self, n: int) -> Query:
        return Query(self.df.offset(n))

    def run(self) -> DataFrame:
        return self.df


class Traversal:
    """causes(), depth(), amplifies(): compiled to paths."""

    def __init__(self, edges: DataFrame, starts: DataFrame):
        self.edges, self.starts, self.verbs, self.bounds, self.least = edges, starts, None, (1, 3), None

    def along(self, *verbs: str) -> Traversal:
        self.verbs = list(verbs)
        return self

    def causes(self) -> Traversal:
        return self.along("CAUSES")

    def depth(self, least: int, most: int) -> Traversal:
        self.bounds = (least, most)
        return self

    def amplifies(self, least: float) -> Traversal:
        self.least = least
        return self

    def run(self) -> DataFrame:
        from tessera.operators.graph import paths

        out = paths(self.edges, self.starts, *self.bounds, self.verbs)
        return out if self.least is None else out.where(F.col("amplification") > self.least)

"""Evidence over many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fp, truth


def revised(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """One truth value per group: revision adds evidence, so any order and any partial sums give the same."""
    positive, negative = truth.evidence(F.col(t))
    sums = df.groupBy(*keys).agg(F.sum(positive).alias("p"), F.sum(negative).alias("n"), F.count("*").alias("beliefs"))
    return sums.select(*keys, truth.from_evidence(F.col("p"), F.col("n")).alias(t), "beliefs")


def contradictions(df: DataFrame, key: str, words: str, t: str, most: int, conflict: float, bits: int = fp.WIDTH) -> DataFrame:
    """(a, b, distance, conflict, resolution): pairs of similar signatures, by the banded join, and different
    frequencies, with their revision."""
    from tessera.operators.search import similarity_join

    pairs = similarity_join(df, key, words, most, bits)
    own = df.select(F.col(key), F.col(t))
    pairs = pairs.join(own.withColumnsRenamed({key: "a", t: "ta"}), "a").join(own.withColumnsRenamed({key: "b", t: "tb"}), "b")
    pairs = pairs.withColumn("conflict", F.abs(F.col("ta.f") - F.col("tb.f"))).where(F.col("conflict") > conflict)
    return pairs.select("a", "b", "distance", "conflict", truth.truth_revision(F.col("ta"), F.col("tb")).alias("resolution"))


def coherence(df: DataFrame, keys: list[str], f: str) -> DataFrame:
    """1 less the mean of abs(f_i - f_j) over all pairs of a group; 1 for fewer than two rows. The sum over pairs is
    read off counts of the distinct values in order, so no pair is formed."""
    counts = df.groupBy(*keys, f).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(f).rowsBetween(Window.unboundedPreceding, -1)
    before, below = F.coalesce(F.sum("n").over(w), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col(f)).over(w), F.lit(0.0))
    gaps = counts.withColumn("gap", F.col("n") * (before * F.col(f) - below))
    n = F.sum("n")
    return gaps.groupBy(*keys).agg(
        n.alias("beliefs"), F.when(n < 2, 1.0).otherwise(1.0 - F.sum("gap") / (n * (n - 1) / 2.0)).alias("coherence")
    )


def judgement(df: DataFrame, keys: list[str], similarity: str, t: str, order: str, k: int = 5) -> DataFrame:
    """Per group the mean truth of the k most similar beliefs, weighted by similarity."""
    w = Window.partitionBy(*keys).orderBy(F.desc(similarity), order)
    top = df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    total = F.sum(similarity)
    return top.groupBy(*keys).agg(
        F.when(total > 0, F.sum(F.col(similarity) * F.col(f"{t}.f")) / total).otherwise(0.5).alias("f"),
        F.when(total > 0, F.sum(F.col(similarity) * F.col(f"{t}.c")) / total).otherwise(0.1).alias("c"),
    )

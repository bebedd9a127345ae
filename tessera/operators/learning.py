"""Learning updates over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q_values(steps: DataFrame, keys: list[str], order: list[str], reward: Column, alpha: float) -> DataFrame:
    """Per group the value after q + alpha * (reward - q) in order, from 0: a fold in one aggregate. In closed form
    a reward counts alpha * (1 - alpha)^(rewards after it), so sums may be partial and no group is collected."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    ranked = steps.withColumn("after", F.row_number().over(w) - 1)
    weight = alpha * F.pow(F.lit(1.0 - alpha), F.col("after"))
    return ranked.groupBy(*keys).agg(F.sum(weight * reward).alias("q"), F.count("*").alias("visits"))


def td_update(q: Column, reward: Column, best_next: Column, alpha: float, gamma: float) -> Column:
    """q + alpha * (reward + gamma * max q' - q); missing values are 0."""
    q, best_next = F.coalesce(q, F.lit(0.0)), F.coalesce(best_next, F.lit(0.0))
    return q + alpha * (reward + gamma * best_next - q)


def greedy(values: DataFrame, state: str, action: str, q: str) -> DataFrame:
    return values.groupBy(state).agg(F.max_by(action, F.struct(F.col(q), F.col(action))).alias(action))

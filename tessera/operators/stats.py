"""Statistics of distances and series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fp, response


def distribution(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """n, mean, sd (sample; 0 for one row) and normal percentiles by group."""
    out = df.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd")
    )
    return out.withColumns(response.percentiles(F.col("mean"), F.col("sd")))


def histogram(df: DataFrame, keys: list[str], d: str, width: float, bins: int = 16) -> DataFrame:
    """Counts by bin; values beyond the last bin count there."""
    at = F.least(F.floor(F.col(d) / (width / bins)), F.lit(bins - 1)).cast("long")
    return df.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Bits of a histogram: log2(N) - sum(n log2 n) / N."""
    total = F.sum(n)
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total).alias("entropy"))


def rolling(df: DataFrame, keys: list[str], order: list, d: str, n: int, coherent: float) -> DataFrame:
    """Mean, population sd, coefficient of variation of the last n values, and whether that is under `coherent`."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    out = df.withColumns({"mean": F.avg(d).over(w), "sd": F.stddev_pop(d).over(w)})
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0)
    return out.withColumn("cv", cv).withColumn("coherent", F.col("cv") < coherent)


def lagged(series: DataFrame, t: str, lags: list[int]) -> DataFrame:
    """(lag, t, now, later): each point of a series (t: 0, 1, ...; words) with the one a lag after it."""
    now = series.select(F.col(t), F.struct(*[c for c in series.columns if c != t]).alias("now"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    later = series.select((F.col(t)).alias("at"), F.struct(*[c for c in series.columns if c != t]).alias("later"))
    return now.join(later, F.col(t) + F.col("lag") == F.col("at")).select("lag", t, "now", "later")


def autocorrelation(series: DataFrame, t: str, words: str, lags: list[int]) -> DataFrame:
    """(lag, distance): mean distance of points a lag apart."""
    d = fp.hamming(F.col(f"now.{words}"), F.col(f"later.{words}"))
    return lagged(series.select(t, words), t, lags).groupBy("lag").agg(F.avg(d).alias("distance"))


def lag_effect(series: DataFrame, t: str, a: str, b: str, lags: list[int]) -> DataFrame:
    """By lag: does a predict b better than b itself? signal = mean d(b, b later) - mean d(a, b later), its pooled sd,
    effect size and standard error."""
    pairs = lagged(series.select(t, a, b), t, lags)
    cross = fp.hamming(F.col(f"now.{a}"), F.col(f"later.{b}"))
    auto = fp.hamming(F.col(f"now.{b}"), F.col(f"later.{b}"))
    out = pairs.groupBy("lag").agg(
        F.count("*").alias("n"), (F.avg(auto) - F.avg(cross)).alias("signal"),
        F.sqrt((F.coalesce(F.var_samp(cross), F.lit(1.0)) + F.coalesce(F.var_samp(auto), F.lit(1.0))) / 2).alias("pooled"),
    )
    effect = F.when(F.col("pooled") > 0, F.col("signal") / F.col("pooled")).otherwise(0.0)
    return out.withColumn("effect", effect).withColumn("error", F.col("pooled") / F.sqrt("n"))


def certified(effect: Column, signal: Column, error: Column, n: Column, least: int) -> Column:
    """Whether a lag effect holds: size, direction, a 95 % interval above 0, p under 0.01, enough points."""
    z = F.when(error > 0, signal / error).when(signal > 0, 10.0).otherwise(0.0)
    return (F.abs(effect) > 0.2) & (signal > 0) & (signal - 1.96 * error > 0) & (response.tail(z) < 0.01) & (n >= least)


def with_group_number(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with group_number, the number of each run of equal order values within its keys."""
    return df.withColumn("group_number", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))


def over_groups(value: Column, keys: list[str], order: list[str], first: int, last: int) -> Column:
    """An aggregate over a frame of groups of equal order values, by their numbers from with_group_number."""
    return value.over(Window.partitionBy(*keys).orderBy("group_number").rangeBetween(first, last))


def online(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample variance, extremes and exact quartiles by key."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.min(value).alias("low"), F.max(value).alias("high"), quartiles.alias("q")
    )
    return out.select(*keys, "n", "mean", "var", "low", "high", *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)))


def interval(mean: Column, sd: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of a confidence interval."""
    margin = z * sd / F.sqrt(n)
    return mean - margin, mean + margin


#: Checks that lead to each verdict. Fixed values.
VERDICTS = ((7, "accept", "use as is"), (5, "accept with caution", "verify manually"), (3, "review", "increase k"), (0, "reject", "discard"))


def validated(df: DataFrame, similarity: str, mean: str, sd: str, n: str, forward: str, backward: str, k: int, agreement: str) -> DataFrame:
    """df with z, p, effect, ci_low, ci_high, passed (of seven checks), score, verdict and advice of a match: significance,
    size of effect, mutual ranks, symmetry, agreement of methods, a narrow interval, no outlier."""
    z = response.z_score(F.col(similarity), F.col(mean), F.col(sd))
    low, high = interval(F.col(similarity), F.col(sd), F.col(n))
    rows = df.withColumn("z", z).withColumn("p", F.least(response.p_value(F.col("z")), F.lit(1.0))).withColumn("effect", F.col("z"))
    rows = rows.withColumn("ci_low", low).withColumn("ci_high", high)
    f, b = F.col(forward).cast("double"), F.col(backward).cast("double")
    mutual = (f <= k) & (b <= k)
    symmetry = F.least(f, b) / F.greatest(f, b)
    outlier = F.when(b > 3 * k, 0.5).otherwise(0.0)
    gap = F.col("ci_high") - F.col("ci_low")
    checks = [
        (F.col("p") < 0.05, 1.0 - F.col("p")), (F.abs(F.col("effect")) >= 0.2, F.least(F.abs(F.col("effect")), F.lit(2.0)) / 2.0), (mutual, 1.0 / F.greatest(f, b)),
        (symmetry >= 0.2, symmetry), (F.col(agreement) > 0.7, F.col(agreement)), (gap < 0.2, 1.0 - F.least(gap, F.lit(1.0))), (outlier < 0.1, 1.0 - outlier),
    ]
    passed, score = (sum(x[1:], x[0]) for x in ([c.cast("int") for c, _ in checks], [s for _, s in checks]))
    rows = rows.withColumn("passed", passed).withColumn("score", score / 7.0)
    said = [F.lit(None).cast("string")] * 2
    for least, verdict, advice in reversed(VERDICTS):
        said = [F.when(F.col("passed") >= least, word).otherwise(old) for word, old in zip((verdict, advice), said, strict=True)]
    return rows.withColumn("verdict", said[0]).withColumn("advice", said[1])


def pair_distances(df: DataFrame, key: str, words: str, count: int, word_bits: int = fp.WORD_BITS) -> DataFrame:
    """(key, n, mean, sd) of the distances of all pairs of a group's signatures, in one pass and without a pair: both moments
    follow from how often two bits are set together. n counts pairs; partial sums have bits^2 rows a group and task."""
    bits = count * word_bits
    kind = dict(df.dtypes)[key]

    def together(batches):
        held: dict = {}
        own_kind = None
        for batch in batches:
            own_kind = batch.schema.field("key").type
            flat = batch["words"].flatten().to_numpy(zero_copy_only=False).astype("<u8").reshape(-1, count)
            set_bits = np.concatenate([(flat[:, w : w + 1] >> np.arange(word_bits, dtype=np.uint64)) & np.uint64(1) for w in range(count)], axis=1).astype(np.float64)
            names = np.array(batch["key"].to_pylist(), dtype=object)
            for name in set(names.tolist()):
                own = set_bits[names == name]
                total, rows = held.get(name, (0.0, 0))
                held[name] = (total + own.T @ own, rows + len(own))
        for name, (total, rows) in held.items():
            at = np.arange(bits * bits + 1)
            n = np.append(total.ravel(), rows).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array([name] * len(at), own_kind), "at": at, "n": n})

    def moments(rows: pa.Table) -> pa.Table:
        n = np.zeros(bits * bits + 1)
        n[rows["at"].to_numpy()] = rows["n"].to_numpy()
        members, both = n[-1], n[:-1].reshape(bits, bits)
        ones = np.diag(both)
        left, right = ones[:, None] - both, ones[None, :] - both
        first = float((ones * (members - ones)).sum())
        second = float((both * (members - both - left - right) + left * right).sum())
        pairs = members * (members - 1) / 2
        sd = max(0.0, (second - first * first / pairs) / (pairs - 1)) ** 0.5 if pairs > 1 else 0.0
        return pa.table({"key": rows["key"][:1], "n": [int(pairs)], "mean": [first / pairs if pairs else None], "sd": [sd]})

    sums = df.select(F.col(key).alias("key"), F.col(words).alias("words")).mapInArrow(together, f"key {kind}, at long, n long")
    sums = sums.groupBy("key", "at").agg(F.sum("n").alias("n"))
    return sums.groupBy("key").applyInArrow(moments, f"key {kind}, n long, mean double, sd double").where("n > 0").withColumnRenamed("key", key)

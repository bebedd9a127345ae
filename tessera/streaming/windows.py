"""Event-time windows and stateful operators. Every function takes a DataFrame, batch or streaming alike, so a batch
run over the same rows is the stream's oracle."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """With a watermark if the rows are a stream and a delay is given."""
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def windowed(df: DataFrame, ts: str, size: str, keys: list[str], value: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones: start, end, keys, n, total, lowest, highest."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = late(df, ts, delay).groupBy(window.alias("w"), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "lowest", "highest")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], value: str, delay: str | None = None) -> DataFrame:
    """Runs of rows of a key with less than a gap between them."""
    out = late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def snapshots(df: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """Snapshot windows of batch rows: start, end, keys, value between each two changes of a key; the last has no end."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(ts)
    return df.select(F.col(ts).alias("start"), F.lead(ts).over(w).alias("end"), *keys, value)


def window_aggregate(df: DataFrame, ts: str, size: str, keys: list[str], aggregates: dict, delay: str | None = None) -> DataFrame:
    """Any aggregates of tumbling windows, by name."""
    out = late(df, ts, delay).groupBy(F.window(ts, size).alias("w"), *keys).agg(*(c.alias(name) for name, c in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


#: Phases of learning, in the order in which a session passes them. Fixed values.
PHASES = ("encounter", "struggle", "breakthrough", "apply", "reflect")
LOG = "session string, phase string, seen long, done boolean"


def learning_log(df: DataFrame, session: str, phase: str, order: str) -> DataFrame:
    """Where each session stands: a phase counts only once all before it were passed. A row for each session and batch."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, seen = state.get if state.exists else (-1, 0)
        for frame in frames:
            for name in frame.sort_values("o")["p"]:
                seen += 1
                if at + 1 < len(PHASES) and name == PHASES[at + 1]:
                    at += 1
        state.update((at, seen))
        yield pd.DataFrame([(keys[0], PHASES[at] if at >= 0 else None, seen, at == len(PHASES) - 1)], columns=["session", "phase", "seen", "done"])

    rows = df.select(F.col(session).cast("string").alias("session"), F.col(phase).alias("p"), F.col(order).alias("o"))
    return rows.groupBy("session").applyInPandasWithState(update, LOG, "at int, seen long", "update", GroupStateTimeout.NoTimeout)


EXPERIENCE = "agent string, state string, action string, q double, trace double, visits long"


def experience_updates(df: DataFrame, agent: str, order: str, alpha: float = 0.1, gamma: float = 0.9, kept: float = 0.8) -> DataFrame:
    """Q values with traces from (agent, state, action, reward, next_state), one after another for each agent: the error
    reward + gamma * max q(next_state) - q goes to all pairs by their traces, which fade by gamma * kept. A row for each pair
    of an agent and batch."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(s, a): (q, e, int(n)) for s, a, q, e, n in json.loads(state.get[0])} if state.exists else {}
        for frame in frames:
            for r in frame.sort_values("o").itertuples(index=False):
                best = max((q for (s, _), (q, _, _) in held.items() if s == r.n), default=0.0)
                held = {k: (q, e * gamma * kept, n) for k, (q, e, n) in held.items()}
                q, e, n = held.get((r.s, r.a), (0.0, 0.0, 0))
                held[r.s, r.a] = (q, e + 1.0, n + 1)
                error = r.r + gamma * best - q
                held = {k: (q + alpha * error * e, e, n) for k, (q, e, n) in held.items()}
        state.update((json.dumps([(s, a, *v) for (s, a), v in held.items()]),))
        yield pd.DataFrame([(keys[0], s, a, *v) for (s, a), v in sorted(held.items())], columns=[c.split()[0] for c in EXPERIENCE.split(", ")])

    rows = df.select(
        F.col(agent).cast("string").alias("agent"), F.col(order).alias("o"), F.col("state").alias("s"), F.col("action").alias("a"),
        F.col("reward").cast("double").alias("r"), F.col("next_state").alias("n"),
    )
    return rows.groupBy("agent").applyInPandasWithState(update, EXPERIENCE, "held string", "update", GroupStateTimeout.NoTimeout)


def distribution_shift(windows: DataFrame, order: str, keys: list[str], n: str = "n") -> DataFrame:
    """Change of each key's share from one window to the next (batch: windows are compared in order)."""
    from pyspark.sql import Window

    share = windows.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(order)))
    w = Window.partitionBy(*keys).orderBy(order)
    return share.withColumn("shift", F.col("share") - F.lag("share").over(w))


def ingest(spark: SparkSession, folder: str, schema, target: str, checkpoint: str, per_trigger: int = 16):
    """A query that appends every file that appears in a folder to a Parquet table, each batch once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own part
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVIDENCE = "key string, f double, c double, seen long"
#: Most confidence that evidence can add up to. Fixed value.
MOST = 0.99


def evidence_updates(df: DataFrame, key: str, f: str, c: str, order: str, ttl_ms: int | None = None) -> DataFrame:
    """Running truth of each key: a new truth is weighed in by its confidence, and confidences add up to at most 0.99. A key
    that is silent for ttl_ms is forgotten. A row for each key and batch; rows of a batch count in their order."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f, c, seen = state.get if state.exists else (0.5, 0.0, 0)
        for frame in frames:
            for row in frame.sort_values("o").itertuples(index=False):
                f = (f * c + row.f * row.c) / (c + row.c) if c + row.c > 0 else f
                c, seen = min(MOST, c + row.c), seen + 1
        state.update((f, c, seen))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(keys[0], f, c, seen)], columns=["key", "f", "c", "seen"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(f).cast("double").alias("f"), F.col(c).cast("double").alias("c"), F.col(order).alias("o"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(update, EVIDENCE, "f double, c double, seen long", "update", timeout)


def count_windows(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """Mean, population sd and coefficient of variation of the last `size` values of each key, a row for each batch."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            held = (held + frame["v"].astype(float).tolist())[-size:]
        state.update((held,))
        mean = sum(held) / len(held)
        sd = (sum((x - mean) ** 2 for x in held) / len(held)) ** 0.5
        yield pd.DataFrame([(keys[0], len(held), mean, sd, sd / mean if mean > 0 else 0.0)], columns=["key", "n", "mean", "sd", "cv"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(
        update, "key string, n long, mean double, sd double, cv double", "held array<double>", "update", GroupStateTimeout.NoTimeout
    )

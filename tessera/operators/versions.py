"""Versioned tables: append-only rows (key, version, value..., deleted) and what can be read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(history: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The rows visible at a version: each key's last row by then, unless it is a deletion."""
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    rows = history.where(F.col("version") <= version).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return rows.where("not deleted").drop("deleted")


def intervals(history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with created_version and deleted_version (null while current); deletions end their predecessor."""
    w = Window.partitionBy(*keys).orderBy("version")
    rows = history.withColumn("deleted_version", F.lead("version").over(w)).where("not deleted").drop("deleted")
    return rows.withColumnRenamed("version", "created_version")


def visible(rows: DataFrame, version: int) -> DataFrame:
    return rows.where((F.col("created_version") <= version) & (F.col("deleted_version").isNull() | (F.col("deleted_version") > version)))


def version_at(versions: DataFrame, moment) -> DataFrame:
    """The last version that was there at a moment."""
    return versions.where(F.col("ts") <= moment).agg(F.max("version").alias("version"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change, old, new): added, removed or modified rows."""
    both = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("was")).join(
        new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("now")), keys, "full_outer"
    )
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.withColumn("change", kind).where("change is not null").select(*keys, "change", "old", "new")


def rollback(history: DataFrame, keys: list[str], to: int, as_version: int) -> DataFrame:
    """Rows to append so that the table at as_version is as it was at version `to`: old rows again, and deletions of
    keys that were not there."""
    then = as_of(history, keys, to)
    now = as_of(history, keys, as_version - 1)
    values = [c for c in history.columns if c not in (*keys, "version", "deleted")]
    back = then.select(*keys, F.lit(as_version).cast("long").alias("version"), *values, F.lit(False).alias("deleted"))
    gone = now.join(then, keys, "left_anti").select(*keys, F.lit(as_version).cast("long").alias("version"), *values, F.lit(True).alias("deleted"))
    return back.unionByName(gone)


def what_if(base: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """A branch: the overlay's rows in place of the base's of the same keys; overlay rows that are deleted hide them."""
    kept = base.join(overlay.select(*keys), keys, "left_anti")
    return kept.unionByName(overlay.where("not deleted").drop("deleted"))


#: What a merge does with a key that both sides changed.
STRATEGIES = ("last", "first", "custom", "xor", "reject")


def merged(ours: DataFrame, theirs: DataFrame, ancestor: DataFrame, keys: list[str], words: str, strategy: str = "xor", custom=None) -> DataFrame:
    """Three-way merge: (keys, words, conflict). A key that one side added, changed or deleted is as that side has it. One
    that both changed, to different ends, is a conflict: `last` takes theirs, `first` ours, `custom` what custom(base, ours,
    theirs) gives, `xor` applies both changes to the ancestor, `reject` keeps the ancestor. A deletion against a change is
    the change. Deleted keys are no rows."""
    from tessera.functions import fp

    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    every = None
    for name, side in (("base", ancestor), ("ours", ours), ("theirs", theirs)):
        side = side.select(*keys, F.col(words).alias(name))
        every = side if every is None else every.join(side, keys, "full_outer")
    base, a, b = F.col("base"), F.col("ours"), F.col("theirs")
    changed_a, changed_b = ~a.eqNullSafe(base), ~b.eqNullSafe(base)
    conflict = changed_a & changed_b & ~a.eqNullSafe(b) & a.isNotNull() & b.isNotNull()
    empty = F.transform(a, lambda x: F.lit(0).cast("long"))
    both = {
        "last": lambda: b, "first": lambda: a, "reject": lambda: base, "custom": lambda: custom(base, a, b),
        "xor": lambda: fp.bind(fp.bind(F.coalesce(base, empty), a), b),
    }[strategy]()
    out = F.when(conflict, both).when(changed_a & (a.isNotNull() | ~changed_b), a).when(changed_b, b).otherwise(base)
    return every.select(*keys, out.alias(words), conflict.alias("conflict")).where(F.col(words).isNotNull())


def discarded(rows: DataFrame, branch: str, name: str) -> DataFrame:
    """The rows of all branches but one."""
    return rows.where(F.col(branch) != F.lit(name))


def branch_merged(history: DataFrame, overlay: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The history with a branch's overlay committed as a version: its rows are appended, deletions included."""
    return history.unionByName(overlay.withColumn("version", F.lit(version).cast("long")).select(*history.columns))


def read_at(current: DataFrame, log: DataFrame, keys: list[str], words: str, version: int) -> DataFrame:
    """The table as it was at a version: the exclusive or of all later masks undoes them, in any order. log: keys, version,
    change (created, deleted, changed), mask, as deltas() makes them for each version."""
    from tessera.functions import fp

    later = log.where(F.col("version") > version)
    # how a key stood is told by its first later change; the masks undo one another
    first = later.groupBy(*keys).agg(F.min_by("change", "version").alias("change"))
    undo = fp.combined(later.select(*keys, F.col("mask").alias("undo")), keys, "undo")
    rows = current.select(*keys, words).join(undo.join(first, keys), keys, "full_outer")
    then = F.when(F.col("undo").isNull(), F.col(words)).when(F.col("change") == "created", F.lit(None)).otherwise(
        F.when(F.col(words).isNull(), F.col("undo")).otherwise(fp.bind(F.col(words), F.col("undo")))
    )
    return rows.select(*keys, then.alias(words)).where(F.col(words).isNotNull())


LEVELS = ("read committed", "repeatable read", "serializable")


def readable(history: DataFrame, keys: list[str], began: int, now: int, level: str) -> DataFrame:
    """What a transaction that began at a version sees at a later one: its own start, unless it reads what is committed."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    return as_of(history, keys, now if level == LEVELS[0] else began)


def committed(history: DataFrame, writes: DataFrame, reads: DataFrame | None, keys: list[str], began: int, level: str = "serializable") -> DataFrame:
    """The history with a transaction's writes at the next version. A serializable one fails if what it read has a newer
    version, any one if what it writes has."""
    newer = history.where(F.col("version") > began).select(*keys, "version")
    checked = [writes] + ([reads] if reads is not None and level == LEVELS[2] else [])
    for rows in checked:
        if not rows.select(*keys).join(newer, keys, "left_semi").isEmpty():
            raise RuntimeError("conflict: a newer version exists")
    last = history.agg(F.coalesce(F.max("version"), F.lit(0))).head()[0]
    return history.unionByName(writes.withColumn("version", F.lit(last + 1).cast("long")).select(*history.columns))


TIERS = ["cold", "warm", "hot"]


def moved(rows: DataFrame, tier: str, up: bool, where) -> DataFrame:
    """Rows that meet a condition one tier up or down; the highest and lowest stay."""
    turned = TIERS if up else TIERS[::-1]
    step = F.col(tier)
    for a, b in zip(turned[:-1], turned[1:], strict=True):
        step = F.when(F.col(tier) == a, b).otherwise(step)
    return rows.withColumn(tier, F.when(where, step).otherwise(F.col(tier)))


def suppressed(rows: DataFrame, keys: DataFrame, on: list[str], c: str) -> DataFrame:
    """Rows of the keys keep no confidence, all others theirs."""
    flagged = rows.join(keys.select(*on).distinct().withColumn("hidden_key", F.lit(True)), on, "left")
    return flagged.withColumn(c, F.when(F.col("hidden_key"), 0.0).otherwise(F.col(c))).drop("hidden_key")


def deltas(old: DataFrame, new: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, change, mask): created and deleted rows with their words, changed ones with the exclusive or."""
    from tessera.functions import fp

    both = old.select(*keys, F.col(words).alias("o")).join(new.select(*keys, F.col(words).alias("n")), keys, "full_outer")
    kind = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed")
    mask = F.when(F.col("o").isNull(), F.col("n")).when(F.col("n").isNull(), F.col("o")).otherwise(fp.bind(F.col("o"), F.col("n")))
    return both.select(*keys, kind.alias("change"), mask.alias("mask")).where("change is not null")


def applied(base: DataFrame, changes: DataFrame, keys: list[str], words: str) -> DataFrame:
    """The table after a set of deltas."""
    from tessera.functions import fp

    both = base.select(*keys, F.col(words).alias("o")).join(changes, keys, "full_outer")
    after = F.when(F.col("change").isNull(), F.col("o")).when(F.col("change") == "created", F.col("mask")).when(
        F.col("change") == "changed", fp.bind(F.col("o"), F.col("mask"))
    )
    return both.select(*keys, after.alias(words)).where(F.col(words).isNotNull())


def conflicts(reads: DataFrame, writes: DataFrame, keys: list[str]) -> DataFrame:
    """Reads (keys, version) of a transaction that a newer committed write has overtaken."""
    newest = writes.groupBy(*keys).agg(F.max("version").alias("written"))
    return reads.join(newest, keys).where("written > version")


def expired(rows: DataFrame, moment, ttl_seconds: int) -> DataFrame:
    return rows.where(F.unix_timestamp(F.lit(moment).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")) >= ttl_seconds)


def decayed(rows: DataFrame, c: str, factor: float, least: float = 0.1) -> DataFrame:
    """Confidence times a factor; rows that fall under `least` go."""
    return rows.withColumn(c, F.col(c) * factor).where(F.col(c) >= least)

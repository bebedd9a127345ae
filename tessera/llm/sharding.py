"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, from an offset and a skip that its name gives.
Shards take turns, each claiming its next free slot of its permutation, until the table is full; a shard of weight w
takes w turns in a row. A row's place is the shard of the slot that its key hashes to: one lookup in a broadcast
table whose size is a parameter, whatever the number of rows. When a shard leaves, nearly all other keys stay.

A null key is the key ''. Rows of one key share a shard, unless `most` is given: then a key with more rows is spread
over as many sub-keys as it has multiples of `most`, by the hash of another column. Every row is kept, repeated ones
too; an empty table gives an empty result. New columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: 128 shards, and a prime more than 500 times as large, which keeps shares within about 1 %.
SHARDS = [f"shard-{i:03d}" for i in range(128)]
SIZE = 65537


def digest(text: str) -> int:
    """60 bits of a key's hash."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """Index of the shard of each slot. size must be prime and at least the number of shards."""
    if size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table's size must be a prime of at least {len(shards)}: {size}")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be one or more distinct names")
    turns = [i for i, s in enumerate(shards) for _ in range((weights or {}).get(s, 1))]
    if not turns:
        raise ValueError("all weights are 0")
    at = [digest(f"{s}:offset") % size for s in shards]
    skip = [digest(f"{s}:skip") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in turns[:left]:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
    return table


def table_rows(spark: SparkSession, shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """(slot, shard): size rows, made from one literal."""
    table = ",".join(map(str, lookup_table(shards, size, weights)))
    names = F.array(*(F.lit(s) for s in shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "i"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("i").cast("int")).alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % size


def place(
    df: DataFrame, key: str, shards: list[str] = SHARDS, size: int = SIZE, weights: dict[str, int] | None = None,
    most: int | None = None, spread_by: str | None = None,
) -> DataFrame:
    """df with slot and shard."""
    full = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = df.drop("slot", "shard")
    if most:
        # names that no input has
        whole, parts = (f"{name}_{uuid.uuid4().hex}" for name in ("key", "parts"))
        many = df.select(full.alias(whole)).groupBy(whole).count().where(F.col("count") > most)
        many = many.select(whole, F.ceil(F.col("count") / most).alias(parts))
        out = out.withColumn(whole, full).join(many, whole, "left")
        part = F.pmod(F.xxhash64(spread_by or key), F.col(parts))
        full = F.concat_ws("/", F.col(whole), part.cast("string"))
    out = out.withColumn("slot", slot_of(full, size))
    # as many rows as the table has slots
    return out.join(F.broadcast(table_rows(df.sparkSession, shards, size, weights)), "slot").select(
        *[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard"
    )


def place_sql(table: str, key: str, shards: list[str] = SHARDS, size: int = SIZE) -> str:
    """The same in DuckDB, with the lookup table as a literal."""
    slots, names = (", ".join(map(str, x)) for x in (lookup_table(shards, size), (f"'{s}'" for s in shards)))
    return f"""
WITH lookup AS (SELECT [{slots}] AS slots, [{names}] AS names),
placed AS (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM {table})
SELECT {key}, slot, names[slots[slot + 1] + 1] AS shard FROM placed, lookup"""

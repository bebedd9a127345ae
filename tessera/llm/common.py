"""What several operators of this subpackage share: tables in the cluster's shared folder, a row filter of fixed
size, connected components, and ways to walk an Arrow batch."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a Python worker.
PIECE = 1 << 20
#: Rows, and bytes, of an Arrow batch on its way to a Python worker: the default of 10,000 rows has no bound in bytes
#: where texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session has been told to keep Arrow batches within BATCH; smaller settings stay."""
    conf = df.sparkSession.conf
    for name, most in BATCH.items():
        now = conf.get(name, str(most + 1))
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or else the context's
    checkpoint folder; a local session that has neither (tests) gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    option = context._jsc.sc().getCheckpointDir()
    if not option.isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        option = context._jsc.sc().getCheckpointDir()
    return option.get().rstrip("/")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(rows: Callable) -> Callable:
    """A function of Arrow batches that gives freed memory back to the system when a task ends: workers live on between
    tasks, beside the executor's heap."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def process_cache(key, make: Callable):
    """make() once for each Python process; functions sent by value have no module state that lasts."""
    kept = sys.__dict__.setdefault("_tessera_cache", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with at most `limit` bytes of text; a longer row comes alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, before + limit, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def bitmap_position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bitmap(wanted: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap of the hashes of wanted's keys as at most 2^bits / 64 rows (word, flags)."""
    at = wanted.select(bitmap_position(F.col(key), bits).alias("at"))
    return at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("flags"))


def flag_by_bitmap(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, flag: str, bits: int = 22) -> DataFrame:
    """df with a boolean column: false only if the row's key is surely not among wanted's. The broadcast side has
    at most 2^bits / 64 rows (1 MB at 22 bits), whatever the size of wanted."""
    # names that no input has
    at, word, flags = (f"{name}_{uuid.uuid4().hex}" for name in ("at", "word", "flags"))
    words = bitmap(wanted, wanted_key, bits).withColumnsRenamed({"word": word, "flags": flags})
    out = df.withColumn(at, bitmap_position(F.col(key), bits))
    out = out.join(F.broadcast(words), F.expr(f"shiftright({at}, 6)") == F.col(word), "left")
    hit = F.expr(f"coalesce(shiftright({flags}, cast({at} & 63 as int)) & 1, 0) = 1")
    return out.select(*df.columns, hit.alias(flag))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the undirected links (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star steps, which keep the number of links, until the links form stars.
    Nothing is collected but one number of each round; a node with very many links is aggregated before its
    shuffle and joined back with a join that adaptive execution can split.
    """
    links = links.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct()
    links = materialise(links, "links")
    while True:
        # no node may have two links downwards, nor be both an end and a centre
        up = links.groupBy("a").count()
        centres = links.select(F.col("b").alias("a")).distinct()
        if up.where("count > 1").select("a").union(up.join(centres, "a", "left_semi").select("a")).isEmpty():
            return links.selectExpr("a as node", "b as component").union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        both = links.union(links.selectExpr("b as a", "a as b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = both.join(low, "a").where("b > a").selectExpr("b as a", "m as b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").selectExpr("b as a", "m as b")
        links = materialise(small.union(low.selectExpr("a", "m as b")).distinct(), "links")

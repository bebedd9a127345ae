"""Sessions, and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf overrides, with `__` for dots in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()


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

"""The corpus pipeline: language ID, near-duplicate removal, source mixing, packing.

Each stage is a function of (spark, docs, sf_dir) over all rows that its predecessor kept; every one but the last
returns the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, ngram_join, packing
from tessera.llm.common import flag_by_bitmap, materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or mostly in no learned language, go."""
    return language.accepted(docs, language.fit(docs.where(language.remainder(F.col("doc_id")) != 1)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that of the smallest id stays; of equal rows, one. Rows whose id is null, or stands
    for other texts too, are known by a hash of id and text instead, above all ids, and so judged each. Only rows that a
    bitmap of fixed size cannot clear are shuffled."""
    key, flag = (f"{name}_{uuid.uuid4().hex}" for name in ("key", "flag"))
    texts = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    unclear = materialise(texts.where("a <> b or doc_id is null").select("doc_id"), "unclear")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    if not unclear.isEmpty():
        keyed = flag_by_bitmap(docs, "doc_id", unclear, "doc_id", flag)
        own = F.when(F.col(flag) | F.col("doc_id").isNull(), F.expr("xxhash64(doc_id, text) & ((1L << 62) - 1) | (1L << 62)")).otherwise(F.col("doc_id").cast("long"))
        keyed = keyed.withColumn(key, own).drop(flag)
    found = materialise(ngram_join.ngram_components(keyed.select(F.col(key).alias("doc_id"), "text")), "components")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    twice = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias(key)).count().where("count > 1")
    suspects = gone.union(twice.select(key))
    flagged = flag_by_bitmap(keyed, key, suspects, key, flag)
    cleared = flagged.where(~F.col(flag)).select(*docs.columns)
    # of the few others those that stay are found by their keys alone, before any text is shuffled
    stay = flag_by_bitmap(keyed.select(key), key, suspects, key, flag).where(F.col(flag)).select(key)
    stay = materialise(stay.distinct().join(gone, key, "left_anti"), "stay")
    rest = flag_by_bitmap(flagged.where(F.col(flag)).drop(flag), key, stay, key, flag).where(F.col(flag)).drop(flag)
    rest = rest.join(stay, key, "left_semi")
    # a key of a text without words stays as often as it is there
    empty = materialise(found.where("n_shingles = 0").select(F.col("doc_id").alias(key)).distinct().join(stay, key, "left_semi"), "empty")
    if not empty.isEmpty():
        cleared = cleared.unionByName(rest.join(empty, key, "left_semi").select(*docs.columns))
        rest = rest.join(empty, key, "left_anti")
    return cleared.unionByName(rest.dropDuplicates([key]).select(*docs.columns))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mix", mixing_sources),
    ("retrieval_packing", packing_sequences),
]

#: Tokens, n-gram models and signatures have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Chunks and n-gram signatures of `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import fp, text
from tessera.operators import search
from tessera.sources.star import table


@query("WITH p AS (SELECT doc_id, unnest([x for x in string_split(text, chr(10) || chr(10)) if trim(x) <> '']) AS chunk FROM documents) SELECT doc_id, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM p GROUP BY doc_id")
def chunk_paragraph(spark, sf_dir):
    rows = text.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query("WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, start, md5(substr(text, start + 1, 500)) AS digest FROM s")
def chunk_sliding(spark, sf_dir):
    rows = text.sliding(table(spark, sf_dir, "documents"), "doc_id", "text", 500, 100)
    return rows.select("doc_id", "start", F.md5("chunk").alias("digest"))


@query("WITH s AS (SELECT doc_id, unnest([x for x in regexp_extract_all(text, '[^.!?]+[.!?]*') if trim(x) <> '']) AS sentence FROM documents) SELECT doc_id, count(*) AS sentences FROM s GROUP BY doc_id")
def chunk_sentence(spark, sf_dir):
    rows = text.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query()
def text_topk(spark, sf_dir):
    """The documents most like the first one by n-gram signature."""
    rows = text.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")
    first = rows.where("doc_id = 0").select(F.col("words").alias("q"))
    rows = rows.where("doc_id <> 0").crossJoin(F.broadcast(first))  # one row
    return search.top_k(rows, fp.hamming(F.col("words"), F.col("q")), "doc_id", 10).select("doc_id", "distance")

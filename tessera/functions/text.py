"""Text: chunks and n-gram signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 384


def paragraphs(docs: DataFrame, key: str, text: str, per_chunk: int = 1) -> DataFrame:
    """(key, position, chunk): non-empty paragraphs, so many together."""
    parts = docs.select(key, F.posexplode(F.filter(F.split(text, r"\n\n"), lambda x: F.trim(x) != "")).alias("i", "part"))
    if per_chunk == 1:
        return parts.select(key, F.col("i").cast("long").alias("position"), F.col("part").alias("chunk"))
    parts = parts.groupBy(key, F.floor(F.col("i") / per_chunk).alias("position")).agg(
        F.array_sort(F.collect_list(F.struct("i", "part"))).alias("parts")
    )
    return parts.select(key, "position", F.array_join(F.transform("parts", lambda x: x.part), "\n\n").alias("chunk"))


def sentences(docs: DataFrame, key: str, text: str, per_chunk: int = 1) -> DataFrame:
    """(key, position, chunk): so many sentences together; a sentence ends with . ! or ?."""
    every = F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), 0), lambda x: F.trim(x) != "")
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(every) / per_chunk) - 1, F.lit(0)).cast("int")),
        lambda g: F.trim(F.array_join(F.slice(every, g * per_chunk + 1, per_chunk), "")),
    )
    rows = docs.select(key, F.posexplode(groups).alias("position", "chunk")).where("chunk <> ''")
    return rows.withColumn("position", F.col("position").cast("long"))


def sliding(docs: DataFrame, key: str, text: str, window: int, overlap: int) -> DataFrame:
    """(key, position, start, chunk): windows of characters that overlap by so many; fixed size with overlap 0."""
    step = max(1, window - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    rows = docs.where(F.length(text) > 0).select(key, F.col(text).alias("whole"), F.posexplode(starts).alias("position", "start"))
    return rows.select(
        key, F.col("position").cast("long").alias("position"), F.col("start").cast("long").alias("start"),
        F.expr(f"substring(whole, start + 1, {window})").alias("chunk"),
    )


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """h = 33 h + byte, from 5381 and modulo 2^64, of runs of bytes: a step for each byte of the longest."""
    out = np.full(len(starts), 5381, np.uint64)
    for i in range(int(sizes.max()) if len(sizes) else 0):
        at = np.flatnonzero(sizes > i)
        out[at] = out[at] * np.uint64(33) + data[starts[at] + i]
    return out


def gram_bits(text: str) -> np.ndarray:
    """Bits of a text: 3- and 4-grams of characters and words of four bytes or more, each by its hash."""
    text = text.lower()
    data = np.frombuffer(text.encode(), np.uint8)
    # a byte that continues a character begins none
    edges = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    out = np.zeros(BITS, bool)
    for n in (3, 4):
        if len(edges) > n:
            out[(span_hashes(data, edges[:-n], edges[n:] - edges[:-n]) % np.uint64(BITS)).astype(int)] = True
    words = [w for w in {w.encode() for w in text.split()} if len(w) >= 4]
    if words:
        sizes = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        out[(span_hashes(flat, np.cumsum(sizes) - sizes, sizes) % np.uint64(BITS)).astype(int)] = True
    return out


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): the 384-bit n-gram signature of each text as 12 words of 32 bits."""

    def rows(batches):
        for batch in batches:
            packed = [np.packbits(gram_bits(t or ""), bitorder="little").view("<u4").tolist() for t in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(packed, pa.list_(pa.int64()))], [key, "words"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(rows, f"{key} {kind}, words array<bigint>")

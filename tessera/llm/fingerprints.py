"""Document fingerprints by MinHash.

A signature holds, for each of 128 universal hash permutations (x -> a x + b modulo 2^32, a odd), the smallest value
over the hashes of a document's 5-word shingles; equal positions of two signatures estimate the Jaccard likeness. The
fingerprint keeps a byte of each value, as hex; likeness takes off what bytes agree by chance. near_duplicates() joins
the signatures' bands in Spark and verifies the Jaccard likeness of what meets.

A null text is empty; a text of fewer than five words is one shingle; without words a signature is empty, like another
empty one only. Documents follow one another by descending id, rows of one id by descending text, null ids last.
Repeated rows are documents of their own. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, small_batches
from tessera.llm.ngram_join import INDEX, batch_shingles, distinct, linked, parity, set_key

#: Words of a shingle, permutations, and bands by rows of a signature (a pair of likeness 0.8 meets in one of them
#: with a probability of 0.9999).
SHINGLE, PERMUTATIONS, BANDS, BAND_ROWS = 5, 128, 25, 5
#: Characters of text fingerprinted at a time.
PIECE = 1 << 20


def permutations(count: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(5)
    return made.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), made.integers(0, 1 << 32, count, np.uint32)


def signatures(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of minima for each run of shingle hashes; all ones for an empty run."""
    a, b = permutations()
    out = np.full((len(bounds) - 1, len(a)), np.uint32(0xFFFFFFFF))
    rows = np.flatnonzero(np.diff(bounds))
    if len(rows):
        x = (items >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for i in range(len(a)):
            np.multiply(x, a[i], out=y)
            np.add(y, b[i], out=y)
            out[rows, i] = np.minimum.reduceat(y, bounds[rows])
    return out


def prints(signature: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """A byte of each minimum; 255 throughout for empty documents."""
    out = ((signature * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    out[empty] = 255
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of paired prints: the share of equal bytes without those that chance explains."""
    none_a, none_b = ((x == 255).all(axis=1) for x in (a, b))
    estimate = np.clip(((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), estimate)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows (part, guard, doc_id, text), in order within partitions, of which every row but the guards is followed by
    its next document: parts are ranges of ids, cut at ids of the table, and the first row of a range also stands as
    a guard at the end of the range before; the first row of all at the end of the last. One shuffle of the texts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranks = ", ".join(str(i / parts) for i in range(1, parts)) or "0.5"
    # bounded by the number of partitions
    cuts, top = docs.agg(F.expr(f"percentile_approx(doc_id, array({ranks}), 10000)"), F.max("doc_id")).head()
    cuts = sorted(set(cuts or []), reverse=True)
    last = len(cuts)
    every = F.array(*(F.lit(c) for c in cuts)) if cuts else F.expr("array(cast(null as bigint))")
    part = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(
        F.size(F.filter(every, lambda c: F.col("doc_id") <= c))
    )
    guards = F.when(F.col("doc_id").isin(cuts), F.array(F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("guard"))))
    guards = F.coalesce(guards, F.expr("cast(array() as array<struct<part:int,guard:boolean>>)"))
    wrap = F.expr("array(named_struct('part', cast(%d as int), 'guard', true))" % last)
    first = F.col("doc_id") == F.lit(top) if top is not None else F.col("doc_id").isNull()
    rows = docs.withColumn("part", part.cast("int"))
    own = F.array(F.struct("part", F.lit(False).alias("guard")))
    rows = rows.withColumn("at", F.explode(F.concat(own, guards, F.when(first, wrap).otherwise(F.expr("cast(array() as array<struct<part:int,guard:boolean>>)")))))
    rows = rows.select("at.part", "at.guard", "doc_id", "text").repartitionById(last + 1, F.col("part"))
    return rows.sortWithinPartitions("part", "guard", F.desc_nulls_last("doc_id"), F.desc("text"))


FINGERPRINTS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of the following document."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint(docs: DataFrame) -> DataFrame:
    """Of every row of (doc_id, text): its fingerprint and that of its edited text, and the likeness of its fingerprint
    to the edited text's and to the next document's."""

    def measure(ids: list, texts: list[str]):
        """Of all texts but the last, which is only a next document."""
        changed = [edited(x, y) for x, y in zip(texts[:-1], texts[1:], strict=True)]
        own, own_bounds = batch_shingles(pa.array(texts), SHINGLE)
        new, new_bounds = batch_shingles(pa.array(changed), SHINGLE)
        # a text and its edited text begin alike: the shingles they share are hashed once
        runs, ends = [], [0]
        for r in range(len(texts)):
            x = own[own_bounds[r] : own_bounds[r + 1]]
            y = new[new_bounds[r] : new_bounds[r + 1]] if r < len(changed) else x[:0]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            same = int(differ[0]) if len(differ) else n
            for run in (x[:same], x[same:], y[same:]):
                runs.append(run)
                ends.append(ends[-1] + len(run))
        three = signatures(np.concatenate(runs), np.array(ends)).reshape(len(texts), 3, -1)
        a = prints(np.minimum(three[:, 0], three[:, 1]), np.diff(own_bounds) == 0)
        b = prints(np.minimum(three[:-1, 0], three[:-1, 2]), np.diff(new_bounds) == 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                pa.array([x.tobytes().hex() for x in a[:-1]]), pa.array([x.tobytes().hex() for x in b]),
                pa.array(likeness(a[:-1], b)), pa.array(likeness(a[:-1], a[1:])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def rows(batches):
        ids, texts, held = [], [], 0
        part, ended = None, True
        for batch in batches:
            for own, guard, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "guard", "doc_id", "text")), strict=True):
                if own != part:
                    part, ended = own, False
                if ended:  # further guards
                    continue
                texts.append(text)
                held += len(text)
                if guard:
                    if ids:
                        yield measure(ids, texts)
                    ids, texts, held, ended = [], [], 0, True
                    continue
                if held > PIECE and ids:
                    yield measure(ids, texts)
                    ids, texts, held = [], texts[-1:], len(text)
                ids.append(doc_id)

    return with_neighbours(small_batches(docs)).mapInArrow(rows, FINGERPRINTS)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents whose signatures meet in a band and whose Jaccard
    likeness, verified on the whole shingle sets, is at least `percent` are linked; the component's smallest id names it.
    A band that very many documents share is verified from its leader, like an inverted list of the n-gram join."""

    def rows(batches):
        weights = np.random.default_rng(6).integers(0, 1 << 62, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                items, bounds = batch_shingles(piece["text"], SHINGLE)
                made = signatures(items, bounds)[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)
                bands = ((made.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                sets = [distinct(distinct(items[s:e]) >> np.uint64(7)) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                sizes = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"], pa.array(sizes, pa.int64()), pa.array([set_key(x) for x in sets], pa.int64()),
                        pa.array([parity(x) for x in sets], pa.binary()),
                        pa.array([b.tolist() if n else [] for b, n in zip(bands, sizes, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "set_key", "parity", "prefix"],
                )

    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = docs.mapInArrow(rows, INDEX)
    return linked(index, docs, SHINGLE, percent, positions=False)

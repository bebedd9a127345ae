"""Language identification by mixture inference.

A language's model is a smoothed distribution of its byte 4-grams over hash classes, learned from a bounded sample of
labelled documents. A document is a mixture: expectation-maximisation estimates the proportions of languages (and of
`other`, the uniform distribution, which junk fits better than any language) that make its 4-grams most likely. Of
the sets of languages that one with the highest likelihood less a penalty for each further language is chosen,
grown from the best single language. The likelihood is concave in the proportions, so its slope bounds what further
languages can gain: where the bound is under the penalty, the single language is proven best and no iteration is run.

Text is read whole. Only letters count: ASCII letters without case and all bytes of longer characters; everything
else separates words. A text that is null or has no letter gets `und` and score 0. Languages that have the same
likelihood are taken in the order of their names. With an empty training table every text gets `und`. Repeated rows
are predicted one by one; a labelled row with a null id is not learned from; other columns of the input are never
read. A very long text is counted in stretches, so a worker needs little more than the text itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import PIECE, pieces, released, small_batches
from tessera.llm.words import text_buffer

#: log2 of the hash classes of 4-grams.
BITS = 17
#: Bytes of context of which consecutive 4-grams share all but one: their evidence counts once.
ORDER = 4
#: Labelled documents of each language that a model is fitted on, chosen by hash.
SAMPLE = 3000
#: Levels of hash buckets by which the sample is cut, bits of each, and the tasks that count the sample.
LEVELS, BUCKET_BITS, PARTS = 2, 12, 16
#: Penalty of a language in the set, in units of half the logarithm of the number of independent 4-grams.
PENALTY = 3.0
#: Share of every distribution that is uniform.
FLOOR = 0.02
TOLERANCE, STEPS = 1e-4, 40


@dataclass
class Model:
    languages: list[str]
    #: Row for each hash class, column for each language; the last column is `other`.
    chances: np.ndarray


def letters() -> np.ndarray:
    """Each byte's letter: itself without ASCII case, or a space."""
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


def grams(column, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash classes of the 4-grams that begin with a letter or the space before one, and their bounds by row."""
    data, offsets = text_buffer(column)
    # every text stands between spaces, so no 4-gram crosses rows
    out = np.full(len(data) + ORDER * (len(offsets) - 1) + ORDER, 0x20, np.uint8)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = offsets[:-1] + ORDER * np.arange(len(offsets) - 1) + 1
    out[np.arange(len(data)) + ORDER * rows + 1] = letters()[data]
    classes, at = gram_classes(out, bits)
    return classes, np.searchsorted(at, np.append(starts - 1, len(out)))


def gram_classes(out: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash classes of the 4-grams of letters and spaces, and where they begin."""
    n = len(out) - ORDER + 1
    code = np.zeros(n, np.uint32)
    for j in range(ORDER):
        code |= out[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    letter = out != 0x20
    at = np.flatnonzero(letter[1 : n + 1] | letter[:n])
    return (code[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), at


def gram_counts(column, bits: int, chunk: int = PIECE) -> np.ndarray:
    """How often each hash class stands in a single text; the text is read in stretches."""
    data, _ = text_buffer(column)
    counts = np.zeros(1 << bits, np.int64)
    for a in range(0, len(data) + 1, chunk):
        b = min(a + chunk, len(data) + 1)
        out = np.full(b - a + ORDER - 1, 0x20, np.uint8)
        low, high = max(a - 1, 0), min(b + ORDER - 2, len(data))
        out[low + 1 - a : high + 1 - a] = letters()[data[low:high]]
        counts += np.bincount(gram_classes(out, bits)[0], minlength=1 << bits)
    return counts


def remainder(key: Column, by: int = 3) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(by))


def hash_bucket(levels: int) -> Column:
    return F.shiftright("h", 64 - BUCKET_BITS * levels)


def hash_edges(rows: DataFrame, sample: int) -> DataFrame:
    """(lang, edge, base): the hash bucket of the last level up to which a language of rows (lang, h) has `sample` rows,
    and how many are before it. Each level counts the buckets of the last level's edge only."""
    edges = None
    for level in range(1, LEVELS + 1):
        inside = rows.withColumn("base", F.lit(0).cast("long"))
        if edges is not None:
            inside = rows.join(F.broadcast(edges), "lang").where(hash_bucket(level - 1) == F.col("edge"))
        counts = inside.groupBy("lang", "base", hash_bucket(level).alias("bucket")).count()
        before = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.col("base") + F.coalesce(F.sum("count").over(before), F.lit(0)))
        found = counts.where(F.col("before") < sample).groupBy("lang")
        edges = found.agg(F.max("bucket").alias("edge"), F.max("before").alias("base"))
    return edges


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """The model of all labels in docs; at most `sample` documents of each, those of the smallest hashes of the key."""
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang")).where("lang is not null and k is not null")
    rows = rows.withColumn("h", F.xxhash64("k"))
    # as many rows as languages, each of which the model holds as a column
    edges = F.broadcast(hash_edges(rows, sample))
    near = rows.join(edges, "lang").where(hash_bucket(LEVELS) <= F.col("edge"))
    w = Window.partitionBy("lang").orderBy("h", "k")
    ids = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).select("k").distinct()
    # as many rows as `sample` for each language
    texts = small_batches(docs).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    texts = texts.where("lang is not null and text is not null").join(F.broadcast(ids), "k", "left_semi")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text"):
                if piece.nbytes > 2 * PIECE and piece.num_rows == 1:
                    held.setdefault(piece["lang"][0].as_py(), np.zeros(1 << bits, np.int64))[:] += gram_counts(piece["text"], bits)
                    continue
                classes, bounds = grams(piece["text"], bits)
                for i, name in enumerate(piece["lang"].to_pylist()):
                    total = held.setdefault(name, np.zeros(1 << bits, np.int64))
                    total += np.bincount(classes[bounds[i] : bounds[i + 1]], minlength=1 << bits)
        for name, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name], "at": [at.tobytes()], "n": [total[at].tobytes()]})

    # the sample is bounded, so are its shuffle and its partial counts
    parts = texts.repartition(PARTS, "k").select("lang", "text").mapInArrow(released(count), "lang string, at binary, n binary").collect()
    languages = sorted({name for name, _, _ in parts})
    counts = np.zeros((len(languages), 1 << bits))
    for name, at, n in parts:
        counts[languages.index(name), np.frombuffer(at, np.int64)] += np.frombuffer(n, np.int64)
    size = 1 << bits
    chances = np.full((size, len(languages) + 1), 1.0 / size, np.float32)
    smooth = (counts + 0.01) / (counts.sum(axis=1, keepdims=True) + 0.01 * size)
    chances[:, :-1] = ((1 - FLOOR) * smooth + FLOOR / size).T
    return Model(languages, chances)


def expectation_maximisation(chances: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that make weighted events of these chances (rows) most likely, and the logarithm of likelihood."""
    n = weights.sum()
    share = np.full(chances.shape[1], 1.0 / chances.shape[1])
    for _ in range(STEPS):
        total = chances @ share
        new = share * ((weights / total) @ chances) / n
        done = np.abs(new - share).max() < TOLERANCE
        share = new
        if done:
            break
    return share, float(weights @ np.log(chances @ share))


def events_of(classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and how often they stand."""
    if len(classes) <= 2000:
        return classes, np.ones(len(classes))
    n = np.bincount(classes, minlength=size)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float64)


def mixture(at: np.ndarray, weights: np.ndarray, chances: np.ndarray, best: int) -> np.ndarray:
    """Proportions of all columns for a document of weighted classes whose best single column is given."""
    own = chances[at].astype(np.float64)
    events = weights.sum() / ORDER
    penalty = PENALTY * 0.5 * np.log(max(events, 2.0))
    chosen, share = [best], np.ones(1)
    value = float(weights @ np.log(own[:, best])) / ORDER
    while len(chosen) < own.shape[1]:
        slope = (weights / (own[:, chosen] @ share)) @ own / ORDER - events
        slope[chosen] = -np.inf
        # the further language of the steepest slope; by concavity none gains more than the steepest slope
        candidate = int(slope.argmax())
        if slope[candidate] <= penalty:
            break
        new, likelihood = expectation_maximisation(own[:, [*chosen, candidate]], weights)
        if likelihood / ORDER - value <= penalty:
            break
        chosen, share, value = [*chosen, candidate], new, likelihood / ORDER
    out = np.zeros(own.shape[1])
    out[chosen] = share
    return out


def has_letter(column, chunk: int = PIECE) -> bool:
    """Whether a single text has a letter; it is decoded in stretches, none of which ends within a character."""
    data, _ = text_buffer(column)
    a = 0
    while a < len(data):
        b = min(a + chunk, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        if any(map(str.isalpha, data[a:b].tobytes().decode("utf-8", "ignore"))):
            return True
        a = b
    return False


def predictor(model: Model, bits: int):
    """A function of a batch's text column that gives its proportions, a row each; all 0 for a text without letters."""
    logs = np.log(model.chances)

    def long(column) -> np.ndarray:
        """The same for a single text, in memory that does not depend on its length."""
        counts = gram_counts(column, bits)
        at = np.flatnonzero(counts)
        out = np.zeros((1, len(model.languages) + 1))
        if len(at) and model.languages and has_letter(column):
            weights = counts[at].astype(np.float64)
            out[0] = mixture(at, weights, model.chances, int((weights @ logs[at, :-1]).argmax()))
        return out

    def predict(column) -> np.ndarray:
        if len(column) == 1 and column.nbytes > 2 * PIECE:
            return long(column)
        languages = len(model.languages)
        classes, bounds = grams(column, bits)
        out = np.zeros((len(column), languages + 1))
        counts = np.diff(bounds)
        rows = np.flatnonzero(counts)
        if not languages or not len(rows):
            return out
        sums = np.add.reduceat(logs[classes], bounds[rows], axis=0, dtype=np.float64)
        best = sums[:, :languages].argmax(axis=1)
        # by concavity the gain over the best language is under the steepest slope
        single = model.chances[classes, np.repeat(best, counts[rows])]
        ratio = model.chances[classes] / single[:, None]
        slope = (np.add.reduceat(ratio, bounds[rows], axis=0, dtype=np.float64) - counts[rows][:, None]) / ORDER
        limit = PENALTY * 0.5 * np.log(np.maximum(counts[rows] / ORDER, 2.0))
        proven = slope.max(axis=1) <= limit
        out[rows[proven], best[proven]] = 1.0
        for i in np.flatnonzero(~proven):
            r = rows[i]
            out[r] = mixture(*events_of(classes[bounds[r] : bounds[r + 1]], len(model.chances)), model.chances, int(best[i]))
        # bytes of longer characters need not be letters
        for r in rows.tolist():
            if not any(map(str.isalpha, column[r].as_py())):
                out[r] = 0
        return out

    return predict


PREDICTION = "lang_pred string, score double, other double, languages string"


def described(model: Model, shares: np.ndarray) -> list[pa.Array]:
    """Columns lang_pred, score, other (share of no language), languages (the chosen set with its shares)."""
    names, scores, others, texts = [], [], [], []
    for share in shares:
        if not share.any():
            names.append("und"), scores.append(0.0), others.append(0.0), texts.append("")
            continue
        best = int(share[:-1].argmax()) if share[:-1].any() else 0
        names.append(model.languages[best])
        scores.append(min(1.0, float(share[best])))
        others.append(float(share[-1]))
        order = sorted((-s, model.languages[i]) for i, s in enumerate(share[:-1]) if s > 0)
        texts.append(",".join(f"{name}:{-s:.3f}" for s, name in order))
    return [pa.array(names), pa.array(scores, pa.float64()), pa.array(others, pa.float64()), pa.array(texts)]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, lang_pred, score, other, languages) of every row."""

    def rows(batches):
        run = predictor(model, bits)
        for batch in batches:
            for piece in pieces(batch, "text"):
                arrays = [piece["k"], *described(model, run(piece["text"]))]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "lang_pred", "score", "other", "languages"])

    rows_in = small_batches(docs).select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    return rows_in.mapInArrow(released(rows), f"k long, {PREDICTION}").withColumnRenamed("k", key)


def accepted(docs: DataFrame, model: Model, text: str = "text", most_other: float = 0.5, bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has letters and is mostly in the model's languages."""

    def rows(batches):
        run = predictor(model, bits)
        for batch in batches:
            for piece in pieces(batch, text):
                share = run(piece[text])
                keep = share.any(axis=1) & (share[:, -1] <= most_other)
                yield piece.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(released(rows), docs.schema)

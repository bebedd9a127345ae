"""The operation dictionary: names to functions of columns or tables, for signatures of any width.

Operations whose recorded bodies do not do what their names say have the named behaviour here; those that only mark a
signature exclusive-or it with a constant of their own, so a second application gives it back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fp, response, truth, vectors

#: Relations that bind as source ^ verb ^ target. Fixed values.
VERBS = ["CAUSES", "BECOMES", "ENABLES", "PREVENTS", "CONTAINS", "REQUIRES", "IMPLIES", "SUPPORTS", "CONTRADICTS", "GROUNDS", "ABSTRACTS", "REFINES"]
#: Operations that only mark a signature, and the constants they use.
MARKS = {
    "ADA_FEEL": "FEEL", "META_SELF_MODEL": "SELF_MODEL", "META_SELF_EXPLAIN": "SELF_EXPLAIN", "META_KNOW_WHAT": "KNOW_WHAT",
    "META_KNOW_HOW": "KNOW_HOW", "QUALIA_CREATE": "QUALIA", "FS_COMPRESS": "COMPRESS", "FS_DECOMPRESS": "COMPRESS",
    "ACTR_BUFFER_GOAL": "GOAL", "RUNG_ASCEND": "RUNG", "RUNG_DESCEND": "RUNG", "CRYSTAL_LAYER_HOT": "HOT",
    "CRYSTAL_AXIS_T": "BASIS0", "CRYSTAL_AXIS_S": "BASIS1", "CRYSTAL_AXIS_D": "BASIS2", "RUNG_BLEND_EMERGENT": "BASIS0",
}
#: Operations of two signatures that exclusive-or them, with a constant or none.
BINDS = {
    "HAM_BIND": None, "LEARN_MOMENT_CAPTURE": None, "ACTR_PRODUCTION_FIRE": None, "RL_MODEL_PREDICT": None, "CRYSTAL_INFER": None,
    "FS_FP_SAVE": None, "FS_FP_LOAD": None, "ADA_BECOME": "BECOME", "FS_PATH_JOIN": "SEPARATOR", "RUNG_BLEND_CREATE": "BASIS0",
    "RUNG_METAPHOR_MAP": "METAPHOR", "RUNG_STRUCTURE_MAP": "BASIS7", **{f"VERB_{v}": f"VERB_{v}" for v in VERBS},
}
#: Bits of a segment for confidence and of a window for uncertainty, and how many there are. Fixed values.
SEGMENT, SEGMENTS, SMALL, SMALLS = 1000, 10, 100, 100
LAYERS = ["cold", "warm", "hot"]


def constant(name: str, words: int, word_bits: int = fp.WORD_BITS) -> list[int]:
    """A named constant's words, as signed numbers."""
    digits = word_bits // 4
    made = [int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:digits], 16) for i in range(words)]
    return [x - (1 << 64) if x >> 63 else x for x in made]


def literal(words: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def text_words(text: Column, words: int, word_bits: int = 64) -> Column:
    """A text's signature, word by word from md5; 64-bit words use all bits of a bigint."""

    def word(i):
        return F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), i.cast("string"))), 1, word_bits // 4), 16, -10).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def bound_once(x: Column, made: Callable) -> Column:
    """made(x), with x computed once however often it is used."""
    return F.element_at(F.transform(F.array(x), made), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def runs(a: Column, size: int, count: int, word_bits: int) -> Column:
    """Set bits of so many runs of a size: of each the words that it crosses, under a mask."""
    every = []
    for first in range(0, size * count, size):
        own = []
        for w in range(first // word_bits, (first + size - 1) // word_bits + 1):
            low, high = max(first - w * word_bits, 0), min(first + size - w * word_bits, word_bits)
            mask = (1 << high) - (1 << low)
            own.append({"w": w, "m": mask - (1 << 64) if mask >> 63 else mask})
        every.append(own)
    masks = F.from_json(F.lit(json.dumps(every)), "array<array<struct<w:int,m:bigint>>>")
    ones = lambda x: F.coalesce(F.bit_count(F.get(a, x.w).bitwiseAND(x.m)), F.lit(0)).cast("double")
    return F.transform(masks, lambda own: F.aggregate(own, F.lit(0.0), lambda t, x: t + ones(x)))


def variance(counts: Column, mean: Column, count: int) -> Column:
    return bound_once(mean, lambda m: total(F.transform(counts, lambda x: (x - m) * (x - m))) / float(count))


def confidence(a: Column, word_bits: int) -> Column:
    """1 less the coefficient of variation of the set bits of equal segments."""

    def made(counts):
        mean = total(counts) / float(SEGMENTS)
        return F.when(mean > 0, 1.0 - F.sqrt(variance(counts, mean, SEGMENTS)) / mean).otherwise(0.0)

    return bound_once(runs(a, SEGMENT, SEGMENTS, word_bits), made)


def uncertainty(a: Column, word_bits: int) -> Column:
    """Entropy of the shares that small windows have of the set bits, of its maximum."""

    def made(counts):
        def shares(n):
            return total(F.transform(counts, lambda x: F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(0.0))) / 6.64

        return bound_once(total(counts), lambda n: F.when(n > 0, shares(n)).otherwise(0.0))

    return bound_once(runs(a, SMALL, SMALLS, word_bits), made)


def valence(a: Column, word_bits: int) -> Column:
    return bound_once(runs(a, 1000, 2, word_bits), lambda c: F.when(c[0] + c[1] > 0, (c[0] - c[1]) / (c[0] + c[1])).otherwise(0.0))


def arousal(a: Column, word_bits: int) -> Column:
    """1 less the variance of four runs' set bits over nine squared means."""

    def made(counts):
        mean = total(counts) / 4.0
        return F.when(mean > 0, 1.0 - variance(counts, mean, 4) / (9.0 * mean * mean)).otherwise(0.0)

    return bound_once(runs(a, 2500, 4, word_bits), made)


def majority(a: Column, b: Column, c: Column) -> Column:
    return fp.either(fp.either(fp.both(a, b), fp.both(a, c)), fp.both(b, c))


# ---- tables
def nearest_rows(rows: DataFrame, words: str, query: Column, key: str, k: int) -> DataFrame:
    """The k rows of the smallest distance, ties to the smaller key."""
    return rows.withColumn("distance", fp.hamming(F.col(words), query)).orderBy("distance", key).limit(k)


def similar_rows(rows: DataFrame, words: str, query: Column, least: float, width: int) -> DataFrame:
    return rows.withColumn("similarity", fp.similarity(F.col(words), query, width)).where(F.col("similarity") >= least)


def most_similar(rows: DataFrame, words: str, query: Column, key: str, width: int) -> DataFrame:
    """One row: the most similar, of equal ones that of the smallest key."""
    return rows.withColumn("similarity", fp.similarity(F.col(words), query, width)).orderBy(F.desc("similarity"), key).limit(1)


def crystal(pairs: DataFrame, inputs: str, outputs: str, order: str, word_bits: int) -> DataFrame:
    """One row of what pairs of signatures teach: the bundle of their bindings, the exclusive or of the inputs, and the
    first pair's binding with both."""
    made = pairs.withColumn("bound", fp.bind(F.col(inputs), F.col(outputs)))
    key = F.lit(0)
    bundle = fp.bundle(made.withColumn("g", key), ["g"], "bound", word_bits=word_bits).select("g", F.col("bound").alias("bundle"))
    parity = fp.combined(made.withColumn("g", key), ["g"], inputs).select("g", F.col(inputs).alias("parity"))
    first = made.groupBy(key.alias("g")).agg(F.min_by("bound", order).alias("first"))
    out = bundle.join(parity, "g").join(first, "g")
    return out.select("bundle", "parity", fp.bind(fp.bind("first", "bundle"), F.col("parity")).alias("corrected"))


def concepts(rows: DataFrame, words: str, width: int, word_bits: int, rounds: int = 8, most: float = 0.8) -> DataFrame:
    """rows by rounds of unbinding a fixed constant each; those that are still too similar to the start go."""
    every = F.array(*(F.struct(F.lit(i).alias("round"), literal(constant(f"BASIS{i}", width // word_bits, word_bits)).alias("base")) for i in range(rounds)))
    out = rows.withColumn("step", F.explode(every)).withColumn("concept", fp.bind(F.col(words), F.col("step.base")))
    out = out.withColumn("similarity", fp.similarity(F.col("concept"), F.col(words), width)).withColumn("round", F.col("step.round"))
    return out.where(F.col("similarity") < most).drop("step")


def curiosity(rows: DataFrame, words: str, memory: DataFrame, memory_words: str, key: str, width: int) -> DataFrame:
    """(key, curiosity): 1 less the highest similarity to a memory, 1 without any. The memory's size is the planner's to
    check; it is joined, not collected."""
    pairs = rows.select(key, words).join(memory.select(F.col(memory_words).alias("held")), F.lit(True), "left")
    best = F.max(fp.similarity(F.col(words), F.col("held"), width))
    return pairs.groupBy(key).agg((1.0 - F.coalesce(best, F.lit(0.0))).alias("curiosity"))


def strongest(rows: DataFrame, words: str, key: str) -> DataFrame:
    """One row: that of the most set bits, of equal ones that of the smallest key."""
    return rows.withColumn("popcount", fp.popcount(F.col(words))).orderBy(F.desc("popcount"), key).limit(1)


def looked_up(asked: DataFrame, values: DataFrame, keys: list[str], q: str) -> DataFrame:
    return asked.join(values.select(*keys, q), keys, "left").withColumn(q, F.coalesce(q, F.lit(0.0)))


def parents(edges: DataFrame, node, source: str = "source", target: str = "target") -> DataFrame:
    return edges.where(F.col(target) == F.lit(node)).select(source).distinct()


def children(edges: DataFrame, node, source: str = "source", target: str = "target") -> DataFrame:
    return edges.where(F.col(source) == F.lit(node)).select(target).distinct()


def consolidated(rows: DataFrame, keys: list[str], words: str, word_bits: int) -> DataFrame:
    return fp.bundle(rows, keys, words, word_bits=word_bits)


def appended(rows: DataFrame, more: DataFrame) -> DataFrame:
    return rows.unionByName(more, allowMissingColumns=True)


def best_per(rows: DataFrame, keys: list[str], score: Column, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(score.desc(), tie)
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def split_path(path: Column) -> Column:
    """struct<parent, child> at the last separator."""
    child = F.substring_index(path, "/", -1)
    parent = F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - F.length(child) - 1)).otherwise("")
    return F.struct(parent.alias("parent"), child.alias("child"))


def dictionary(words: int = 2, word_bits: int = fp.WORD_BITS) -> dict[str, Callable]:
    """All operations for signatures of so many words. Functions of columns give columns, those of tables tables."""
    from tessera.operators import causal, graph, learning, search, versions

    width = words * word_bits

    def fixed(name: str) -> Column:
        return literal(constant(name, words, word_bits))

    def marked(name: str) -> Callable:
        return lambda a: fp.bind(a, fixed(name))

    def bound(name: str | None) -> Callable:
        return (lambda a, b: fp.bind(fp.bind(a, fixed(name)), b)) if name else fp.bind

    def similarity(a, b):
        return fp.similarity(a, b, width)

    def density(a):
        return fp.density(a, width)

    def best(rows, column, query, key):
        return most_similar(rows, column, query, key, width)

    def near(rows, column, query, key, k):
        return nearest_rows(rows, column, query, key, k)

    out: dict[str, Callable] = {
        **{name: marked(mark) for name, mark in MARKS.items()},
        **{name: bound(mark) for name, mark in BINDS.items()},
        # tables of signatures
        "LANCE_VECTOR_SEARCH": near, "MEMORY_RECALL": near, "ADA_REMEMBER": near,
        "LANCE_INSERT": appended, "MEMORY_STORE": appended, "ACTR_CHUNK_CREATE": appended,
        "SQL_SELECT_SIMILAR": lambda rows, column, query, least: similar_rows(rows, column, query, least, width),
        "SQL_SIMILAR_JOIN": lambda rows, key, column, most: search.similarity_join(rows, key, column, most, width, word_bits),
        "CYPHER_MATCH_SIMILAR": lambda rows, column, query, key, k, least: similar_rows(near(rows, column, query, key, k), column, query, least, width),
        "CYPHER_PAGERANK": graph.pagerank,
        "LEARN_RESONANCE_CAPTURE": lambda rows, column, query: rows.where(similarity(F.col(column), query) > 0.7),
        "LEARN_CRYSTAL_TRAIN": lambda pairs, inputs, outputs, order: crystal(pairs, inputs, outputs, order, word_bits),
        "LEARN_CONCEPT_EXTRACT": lambda rows, column: concepts(rows, column, width, word_bits),
        "ACTR_CHUNK_RETRIEVE": best, "RUNG_ANALOGY_FIND": best,
        "ACTR_CONFLICT_RESOLVE": strongest,
        "RL_CURIOSITY": lambda rows, column, memory, held, key: curiosity(rows, column, memory, held, key, width),
        "HAM_BUNDLE": fp.bundle, "RUNG_EXTRACT": fp.bundle, "FS_SERIALIZE": fp.bundle, "ADA_DREAM": fp.bundle,
        "MEMORY_CONSOLIDATE": lambda rows, keys, column: consolidated(rows, keys, column, word_bits),
        "MEMORY_FORGET": versions.decayed,
        # signatures
        "HAM_MEXICAN_HAT": response.mexican_hat, "HAM_DISTANCE": fp.hamming, "HAM_SIMILARITY": similarity, "HAM_POPCOUNT": fp.popcount,
        "HAM_PERMUTE": lambda a, n: fp.permute(a, n, words, word_bits),
        "ADA_THINK": lambda a: fp.permute(fp.bind(a, fixed("THINK")), 42, words, word_bits),
        "ADA_WHISPER": lambda a: fp.both(a, literal([0x1111111111111111 & ((1 << word_bits) - 1)] * words)),
        "ADA_AWAKEN": lambda moment: fp.bind(fixed("AWAKEN"), text_words(moment, words, word_bits)),
        "ADA_RESONATE": lambda s: F.when(s > 0.8, s).when(s > 0.5, -(s - 0.5)).otherwise(0.0),
        "QUALIA_EMOTION_JOY": lambda: fixed("JOY"), "QUALIA_EMOTION_SADNESS": lambda: fixed("SADNESS"),
        "QUALIA_VALENCE_GET": lambda a: valence(a, word_bits), "QUALIA_ACTIVATION_GET": lambda a: arousal(a, word_bits),
        "QUALIA_SIMILARITY": vectors.cosine, "QUALIA_BLEND": vectors.blend, "QUALIA_EMOTION_BLEND": vectors.blend,
        "META_CONFIDENCE_GET": lambda a: confidence(a, word_bits), "META_UNCERTAINTY_QUANTIFY": lambda a: uncertainty(a, word_bits),
        "CRYSTAL_CREATE": lambda: majority(fixed("BASIS0"), fixed("BASIS1"), fixed("BASIS2")),
        "CRYSTAL_INTERPOLATE": lambda a, b, factor: F.when(density(factor) < 0.5, a).otherwise(b),
        "CRYSTAL_BEFORE": lambda a_end, b_start: a_end < b_start,
        "CRYSTAL_LAYER_PROMOTE": lambda layer: F.when(layer == LAYERS[0], LAYERS[1]).otherwise(LAYERS[2]),
        "CRYSTAL_DECAY_EXP": lambda x, t, rate: response.decay(x, t, rate),
        "ACTR_ACTIVATION": lambda a, b: density(a) + similarity(a, b),
        "ACTR_PARTIAL_MATCH": lambda a, b: -fp.hamming(a, b) / float(width),
        "ACTR_PRODUCTION_MATCH": lambda a, b: similarity(a, b) > 0.7,
        "ACTR_UTILITY": lambda a, b: similarity(a, b) + (fp.popcount(a) % 100) / 1000.0,
        "RUNG_CURRENT": lambda a: F.least(F.lit(9), F.floor(fp.popcount(a) / 1000)),
        "RUNG_MERGE": fp.both, "RUNG_PROTOTYPE_MATCH": similarity, "RUNG_CATEGORY_MEMBER": lambda a, b: similarity(a, b) > 0.5,
        "RUNG_GROUND_CHECK": lambda a: similarity(a, fixed("GROUND")) > 0.3,
        "RUNG_HIERARCHY_DEPTH": lambda a: F.floor(10 * similarity(a, fixed("HIERARCHY"))),
        # truth, causes
        "NARS_DEDUCTION": truth.truth_deduction, "NARS_INDUCTION": truth.truth_induction, "NARS_ABDUCTION": truth.truth_abduction,
        "NARS_ANALOGY": truth.truth_analogy, "NARS_REVISION": truth.truth_revision, "NARS_CHOICE": truth.choice,
        "CAUSAL_DO_INTERVENE": causal.outcomes, "CAUSAL_GRAPH_PARENTS": parents, "CAUSAL_GRAPH_CHILDREN": children,
        "CAUSAL_BACKDOOR_ADJUST": causal.adjusted_effect,
        "CAUSAL_COUNTERFACTUAL": lambda outcome, actual, alternative: fp.bind(fp.bind(outcome, actual), alternative),
        # learning
        "RL_Q_VALUE": looked_up, "RL_Q_UPDATE": learning.td_update, "RL_POLICY_GREEDY": learning.greedy,
        "RL_POLICY_EPSILON": lambda draw, epsilon, greedy, other: F.when(draw < epsilon, other).otherwise(greedy),
        "RL_REWARD": lambda a, b=None: density(a) if b is None else density(a) - density(b),
        "RL_TD_ERROR": lambda r, n, c: density(r) + 0.99 * density(n) - density(c),
        "RL_TRACE_UPDATE": lambda trace, visited, gamma=0.9, kept=0.8: gamma * kept * trace + F.when(visited, 1.0).otherwise(0.0),
        # paths
        "FS_FILE_HASH": lambda content: F.sha2(content, 256),
        "FS_FILE_EXISTS": lambda a: (fp.popcount(a) > 100) & (fp.popcount(a) < 9900),
        "FS_PATH_SPLIT": split_path,
    }
    return out


def operation(name: str, words: int = 2, word_bits: int = fp.WORD_BITS) -> Callable:
    every = dictionary(words, word_bits)
    if name.upper() not in every:
        raise KeyError(f"no operation {name}")
    return every[name.upper()]


def described(text: str) -> list[str]:
    """Operations whose names share words with a description, best first."""
    wanted = set(text.upper().replace("_", " ").split())
    scored = sorted((-len(wanted & set(n.split("_"))), n) for n in dictionary())
    return [n for s, n in scored if s]

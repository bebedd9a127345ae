"""Algebraic laws of signatures and truth values, names, and the operation dictionary."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import fp, names, operations, response, text, truth
from tessera.operators import causal, search, versions

MASK = (1 << 32) - 1


@pytest.fixture(scope="module")
def words(spark):
    made = random.Random(3)
    rows = [(i, [made.getrandbits(32) for _ in range(4)], [made.getrandbits(32) for _ in range(4)]) for i in range(60)]
    return spark.createDataFrame(rows, "id long, a array<bigint>, b array<bigint>"), rows


def bits(x):
    return sum(w.bit_count() for w in x)


def number(x):
    return sum(w << (32 * i) for i, w in enumerate(x))


def test_algebra(words):
    df, rows = words
    a, b = F.col("a"), F.col("b")
    out = df.select(
        fp.hamming(a, b), fp.hamming(fp.bind(fp.bind(a, b), b), a), fp.hamming(fp.inverted(a), a), fp.popcount(fp.both(a, b)) + fp.popcount(fp.either(a, b)),
        fp.permute(a, 37, 4), fp.fold(a, 4), fp.extended(a, 6),
    ).collect()
    for (_, x, y), r in zip(rows, out, strict=True):
        assert r[0] == bits([p ^ q for p, q in zip(x, y, strict=True)])
        assert (r[1], r[2], r[3]) == (0, 128, bits(x) + bits(y))
        n = number(x)
        assert number(r[4]) == ((n << 37) | (n >> (128 - 37))) & ((1 << 128) - 1)
        assert r[5] == [x[0] ^ x[2], x[1] ^ x[3]]
        assert r[6] == [*x, 0, 0]


def test_bundle(words):
    df, rows = words
    out = fp.bundle(df.withColumn("g", F.col("id") % 2), ["g"], "a", order="id").collect()
    for r in out:
        own = [x for i, x, _ in rows if i % 2 == r["g"]]
        for w in range(4):
            for j in range(32):
                n = sum(x[w] >> j & 1 for x in own)
                want = own[0][w] >> j & 1 if 2 * n == len(own) else 2 * n > len(own)
                assert (r["a"][w] >> j & 1) == want


def test_similarity_join(words):
    df, rows = words
    near = [(i + 100, [x[0] ^ 5, *x[1:]], y) for i, x, y in rows[:9]]
    every = df.union(df.sparkSession.createDataFrame(near, df.schema))
    out = {(r["a"], r["b"], r["distance"]) for r in search.similarity_join(every, "id", "a", 30, 128).collect()}
    items = [(i, x) for i, x, _ in [*rows, *near]]
    want = {(i, j, d) for i, x in items for j, y in items if i < j and (d := bits([p ^ q for p, q in zip(x, y, strict=True)])) <= 30}
    assert out == want and len(want) >= 9


def test_revision_adds_evidence(spark):
    df = spark.sql("SELECT named_struct('f', 0.9D, 'c', 0.5D) AS a, named_struct('f', 0.2D, 'c', 0.8D) AS b")
    a, b = F.col("a"), F.col("b")
    x, y = df.select(truth.truth_revision(a, b), truth.truth_revision(b, a)).head()
    assert x.f == pytest.approx((0.9 * 1 + 0.2 * 4) / 5) and x.c == pytest.approx(5 / 6) and x.c == pytest.approx(y.c)
    r = df.select(truth.truth_negation(truth.truth_negation(a)), truth.by_rule(F.lit("deduction"), a, b), truth.by_rule(F.lit("none"), a, b)).head()
    assert r[0].f == pytest.approx(0.9) and r[1].c == pytest.approx(0.18 * 0.4) and r[2] is None


def test_names(spark):
    df = spark.sql("SELECT 1 AS a, 254 AS b, 7 AS c")
    dn = names.name(F.col("a"), F.col("b"), F.col("c"))
    top = names.name(F.col("a"))
    r = df.select(names.depth(dn), names.component(dn, 1), names.parent(top), names.is_ancestor(top, dn), names.is_ancestor(dn, top), names.common_depth(dn, top), F.size(names.ancestors(dn)), names.parent(F.lit(0).cast("long"))).head()
    assert tuple(r) == (3, 254, 0, True, False, 1, 2, None)
    low, high = names.subtree(0)
    assert (low, high) == (-(1 << 63), (1 << 63) - 1)


def test_responses(spark):
    r = spark.sql("SELECT 10 AS d").select(response.mexican_hat(F.col("d"), 20, 40), response.mexican_hat(F.col("d") + 20, 20, 40), response.mexican_hat(F.col("d") + 40, 20, 40), response.decay(F.col("d"), F.lit(1.0), 0.5, "linear")).head()
    assert tuple(r) == (0.5, -0.25, 0.0, 5.0)


def test_dictionary(spark):
    df = spark.sql("SELECT array(1L, 2L) AS a, array(3L, 5L) AS b")
    bound = operations.operation("VERB_CAUSES")(F.col("a"), F.col("b"))
    back = operations.operation("verb_causes")(bound, F.col("b"))
    assert df.select(back).head()[0] == [1, 2]
    assert operations.described("mexican hat")[0] == "HAM_MEXICAN_HAT"
    with pytest.raises(KeyError):
        operations.operation("NO_SUCH")


def test_separation():
    model = {"y": ["x", "z"], "x": ["z"], "c": ["x", "y"]}
    assert not causal.separated(model, "x", "y", {"z"})
    assert causal.separated({"b": ["a"], "c": ["b"]}, "a", "c", {"b"})
    assert causal.separated({"c": ["a", "b"]}, "a", "b", set()) and not causal.separated({"c": ["a", "b"]}, "a", "b", {"c"})


def test_deltas(words):
    df, _ = words
    old, new = df.where("id < 40").select("id", "a"), df.where("id > 10").select("id", F.when(F.col("id") % 3 == 0, F.col("b")).otherwise(F.col("a")).alias("a"))
    made = versions.deltas(old, new, ["id"], "a")
    after = versions.applied(old, made, ["id"], "a")
    assert sorted(map(tuple, [(r["id"], tuple(r["a"])) for r in after.collect()])) == sorted((r["id"], tuple(r["a"])) for r in new.collect())


def test_gram_bits_by_plain_loops(spark):
    """Signatures of texts, one byte after another, and the nearest ones by them."""

    def plain(text):
        text = text.lower()
        grams = {text[i : i + n] for n in (3, 4) for i in range(len(text) - n + 1)} | {w for w in text.split() if len(w.encode()) >= 4}
        held = set()
        for gram in grams:
            h = 5381
            for b in gram.encode():
                h = (33 * h + b) % (1 << 64)
            held.add(h % 384)
        return held

    texts = ["", "ab", "The quick brown fox", "Größe und Maß, ein Wort", "日本語 テキスト です", "x" * 300, "mixed é\u3000wide space", "a\tb\nlonger-word " * 20]
    for t in texts:
        assert set(np.flatnonzero(text.gram_bits(t)).tolist()) == plain(t)
    rows = {r["id"]: r["words"] for r in text.signatures(spark.createDataFrame(list(enumerate([*texts, None])), "id long, t string"), "id", "t").collect()}
    for i, t in enumerate([*texts, ""]):
        assert {32 * w + b for w, x in enumerate(rows[i]) for b in range(32) if x >> b & 1} == plain(t)


def test_dictionary_has_all_names(spark):
    every = operations.dictionary(256, 64)
    assert len([n for n in every if n.startswith("VERB_")]) == 12 and len(every) >= 112
    assert {"VERB_CONTRADICTS", "VERB_GROUNDS", "VERB_ABSTRACTS", "VERB_REFINES"} <= set(every)
    with pytest.raises(ValueError):
        search.similarity_join(spark.sql("SELECT 1 AS id, array(1L, 2L) AS w"), "id", "w", 20)


def test_near_join_loses_no_pair(spark):
    rng = np.random.default_rng(8)
    a = [(i, [int(x) for x in rng.integers(0, 1 << 32, 8)]) for i in range(40)]
    b = [(i, [x ^ int(m) for x, m in zip(w, rng.choice([0, 1, 6, 1 << 30], 8), strict=True)]) for i, w in a]
    left, right = spark.createDataFrame(a, "x long, w array<long>"), spark.createDataFrame(b, "y long, v array<long>")
    out = {tuple(r) for r in search.near_join(left, "x", "w", right, "y", "v", 9, 256).collect()}
    want = {(i, j, d) for i, w in a for j, v in b if (d := sum((p ^ q).bit_count() for p, q in zip(w, v, strict=True))) <= 9}
    assert out == want and len(want) > 20


def test_membrane_counts_each_limit_once(spark):
    """Two numbers a row, in one task: the regions' bits by brute force, in a time that a scan for each word exceeds."""
    import time

    from tessera.functions import spectral

    rows = spark.range(0, 3000, 1, 1).select("id", (F.col("id") / 1500.0 - 1.0).alias("tau"), (F.col("id") % 11 / 10.0).alias("sigma"))
    start = time.time()
    got = rows.select("tau", "sigma", spectral.encode(F.col("tau"), F.col("sigma"), F.lit("a")).alias("words")).collect()
    assert time.time() - start < 60
    places = {name: [(spectral.REGIONS[name][0] + i, x) for i, x in enumerate(spectral.basis(name))] for name in ("tau", "sigma")}
    for r in got[::250]:
        whole = sum((w & (1 << 64) - 1) << 64 * i for i, w in enumerate(r["words"]))
        assert len(r["words"]) == 157 and all((whole >> p & 1) == (x < r["tau"]) for p, x in places["tau"])
        assert all((whole >> p & 1) == (x < r["sigma"] * 2 - 1) for p, x in places["sigma"])

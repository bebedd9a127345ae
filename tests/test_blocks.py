"""Signatures compared block by block, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, search


def signatures(count, words, word_bits, flips, clusters, seed):
    """Ids and signatures around a few centres, with copies."""
    rng = np.random.default_rng(seed)
    draw = lambda: [int(x) & (1 << word_bits) - 1 for x in rng.integers(0, (1 << 64) - 1, words, dtype=np.uint64)]
    centres = [draw() for _ in range(clusters)]
    out = []
    for i in range(count):
        own = list(centres[i % clusters]) if i % 5 else draw()
        for _ in range(int(rng.integers(0, flips + 1))):
            at = int(rng.integers(0, words))
            own[at] ^= 1 << int(rng.integers(0, word_bits))
        out.append((i * 3, own))
    return out


def table_of(spark, rows):
    signed = [(i, [x - (1 << 64) if x >> 63 else x for x in w]) for i, w in rows]
    return spark.createDataFrame(signed, "id long, w array<long>").repartition(3)


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def within(rows, most):
    return sorted((i, j, d) for k, (i, a) in enumerate(rows) for j, b in rows[k + 1 :] if (d := apart(a, b)) <= most)


@pytest.mark.parametrize("limit", [1 << 14, 60])
def test_weak_bands(spark, monkeypatch, limit):
    """All pairs are compared, and none of them is a row of a join."""
    monkeypatch.setattr(blocks, "block_rows", lambda size: limit)
    rows = signatures(400, 2, 32, 6, 5, 1)
    odd = spark.createDataFrame([(None, [1, 2]), (9001, None), (9002, [1, None]), (9003, [1])], "id long, w array<long>")
    found = search.similarity_join(table_of(spark, rows).union(odd), "id", "w", 13)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = within(rows, 13)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 5000


@pytest.mark.parametrize("limit", [1 << 14, 25])
@pytest.mark.parametrize(("words", "word_bits", "most"), [(40, 64, 39), (16, 32, 15), (10, 32, 12)])
def test_wide_signatures(spark, monkeypatch, limit, words, word_bits, most):
    """Bands of words and bands of bits; pairs with many equal bands come once."""
    monkeypatch.setattr(blocks, "block_rows", lambda size: limit)
    rows = signatures(200, words, word_bits, 14, 3, 2)
    found = [tuple(r) for r in search.similarity_join(table_of(spark, rows), "id", "w", most, words * word_bits, word_bits).collect()]
    want = within(rows, most)
    assert sorted(found) == want and len(want) > 1000


def test_rows_that_share_many_bands_meet_once(spark):
    """Of 60 equal bands one is kept, and its group's rows go there once."""
    rows = [(i, [7] * 60 + [i * 4 + k for k in range(4)]) for i in range(50)]
    groups = search.band_groups(table_of(spark, rows).withColumnRenamed("w", "words"), search.band_array("words", 64 * 64, 64, 64))
    assert groups.count() == 50 and groups.agg(F.max("band")).head()[0] == 0


@pytest.mark.parametrize("limit", [1 << 14, 60])
def test_nearest(spark, monkeypatch, limit):
    """The nearest with their ties, and no row of a pair that is not among them."""
    monkeypatch.setattr(blocks, "block_rows", lambda size: limit)
    rows = signatures(300, 2, 32, 3, 4, 3)
    found = search.nearest(table_of(spark, rows), "id", "w", 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for i, a in rows:
        for rank, (d, j) in enumerate(sorted((apart(a, b), j) for j, b in rows if j != i)[:3], 1):
            want.append((i, j, d, rank))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_nearest_of_few(spark):
    rows = table_of(spark, [(1, [1, 2]), (5, [1, 3])])
    assert sorted(map(tuple, search.nearest(rows, "id", "w", 3).collect())) == [(1, 5, 1, 1), (5, 1, 1, 1)]
    assert search.nearest(rows.where("id > 9"), "id", "w", 3).count() == search.similarity_join(rows.where("id > 9"), "id", "w", 13).count() == 0


def test_mutual_nearest_have_no_cross_join(spark):
    """The query itself compares by blocks."""
    from tessera import catalog

    catalog.load()
    made = catalog.QUERIES["reciprocal_topk"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "words" not in plan and "embedding" not in plan

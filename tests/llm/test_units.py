"""Parts that need no cluster: hashing, escaping, tables, probes, packing."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ann, chat, fingerprints, licenses, packing, sharding
from tessera.llm.ngram_join import parity, parity_gaps
from tessera.llm.words import alnum_bytes, grams, row_words, shingles, spaced_bytes, spans, text_buffer, word_hashes

TEXT = st.text(alphabet=st.sampled_from(list("aAbZ09 \t\n\x0b-_.,é世<|\\\x7f")), max_size=40)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=5), st.booleans())
def test_words_follow_their_pattern(texts, alnum):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if alnum else r"[^\x20\x09-\x0D]+"
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends = spans(data, offsets, alnum_bytes() if alnum else spaced_bytes())
    bounds = row_words(starts, offsets)
    hashes = word_hashes(data, starts, ends)
    named = {}
    for i, text in enumerate(texts):
        want = re.findall(pattern, lower(text or ""))
        own = slice(bounds[i], bounds[i + 1])
        got = [lower(data[s:e].tobytes().decode()) for s, e in zip(starts[own], ends[own], strict=True)]
        assert got == want
        for word, h in zip(want, hashes[own].tolist(), strict=True):
            assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)


def test_shingles_tell_orders_apart():
    rows = ["a b b a c", "b a a b c", "a b", "", "b a", "x y z u v w"]
    data, offsets = text_buffer(pa.array(rows))
    starts, ends = spans(data, offsets, spaced_bytes())
    items, bounds = shingles(word_hashes(data, starts, ends), row_words(starts, offsets), 5)
    assert np.diff(bounds).tolist() == [1, 1, 1, 0, 1, 2] and len(set(items.tolist())) == 6


def test_long_words_and_texts():
    rows = ["a" * 700_000 + " b", "A" * 700_000, ("xy " * 300_000)]
    data, offsets = text_buffer(pa.array(rows))
    starts, ends = spans(data, offsets, spaced_bytes())
    h = word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] != h[0] and len(set(h[3:].tolist())) == 1 and len(h) == 300_003


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_escape_round_trip(text):
    escaped = chat.escape(text)
    assert "<|" not in escaped and chat.unescape(escaped) == text


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 1009)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 1009
    heavy = Counter(sharding.lookup_table(shards, 1009, {"s0": 3}))
    assert heavy[0] > 2.8 * heavy[1]
    # a plain version: all permutations written out
    free, at, want = set(range(1009)), [0] * 7, [-1] * 1009
    orders = [[(sharding.digest(f"{s}:offset") + i * (sharding.digest(f"{s}:skip") % 1008 + 1)) % 1009 for i in range(1009)] for s in shards]
    while free:
        for i in range(7):
            while free and orders[i][at[i]] not in free:
                at[i] += 1
            if free:
                want[orders[i][at[i]]] = i
                free.discard(orders[i][at[i]])
    assert table == want
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_probes_come_by_chance():
    point, offsets = np.array([0.3, -1.2, 0.9]), np.array([0.1, 0.6, 0.4])
    cells = ann.probes(point, offsets, 1.25, 0.4, -5.0)
    assert len({tuple(c) for c in cells.tolist()}) == len(cells)
    rng = np.random.default_rng(1)
    near = 0.4 * point + np.sqrt(1 - 0.16) * rng.standard_normal((20000, 3))
    found = Counter(map(tuple, np.floor(near / 1.25 + offsets).astype(int).tolist()))
    shares = np.array([found[tuple(c)] for c in cells.tolist()]) / 20000
    logs = ann.chances(point, cells, offsets, 1.25, 0.4).sum(axis=1)
    assert np.abs(shares - np.exp(logs)).max() < 0.02 and (np.diff(logs) <= 1e-9).all() and logs.min() >= -5
    # the others are less likely, every one
    grid = np.array(list(itertools.product(range(-6, 7), repeat=3)))
    assert (ann.chances(point, grid, offsets, 1.25, 0.4).sum(axis=1) >= -5).sum() == len(cells)
    assert len(ann.probes(point, offsets, 1.25, 0.4, 0.0)) == 1 and ann.probes(point[:0], offsets[:0], 1.0, 0.0, 0.0).shape == (1, 0)


def test_cosines_do_not_depend_on_place():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((50, 64)), np.repeat(rng.standard_normal((1, 64)), 50, axis=0)
    assert len(set(ann.cosines(np.repeat(a[:1], 50, axis=0), b).tolist())) == 1
    assert np.isfinite(ann.cosines(a * 1e200, b * 1e-200)).all()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=120), st.sets(st.integers(0, 400), max_size=120))
def test_parities_bound_differences(a, b):
    hashed = {x: (x * 0x9E3779B97F4A7C15) % (1 << 57) for x in a | b}
    x, y = (np.array(sorted(hashed[i] for i in s), np.uint64) for s in (a, b))
    gap = parity_gaps([parity(x), parity(y)], np.array([0]), np.array([1]))[0]
    if max(len(parity(x)), len(parity(y))) <= 2 * min(len(parity(x)), len(parity(y))):
        assert gap <= len(a ^ b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=30), st.integers(0, 3))
def test_packing_keeps_every_token(sizes, seed):
    rng = np.random.default_rng(seed)
    index = bm25_index([rng.integers(0, 40, 8) for _ in sizes])
    full, last = packing.packed(sizes, index)
    sequences = full + packing.by_powers(last)
    assert all(sum(n for _, _, n in s) == packing.WINDOW for s in full)
    for s in sequences:
        n = sum(m for _, _, m in s)
        assert n == packing.WINDOW or n & (n - 1) == 0
    covered = {}
    for d, start, n in (p for s in sequences for p in s):
        covered.setdefault(d, []).append((start, n))
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted(covered[d]):
            assert start == at
            at += n
        assert at == size


def bm25_index(docs):
    """An index over lists of small numbers as words, its table the documents themselves."""
    words = [np.array(d, np.uint32) << np.uint32(packing.HASH_BITS - packing.CLASS_BITS) for d in docs]
    df = np.zeros(packing.CLASSES)
    for d in docs:
        df[list(set(map(int, d)))] += 1
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    return packing.Index(np.concatenate([np.zeros(0, np.uint32), *words]), np.cumsum([0, *map(len, docs)]), idf, max(1.0, sum(map(len, docs)) / max(1, len(docs))))


def test_decoding_gives_the_texts_back():
    ranks = chat.default_ranks()
    import public_tokenizers

    encode = packing.encoder(ranks, public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "Hello  wörld é世 🙂", "a <|endoftext|> b", "", "x" * 50, "tab\tnew\nline "]
    ids = [encode(t) for t in texts]
    data, offsets = packing.decoded(np.concatenate(ids), np.array([len(x) for x in ids]), packing.vocabulary(ranks[0]))
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])] == texts


@pytest.mark.parametrize("docs", [5, 60])
def test_index_weights_are_bm25(docs):
    rng = np.random.default_rng(docs)
    rows = [(np.minimum(rng.geometric(0.08, rng.integers(1, 90)), 200) + 300).tolist() for _ in range(docs)]
    mean = sum(map(len, rows)) / docs
    index = bm25_index(rows)
    for seed in range(docs):
        want = np.zeros(docs)
        for w in set(rows[seed]):
            df = sum(w in d for d in rows)
            for i, d in enumerate(rows):
                if df > 1 and w in d:
                    tf = d.count(w)
                    want[i] += np.log1p((docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(seed), want, rtol=1e-4, atol=1e-4)
        unused = rng.random(docs) < 0.7
        rounded = np.round(index.scores(seed), 3)
        assert list(index.neighbours(seed, unused)) == sorted(np.flatnonzero(unused & (rounded > 0)).tolist(), key=lambda i: (-rounded[i], i))


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 2000
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)])
        s = fingerprints.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        p = fingerprints.prints(s, np.array([False, False]))
        errors.append(fingerprints.likeness(p[:1], p[1:])[0] - share / (2 - share))
    assert np.abs(errors).max() < 0.15 and np.abs(np.mean(errors)) < 0.06
    none = fingerprints.prints(fingerprints.signatures(np.zeros(0, np.uint64), np.array([0, 0])), np.array([True]))
    assert fingerprints.likeness(none, none)[0] == 1.0 and fingerprints.likeness(none, p[:1])[0] == 0.0


def test_templates_are_whole_texts():
    rows = licenses.template_rows()
    assert max(r[5] for r in rows) > 150 and len({r[0] for r in rows}) == len(licenses.BASE) + len(licenses.OWN) + len(licenses.TEXTS)
    assert len({x for r in rows for x in [(r[1], *map(int, np.concatenate(licenses.gram_hashes([r[7]], r[1]))))]}) == len({(r[1], r[7]) for r in rows})
    assert grams(np.array([1, 2], np.uint64), 3).size == 0

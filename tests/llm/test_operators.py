"""The operators against brute force, on the small tables and on rows with nulls, ties, repeats and odd columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, chat, common, fingerprints, language, licenses, mixing, ngram_join, packing, queries, sharding, urls
from tests.conftest import DATA, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, set_key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and long texts, repeats, near copies and clashing column names."""
    body = " ".join(f"w{i}" for i in range(120))
    near = body.replace("w60", "changed")
    far = " ".join(f"w{i}" for i in range(60, 180))
    texts = [body, body, near, far, None, "", "  ", "one two", "one two", "one", "12 34 !!", "é世", "x " * 30000, "y" * 200000, f"{body} released under the MIT License. MIT license"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None, "t", "k") for i, t in enumerate(texts)]
    rows += [rows[0], (None, body, "en", "s1", 1, "t", "k"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.sql(queries.ORACLE_SQL[name]).df())


def test_bitmap_loses_nothing(spark):
    rows, wanted = spark.range(5000), spark.range(0, 5000, 37)
    kept = common.flag_by_bitmap(rows, "id", wanted, "id", "maybe", bits=14).where("maybe")
    assert kept.join(wanted, "id").count() == wanted.count() and kept.count() < 1000


def test_components(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(400, 440)]
    out = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert out == {x: find(x) for p in links for x in p if p[0] != p[1]} | {x: out[x] for x in out if x not in root}


# ---- 1
def test_chat(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a\n<|im_end|>"), (1, None, None, None), (2, 1, "assistant", None), (None, 1, "user", "x"), (1, 2, "assistant", "b"), (3, 0, "assistant", "<\\\\|é" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    segments = chat.format_conversations(turns)
    out = {r["conv_id"]: r for r in collected(chat.digests(segments))}
    said = [("", ""), ("user", "a\n<|im_end|>"), ("assistant", "b"), ("assistant", "b")]
    assert out[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (4, 2, hashlib.sha256(b"bb").hexdigest())
    assert out[3]["loss_chars"] == 25000 and out[2]["loss_chars"] == 0 and out[None]["n_turns"] == 1
    whole = {r["conv_id"]: r for r in collected(chat.assembled(segments))}
    assert all(len(r["input_ids"]) == len(r["loss_mask"]) for r in whole.values()) and sum(whole[1]["loss_mask"]) == 2
    assert collected(chat.digests(chat.format_conversations(turns.limit(0)))) == []


# ---- 2
def test_language_accuracy(spark):
    out = queries.op2_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in collected(out) if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.95


def test_language_mixture(spark, documents, odd, empty):
    model = language.fit(documents)
    en, de = (documents.where(F.col("lang") == x).orderBy("doc_id").head()["text"][:1500] for x in ("en", "de"))
    out = collected(language.predict(spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string"), model))[0]
    shares = {x.split(":")[0]: float(x.split(":")[1]) for x in out["languages"].split(",")}
    assert set(shares) == {"en", "de"} and all(0.3 < s < 0.7 for s in shares.values())
    junk = "x7Qz9vKp2LwRt8Yc" * 60
    assert collected(language.predict(spark.createDataFrame([(1, junk)], "doc_id long, text string"), model))[0]["other"] > 0.5
    made = collected(language.predict(odd, model))
    assert len(made) == odd.count() and sum(r["lang_pred"] == "und" for r in made) == 5
    assert language.accepted(odd, model).schema == odd.schema
    assert collected(language.predict(empty, model)) == []
    assert {r["lang_pred"] for r in collected(language.predict(odd, language.fit(empty)))} == {"und"}


def test_language_sample(spark, documents):
    rows = documents.where("lang is not null").unionByName(documents.where("lang is null").withColumn("doc_id", F.lit(None).cast("long")))
    first = {}
    for r in collected(rows.where("lang is not null").select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id")):
        first.setdefault(r["lang"], []).append(r["doc_id"])
    chosen = rows.where(F.col("doc_id").isin([i for ids in first.values() for i in ids[:7]]))
    some, whole = language.fit(rows, sample=7), language.fit(chosen)
    assert some.languages == whole.languages == sorted(first) and (some.chances == whole.chances).all()


def test_expectation_maximisation_never_worsens():
    rng = np.random.default_rng(1)
    chances = rng.random((200, 3)) + 0.01
    share, value = language.expectation_maximisation(chances, np.ones(200))
    assert share.sum() == pytest.approx(1) and value >= np.log(chances @ np.full(3, 1 / 3)).sum()


def test_language_of_a_long_text_is_that_of_its_stretches(spark, documents):
    """A text over the bound of a batch is counted in stretches, to the same proportions, in little memory."""
    model = language.fit(documents)
    run = language.predictor(model, language.BITS)
    texts = [r["text"] for r in documents.where("lang is not null and text is not null").limit(40).collect()]
    for text in (" ".join(texts * 30), "é" * 1_200_000 + "日本", "1 2 " * 900_000, "." * 3_000_000 + "x"):
        column = pa.array([text])
        assert column.nbytes > 2 * language.PIECE
        classes, bounds = language.grams(column, language.BITS)
        assert (language.gram_counts(column, language.BITS, 1000) == np.bincount(classes, minlength=1 << language.BITS)).all() and len(bounds) == 2
        assert np.allclose(run(column), run(pa.array([text, None]))[:1], atol=1e-6)
        assert language.has_letter(column, 1000) == any(map(str.isalpha, text))


def brute_mixture(model, text):
    """The set of languages and their shares by plain loops: byte 4-grams, greedy growth, many EM steps."""
    letter = lambda b: chr(b).lower() if b < 128 and chr(b).isalpha() else chr(b) if b >= 128 else " "
    out = " " + "".join(map(letter, text.encode())) + "    "
    grams = [out[i : i + 4] for i in range(len(out) - 3) if out[i] != " " or out[i + 1] != " "]
    own = np.array([model.chances[(int.from_bytes(g.encode("latin-1"), "little") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)] for g in grams], float)
    n = len(own) / language.ORDER
    penalty = language.PENALTY * 0.5 * np.log(max(n, 2))
    chosen = [int(np.log(own[:, :-1]).sum(axis=0).argmax())]
    value, share = np.log(own[:, chosen[0]]).sum() / language.ORDER, np.ones(1)
    while True:
        tries = []
        for c in set(range(own.shape[1])) - set(chosen):
            w = np.full(len(chosen) + 1, 1 / (len(chosen) + 1))
            for _ in range(400):
                p = own[:, [*chosen, c]] * w
                w = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
            tries.append((np.log(own[:, [*chosen, c]] @ w).sum() / language.ORDER, c, w))
        best = max(tries, key=lambda t: t[0], default=None)
        if not best or best[0] - value <= penalty:
            return {c: s for c, s in zip(chosen, share, strict=True)}
        value, share, chosen = best[0], best[2], [*chosen, best[1]]


def test_language_mixtures_by_brute_force(spark, documents):
    model = language.fit(documents)
    run = language.predictor(model, language.BITS)
    rows = [r["text"] for r in documents.where("length(text) between 200 and 1500").orderBy("doc_id").limit(12).collect()]
    for text in [*rows, rows[0][:400] + " " + rows[1][:400] + " " + rows[2][:400], "zqx jvkq wxzz " * 20]:
        want, got = brute_mixture(model, text), run(pa.array([text]))[0]
        assert set(np.flatnonzero(got > 0).tolist()) == set(want)
        assert all(abs(got[c] - s) < 0.02 for c, s in want.items())


def test_clashing_names_stay(spark, documents):
    docs = documents.limit(40)
    for c in ("copies", "upto_hash", "mix_source", "mix_copy", "at", "word", "flags", "bitmap_word", "bitmap_bits", "sharding_key", "sharding_parts", "maybe", "slot", "edge", "hash"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for out in (mixing.mixed(docs), corpus_pipeline.near_duplicates(spark, docs, ""), sharding.place(docs, "doc_id", most=1, spread_by="text").drop("shard")):
        first = out.first().asDict()
        assert list(first) == [c for c in out.columns] and set(docs.columns) <= set(first)
        assert all(first[c] == f"own {c}" for c in docs.columns[5:] if c != "slot")


def test_near_duplicates_judges_rows(spark):
    """Of an id with two texts only the linked one goes; rows without an id go when an id has their text."""
    made = lambda n: " ".join(f"{n}w{i}" for i in range(40))
    rows = [(0, made("a")), (1, made("a") + " more"), (1, made("b")), (2, made("c")), (2, made("c")), (None, made("c")), (None, made("d")), (None, made("d")), (None, None), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = sorted(((r["doc_id"], r["text"]) for r in collected(corpus_pipeline.near_duplicates(spark, docs, ""))), key=str)
    want = [(0, made("a")), (1, made("b")), (2, made("c")), (None, made("d")), (None, None), (3, None), (3, "")]
    assert out == sorted(want, key=str)


# ---- 3
def test_nearest_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), ann.unit(np.array([r["embedding"] for r in rows], np.float64))
    found = {}
    for r in collected(queries.op3_nearest(spark, "/root/testdata/sf0.1")):
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[q]
        scores[q] = -2
        top = ids[np.lexsort((ids, -scores))[:5]]
        hits += len(set(top.tolist()) & set(found[int(ids[q])]))
        total += 5
        for v, s in found[int(ids[q])].items():
            assert s == pytest.approx(scores[np.flatnonzero(ids == v)[0]], abs=1e-6)
    assert len(found) == (ids % 50 == 0).sum() and hits / total >= 0.9


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("bucket", F.lit(1)).withColumn("rank", F.lit("x"))
    out = [(r["rank"], r["vec_id"], r["score"]) for r in collected(ann.nearest(df, "vec_id = 0").orderBy("rank"))]
    assert out == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert collected(ann.nearest(df.limit(0), "vec_id = 0")) == []


def test_nearest_scores_all_rows_for_lonely_queries(spark):
    made = np.random.default_rng(3)
    x = made.standard_normal((900, 16)) * 0.05 + np.eye(16)[0]
    x[0] = -x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = collected(ann.nearest(df, "vec_id % 100 = 0"))
    assert sorted((r["query_id"], r["rank"]) for r in out) == [(q, i) for q in range(0, 900, 100) for i in range(1, 6)]
    scores = ann.cosines(np.repeat(x[:1], 899, axis=0), x[1:])
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 0] == (np.lexsort((np.arange(899), -scores))[:5] + 1).tolist()


@pytest.mark.parametrize("spread, most, rows", [(0.3, 0.15, 6000), (3.0, 1.0, 3000)])
def test_nearest_takes_its_plan_from_the_data(spark, spread, most, rows):
    """Recall against brute force, and the share of pairs that are scored: few of clustered vectors, no more than all of
    nearly random ones."""
    made = np.random.default_rng(5)
    x = made.standard_normal((60, 48))[made.integers(0, 60, rows)] + spread * made.standard_normal((rows, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    all_rows = df.selectExpr("vec_id", "embedding as v")
    plan = ann.sampled(all_rows, all_rows.where("vec_id % 50 = 0"), 5, {48: rows})[48]
    x, asked, scored = ann.unit(x), range(0, rows, 50), 0
    for t in range(plan.tables):
        directions, offsets = ann.projections_of(48, t, plan.projections)
        buckets = ann.code(np.floor(x @ directions.T / plan.width + offsets).astype(np.int64))
        for q in asked:
            scored += np.isin(buckets, ann.code(ann.probes(directions @ x[q], offsets, plan.width, plan.similarity, plan.least))).sum()
    assert plan.projections and scored <= most * rows * len(asked)
    found = {}
    for r in collected(ann.nearest(df, "vec_id % 50 = 0")):
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & set([i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:5])) for q in asked)
    assert hits >= 0.9 * 5 * len(asked)


def test_nearest_gives_a_repeated_id_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.01 * i]) for i in range(7)] + [(i, [1.0, float(i)]) for i in range(2, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r["rank"], r["vec_id"]) for r in collected(ann.nearest(df, "vec_id = 0").orderBy("rank"))]
    assert out == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


# ---- 4
def test_licenses_odd_rows(odd, empty):
    out = collected(licenses.scan(odd))
    assert len(out) == odd.count()
    row = next(r for r in out if r["doc_id"] == 14)
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"], row["labels"], row["score"]) == (127, 2, 123, 125, "mit", "mit", 1.0)
    assert next(r for r in out if r["doc_id"] == 4)["n_words"] == 0
    assert collected(licenses.scan(empty)) == []


def test_license_texts_and_many_hits(spark):
    """A whole text with words changed here and there, and a text of very many hits."""
    mit = licenses.phrase_words(licenses.TEXTS["mit"])
    changed = [*mit[:6], "indeed", *mit[6:90], *mit[91:130], "surely", "also", *mit[130:]]
    many = "mit license " * 200_000
    rows = [(1, " ".join(changed)), (2, many), (3, " ".join(mit[:70])), (4, "gnu general new public license")]
    out = {r["doc_id"]: r for r in collected(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert out[1]["labels"] == "mit" and 0.85 < out[1]["score"] < 1
    assert (out[2]["n_base"], out[2]["first_word"], out[2]["last_word"], out[2]["n_words"]) == (200_000, 0, 399_998, 400_000)
    assert out[3]["labels"] == "mit" and out[4]["base_labels"] == ""


def test_license_spans(spark):
    text = "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software"
    rows = [(1, text), (2, "under the GNU General Public License, version 3"), (3, "mit licence"), (4, "Licensed under CC BY-NC 4.0.")]
    out = {r["doc_id"]: r for r in collected(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert out[1]["labels"] == "mit" and 0.8 <= out[1]["score"] < 1 and out[1]["n_base"] == 0
    assert (out[2]["base_labels"], out[2]["first_word"]) == ("gpl", 3) and out[3]["labels"] == "" and out[4]["labels"] == "cc-by-nc"


# ---- 5
def test_packing(spark, documents, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (documents, odd.where("doc_id is not null").dropDuplicates(["doc_id"]).union(odd.limit(1).select(F.lit(99).cast("long"), F.lit("a <|endoftext|> b"), *odd.columns[2:]))):
        ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in collected(docs)}
        sequences, covered = {}, {}
        for r in collected(packing.pack(docs)):
            own = ids[r["doc_id"]]
            assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        for pieces, sizes in ((sequences.values(), None), (covered.values(), True)):
            for own in pieces:
                at = 0
                for start, n in sorted(own):
                    assert start == at
                    at += n
                assert sizes or at <= 2048 and (at == 2048 or at & (at - 1) == 0)
        assert {d: sum(n for _, n in p) for d, p in covered.items()} == {d: len(x) for d, x in ids.items()}
    assert len({(r["sequence_id"], r["offset"]) for r in collected(packing.pack(odd))}) == packing.pack(odd).count()
    assert collected(packing.pack(empty)) == []


def topics_apart(docs, topic, **options):
    """Sequences of a packing, and the share of pairs of documents of a sequence that have the same topic."""
    members, lengths = {}, {}
    for r in collected(packing.pack(docs, **options)):
        members.setdefault(r["sequence_id"], set()).add(r["doc_id"])
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    pairs = [topic(a) == topic(b) for own in members.values() for a in own for b in own if a < b]
    return members, sum(pairs) / max(1, len(pairs)), sum(n < 2048 for n in lengths.values())


def test_packing_does_not_depend_on_partitions(spark):
    """400 documents of 50 topics: the same sequences from any partitions, most pairs of one topic, few short ones."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"topic{i % 50}word{w}" if rng.random() < 0.6 else f"common{w}" for w in rng.integers(0, 60, 60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, share, short = topics_apart(docs.coalesce(1), lambda d: d % 50)
    assert share > 0.3 and short <= 11
    for n in (8, 40):
        assert topics_apart(docs.repartition(n), lambda d: d % 50) == (first, share, short)


def test_packing_deals_by_content(spark):
    """Shards of few ids: near copies meet, a large group of copies is spread, and every shard's rest is filled."""
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{w}" for w in rng.integers(0, 3000, 150)) for _ in range(60)]
    rows = [(i, base[i % 60] + f" own{i}") for i in range(120)] + [(i, "copies of one text " * 20) for i in range(1000, 1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    members, _, short = topics_apart(docs, lambda d: d, shard=8192)
    assert short <= 11 and {d for own in members.values() for d in own} == {i for i, _ in rows}
    assert sum(any({i, i + 60} <= own for own in members.values()) for i in range(60)) >= 45


def test_deal_splits_what_is_frequent(spark):
    """A slot of many ids gets shards of its own, of bounded size even if all its documents are copies."""
    rows = [(i, 10, 0, lead, second, int(packing.salts(pa.array([i]))[0]), b"") for i, (lead, second) in enumerate([(5, 1)] * 2 + [(900, 7)] * 300 + [(70, 3)] * 3 + [(1800, i % 5) for i in range(100)])]
    shards = {r["doc_id"]: r["shard"] for r in collected(packing.dealt(spark.createDataFrame(rows, packing.TOKENS), 100))}
    assert len(shards) == len(rows) and len({shards[i] for i in (0, 1, 302, 303, 304)}) == 1
    copies = [shards[i] for i in range(2, 302)]
    assert len(set(copies)) == 30 and max(map(copies.count, copies)) <= 25 and shards[0] not in copies


# ---- 6
def test_sharding_odd_rows(odd, empty):
    out = collected(sharding.place(odd.withColumn("slot", F.lit("clash")), "doc_id", ["a", "b", "c"], 101))
    assert len(out) == odd.count() and set(out[0]) == {*odd.columns, "slot", "shard"}
    assert len({(r["slot"], r["shard"]) for r in out if r["doc_id"] == 0}) == 1
    assert collected(sharding.place(empty, "doc_id", ["a"], 101)) == []


def test_sharding_spreads_hot_keys(spark):
    rows = spark.range(3000).withColumn("source", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    shards = [f"s{i}" for i in range(10)]
    one = sharding.place(rows, "source", shards, 1009).where("source = 'hot'").select("shard").distinct().count()
    many = sharding.place(rows, "source", shards, 1009, most=50, spread_by="id").where("source = 'hot'").groupBy("shard").count()
    assert one == 1 and many.count() >= 7 and many.agg(F.max("count")).head()[0] < 400


# ---- 7
def test_mixing_targets(spark, odd, empty):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 0), (None, 90)], "source string, source_size long")
    out = {r["source"]: r["target"] for r in collected(mixing.targets(sources))}
    # by hand: weights 3 1 2 3 1 of 2400 tokens; a, None and c reach their limits, b takes the rest
    assert out["a"] == 20 and out[None] == 180 and out["c"] == 1000 and out["d"] == 0 and out["b"] == pytest.approx(2400 - 1200)
    made = collected(mixing.mix(odd))
    assert len(made) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in made)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in made) == sorted(words(r["text"]) for r in collected(odd))
    assert collected(mixing.mix(empty)) == [] and mixing.mixed(empty).columns == empty.columns


def test_mixing_takes_empty_documents_at_most_twice(spark):
    docs = spark.createDataFrame([(i, "a b c" if i < 3 else "", f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    most = collected(mixing.mixed(docs).groupBy("doc_id").count().agg(F.max("count").alias("n")))
    assert most[0]["n"] <= 2


def test_mixing_reaches_targets(spark):
    made = collected(mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")))
    assert sum(r["taken"] for r in made) == pytest.approx(1.5 * sum(r["size"] for r in made), rel=0.02)


# ---- 8
def test_fingerprints(odd, empty, documents):
    for docs in (odd, documents):
        rows = sorted(collected(docs), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""), reverse=True)
        texts = [r["text"] or "" for r in rows]
        out = collected(fingerprints.fingerprint(docs))
        want = []
        for i, t in enumerate(texts):
            following = texts[(i + 1) % len(texts)]
            n = len(t) // 3
            want.append((str(rows[i]["doc_id"]), len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == sorted(want)
        by_text = {}
        for r in out:
            by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = [r["fingerprint"] for r in collected(fingerprints.fingerprint(odd)) if r["doc_id"] in (0, 1)]
    assert len(set(same)) == 1
    assert collected(fingerprints.fingerprint(empty)) == []


def test_band_join_equals_exact_join(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = {r["doc_id"]: r["component_id"] for r in collected(ngram_join.ngram_components(docs))}
    bands = {r["doc_id"]: r["component_id"] for r in collected(fingerprints.near_duplicates(docs))}
    assert sum(exact[d] != bands[d] for d in exact) <= 0.01 * len(exact)
    assert fingerprints.near_duplicates(empty).count() == 0 and fingerprints.near_duplicates(odd).count() == odd.count()


# ---- 9
def test_urls(spark):
    rows = [(1, "https://A.Example.NET/en/x?y#z"), (2, "http://x.net"), (3, "http://x.net/"), (4, "http://example.com/de/1"), (5, "http://badexample.com/de/1"), (6, None), (7, "nohost"), (8, "http://b.org/fr/?a"), (9, "http://example.net/de/"), (10, "a://b://c/d"), (11, "http://net/q"), (11, "http://net/q")]
    out = {r["page_id"]: r for r in collected(urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))))}
    assert {k: r["rule"] for k, r in out.items()} == {1: "example.net/en/", 2: None, 3: "net/", 4: "example.com/de/", 5: None, 6: None, 7: None, 8: "org/fr/", 9: "net/", 10: None, 11: "net/"}
    assert (out[1]["host"], out[1]["path"], out[1]["verdict"], out[3]["verdict"]) == ("a.example.net", "/en/x", "allow", "block")
    assert (out[6]["host"], out[6]["path"], out[10]["host"], out[10]["path"]) == ("", "", "b:", "//c/d")
    assert {r["verdict"] for r in out.values()} == {"allow", "block"}
    nothing = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert collected(urls.judge(nothing))[0]["verdict"] == "allow" and urls.judge(nothing.limit(0)).count() == 0


def test_url_trees_learn(spark):
    rows = [(i, f"http://good{i % 7}.example.com/a/{i}") for i in range(60)] + [(100 + i, f"http://x-{i}-{i * 7}.example.org/{i}{i}{i}/p?a=1&b=2&c={i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = pages.where("page_id % 2 = 0").select("url", (F.col("page_id") >= 100).cast("int").alias("label"))
    out = collected(urls.judge(pages, rules=(), labelled=labelled))
    assert sum((r["verdict"] == "block") == (r["page_id"] >= 100) for r in out) >= 115
    table = {(r["label"], r["prediction"]): r["n"] for r in collected(urls.accuracy(pages, (), pages.select("url", (F.col("page_id") >= 100).cast("int").alias("label"))))}
    assert sum(n for (a, b), n in table.items() if a == b) >= 0.9 * sum(table.values()) > 0


def test_urls_features_by_brute_force_and_odd_rows(spark):
    long = "http://long.example.com/" + "x/1" * 60000
    rows = [(None, "http://a.com/b"), (1, long), (2, None), (3, ""), (4, "http://a-b.c.co/x//y/?p=1&q=2&&r#f?z"), *[(5, "http://hot.net/")] * 300, (6, "http://é世.org/fr/é")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("url_length", F.lit("clash")).withColumn("suffix", F.lit("clash"))
    out = collected(urls.featured(urls.ruled(pages)))
    assert len(out) == len(rows) == urls.judge(pages).count()
    for r in out:
        url = r["url"] or ""
        counts = [url.count(c) for c in set(url)]
        bits = -sum(n / len(url) * np.log2(n / len(url)) for n in counts) if url else 0.0
        query = re.search(r"\?([^#]*)", url)
        want = (len(url), len(r["host"]), len(r["path"]), len([x for x in r["path"].split("/")[1:] if x]), len([x for x in r["host"].split(".") if x]), sum(c in "0123456789" for c in url) / max(1, len(url)), bits)
        assert want == pytest.approx(tuple(r[c] for c in urls.FEATURES[:7])) and r["parameters"] == (len([x for x in query[1].split("&") if x]) if query else 0)
    assert all(r["suffix_urls"] == pytest.approx(np.log(301)) for r in out if r["host"] == "hot.net")


# ---- 8 by plain Python
def test_fingerprints_by_brute_force(spark):
    """Fingerprints, and the likeness of edited and next texts, from minima taken one by one."""
    texts = {i: " ".join(f"w{(i * 7 + j) % 61}" for j in range(30 + i)) for i in range(6)} | {7: "", 9: "one two"}
    rows = collected(fingerprints.fingerprint(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)))
    a, b = fingerprints.permutations()

    def made(text):
        words = text.split()
        data, offsets = fingerprints.batch_shingles(pa.array([text]), 5)
        assert len(set(data.tolist())) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
        lows = [min((int(x) >> 32) * int(m) + int(c) & 0xFFFFFFFF for x in data) if words else None for m, c in zip(a, b, strict=True)]
        return [255 if x is None else (x * 0x9E3779B1 & 0xFFFFFFFF) >> 24 for x in lows]

    def alike(x, y):
        if all(v == 255 for v in x) or all(v == 255 for v in y):
            return float(x == y)
        return min(1.0, max(0.0, (sum(p == q for p, q in zip(x, y, strict=True)) / 128 - 1 / 256) / (1 - 1 / 256)))

    order = sorted(texts, reverse=True)
    for r in rows:
        text, following = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        assert r["fingerprint"] == bytes(made(text)).hex() and r["edited_fingerprint"] == bytes(made(changed)).hex()
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and r["n_chars"] == len(text)
        assert (r["near_edited"], r["near_next"]) == pytest.approx((alike(made(text), made(changed)), alike(made(text), made(following))))


# ---- 10
def brute(rows, percent=80):
    sets = {}
    for key, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_ngram_join_edits(spark):
    """Families of copies at all distances, so that many pairs stand near the limit."""
    rng = np.random.default_rng(11)
    rows, key = [], 0
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(60 + 30 * family)]
        for _ in range(14):
            words = list(base)
            for _ in range(int(rng.integers(0, 8))):
                words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 10**9)}"
            rows.append((key, " ".join(words)))
            key += 1
    rows += [(1000 + i, t) for i, t in enumerate(["a b c d", "A B c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "", None])]
    out = collected(ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), sketch_bits=16))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows)


def test_ngram_join_odd_rows(odd, empty):
    out = collected(ngram_join.ngram_components(odd))
    assert len(out) == odd.count()
    want = brute([(r["doc_id"], r["text"]) for r in collected(odd) if r["doc_id"] is not None])
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in out if r["doc_id"] is not None)
    assert all(r["component_id"] is None for r in out if r["doc_id"] is None)
    assert collected(ngram_join.ngram_components(empty)) == []


# ---- pipeline
def test_pipeline_stages(spark, odd, empty, documents):
    for docs in (odd, documents):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, common.materialise(stage(spark, kept, DATA), name)
            assert kept.columns == docs.columns
            if name == "near_duplicates":
                best = {}
                for r in collected(before):
                    if r["doc_id"] is not None:
                        best[r["doc_id"]] = r["text"]
                want = {k for k, (n, c) in brute(best.items()).items() if n == 0 or c == k}
                assert sorted(r["doc_id"] for r in collected(kept) if r["doc_id"] is not None) == sorted(want)
            if name == "source_mix":
                copies = {}
                for r in collected(kept):
                    copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
                rows = collected(mixing.mix(before))
                assert sum(r["taken"] for r in rows) == sum(r["size"] * copies.get(r["doc_id"], 0) for r in rows if r["doc_id"] is not None) + sum(r["taken"] for r in rows if r["doc_id"] is None)
        assert corpus_pipeline.STAGES[-1][1](spark, kept, DATA).count() >= kept.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
    assert corpus_pipeline.run(spark, DATA).count() > 0

"""Searches by qualia, staged searches, validation, spectra, encodings, operators on signatures, and causal rungs."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.evidence import EDGES as CAUSAL
from tessera.catalog.evidence import TRUTHS, causal_edges, truths
from tessera.catalog.signatures import SIGS, signed
from tessera.catalog.walks import PLACES, L, Q, places
from tessera.catalog.walks import H as H8
from tessera.catalog.walks import words as words8
from tessera.catalog.wide import KIN_SQL, NEAR_SQL, PAIRED_SQL, WIDTH, H, kin, lead
from tessera.functions import fp, response, spectral, states, truth, vectors
from tessera.operators import causal, search, stats
from tessera.plans import hybrid
from tessera.session import materialise
from tessera.sources.star import edges, table


# ---- qualia: the first eight components of an embedding
def atoms(spark, sf_dir):
    """Rows beside the query's qualia, those of vec_id 8."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("qualia"), (F.col("vec_id") % 10 / 10.0).alias("f"))
    return rows, rows.where("vec_id = 8").head()["qualia"]


ATOMS = (
    "a AS (SELECT vec_id, [x::DOUBLE for x in embedding[1:8]] AS v, (vec_id % 10) / 10.0::DOUBLE AS f FROM embeddings), q AS (SELECT v AS w FROM a WHERE vec_id = 8),"
    " d AS (SELECT vec_id, f, v, w, sqrt(list_sum([(v[i] - w[i]) ** 2 for i in range(1, 9)])) AS l2, list_sum([v[i] * w[i] for i in range(1, 9)]) / (sqrt(list_sum([x * x for x in v])) * sqrt(list_sum([x * x for x in w]))) AS cosine FROM a, q),"
    " r AS (SELECT *, CASE WHEN l2 < 1.5 THEN 1 - l2 / 1.5 WHEN l2 < 3.0 THEN -0.5 * (1 - (l2 - 1.5) / 1.5) ELSE 0 END AS hat FROM d)"
)


@query(
    f"WITH {ATOMS} SELECT 'intuit' AS how, vec_id, round(hat, 6) AS score FROM (SELECT * FROM r WHERE hat > 0 ORDER BY hat DESC, vec_id LIMIT 6)"
    " UNION ALL SELECT 'associate', vec_id, round(cosine, 6) FROM (SELECT * FROM r ORDER BY cosine DESC, vec_id LIMIT 6)"
    " UNION ALL SELECT 'activation', vec_id, round(v[1], 6) FROM (SELECT * FROM r WHERE v[1] BETWEEN 0.0 AND 0.5 ORDER BY vec_id LIMIT 6) UNION ALL SELECT 'valence', vec_id, round(v[2], 6) FROM (SELECT * FROM r WHERE v[2] BETWEEN -0.5 AND 0.0 ORDER BY vec_id LIMIT 6)"
)
def qualia_searches(spark, sf_dir):
    rows, q = atoms(spark, sf_dir)
    q = F.lit(q)
    found = {
        "intuit": search.intuit(rows, "qualia", q, "vec_id", 6, 1.5, 3.0), "associate": search.associate(rows, "qualia", q, "vec_id", 6),
        "activation": search.by_quale(rows, "qualia", "activation", 0.0, 0.5, "vec_id", 6), "valence": search.by_quale(rows, "qualia", "valence", -0.5, 0.0, "vec_id", 6),
    }
    return functools.reduce(lambda a, b: a.union(b), (df.select(F.lit(name).alias("how"), "vec_id", F.round("score", 6).alias("score")) for name, df in found.items()))


@query(f"WITH {ATOMS} SELECT vec_id, round(1 - cosine, 6) AS score FROM d WHERE abs(v[2] - w[2]) > 1.5 OR f < 0.3")
def contradictions_of(spark, sf_dir):
    rows, q = atoms(spark, sf_dir)
    return search.contradicting(rows, "qualia", F.lit(q), F.col("f"), F.lit(0.8)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {ATOMS} SELECT vec_id, round(l2, 6) AS l2, round(cosine, 6) AS cosine, round(0.25 * w[1] + 0.75 * v[1], 6) AS blended, round(hat, 6) AS hat FROM r")
def qualia_functions(spark, sf_dir):
    rows, q = atoms(spark, sf_dir)
    v, q = F.col("qualia"), F.lit(q)
    return rows.select(
        "vec_id", F.round(vectors.l2(v, q), 6).alias("l2"), F.round(vectors.cosine(v, q), 6).alias("cosine"), F.round(vectors.blend(v, q, 0.25)[0], 6).alias("blended"),
        F.round(vectors.resonance(v, q, 1.5, 3.0), 6).alias("hat"),
    )


SEQ = "(SELECT xor(xor(a.w0, b.w0), b.w0) AS p0, xor(xor(a.w1, b.w1), b.w1) AS p1 FROM sigs a, sigs b WHERE a.vec_id = 1 AND b.vec_id = 4)"


@query(f"WITH {SIGS} SELECT vec_id, (bit_count(xor(w0, p0)) + bit_count(xor(w1, p1)))::BIGINT AS distance FROM sigs, {SEQ} ORDER BY distance, vec_id LIMIT 7")
def extrapolate(spark, sf_dir):
    """The rows nearest to where the sequence of vec_id 1 to 4 leads."""
    rows = signed(spark, sf_dir)
    at = {r["vec_id"]: r["words"] for r in rows.where("vec_id between 1 and 4").select("vec_id", "words").collect()}
    wanted = search.extrapolated([F.lit(at[i]) for i in range(1, 5)])
    return search.top_k(rows, fp.hamming(F.col("words"), wanted), "vec_id", 7).select("vec_id", "distance")


@query(
    f"WITH {PLACES}, {Q('qs', 'n3')}, {Q('qp', 'PART_OF')}, {Q('qo', 'n5')} SELECT 'x' AS axis, id FROM (SELECT id FROM rec, qs WHERE {H8('x', 'w')} <= 8 ORDER BY id LIMIT 4) UNION ALL SELECT 'y', id FROM (SELECT id FROM rec, qp WHERE {H8('y', 'w')} <= 8 ORDER BY id LIMIT 4)"
    f" UNION ALL SELECT 'z', id FROM (SELECT id FROM rec, qo WHERE {H8('z', 'w')} <= 8 ORDER BY id LIMIT 4)"
)
def triple_fan_out(spark, sf_dir):
    store = places(spark, sf_dir)
    asked = (("x", "n3"), ("y", "PART_OF"), ("z", "n5"))
    return functools.reduce(lambda a, b: a.union(b), (search.fan_out(store, axis, words8(F.lit(text)), 8, 4).select(F.lit(axis).alias("axis"), "id") for axis, text in asked))


HYBRID = 'HYBRID {"similar": 1, "least": 0.45, "label": "build", "range": ["c_acctbal", 0, 8000], "offset": 1, "limit": 6, "version": 4}'


@query(
    f"WITH {PAIRED_SQL} SELECT id, round(1 - {H('words', 'q')} / {WIDTH}.0::DOUBLE, 6) AS score, 4::BIGINT AS version FROM p WHERE c_mktsegment ILIKE '%build%' AND c_acctbal BETWEEN 0 AND 8000 AND 1 - {H('words', 'q')} / {WIDTH}.0::DOUBLE >= 0.45"
    " ORDER BY score DESC, id LIMIT 6 OFFSET 1"
)
def hybrid_command(spark, sf_dir):
    rows, _ = lead(spark, sf_dir)
    of = lambda key: F.lit(rows.where(F.col("id") == key).head()["words"])
    return hybrid.run(rows, HYBRID, "id", "words", "c_mktsegment", of, WIDTH).select("id", F.round("score", 6).alias("score"), "version")


# ---- stages
PART = lambda n: f"list_sum([bit_count(xor(words[i], q[i])) for i in range(1, {n + 1})])"
SHARE = 5400 / WIDTH
LIMITS = [(16, 16, 3.0), (64, 4, 2.0)]
STAGES = " AND ".join(f"{PART(n)} * {p} <= {5400 + m * p * (n * 64 * SHARE * (1 - SHARE)) ** 0.5!r}" for n, p, m in LIMITS)


@query(f"WITH {PAIRED_SQL} SELECT id, {H('words', 'q')} AS distance FROM p WHERE {STAGES} AND {H('words', 'q')} <= 5400")
def sampling_cascade(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    return search.sampling_cascade(rows, "words", q, 5400, 256).select("id", "distance")


@query(
    f"WITH {PAIRED_SQL} SELECT id, {H('words', 'q')} AS distance FROM p WHERE len([1 for i in range(1, 257) if words[i] <> q[i]]) <= 256"
    f" AND list_sum([least(bit_count(xor(words[i], q[i])), 15) for i in range(1, 257)]) <= 2500 AND {H('words', 'q')} <= 5600 ORDER BY distance, id LIMIT 9"
)
def capped_cascade(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    return search.capped_cascade(rows, "words", q, "id", 256, 2500, 5600, 9).select("id", "distance")


@query(NEAR_SQL + f"SELECT id, distance, round(1 - distance / {WIDTH}.0::DOUBLE, 6) AS similarity, round(CASE WHEN distance < 5200 THEN 1 - distance / 5200.0::DOUBLE WHEN distance < 8200 THEN -0.5 * (1 - (distance - 5200) / 3000.0::DOUBLE) ELSE 0 END, 6) AS response FROM near")
def combined_result(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    out = search.combined(rows, "words", q, WIDTH, 5200, 8200)
    return out.select("id", "distance", F.round("similarity", 6).alias("similarity"), F.round("response", 6).alias("response"))


@query(
    "WITH s AS (SELECT vec_id, label, (vec_id * 7919) & ((1::BIGINT << 60) - 1) AS k, list_reduce([(1::BIGINT << ((vec_id + j) * 7 % 60)) | (1::BIGINT << ((vec_id + j) * 13 % 60)) for j in range(1, 4)], lambda a, b: a | b) AS bloom FROM embeddings)"
    " SELECT vec_id FROM s WHERE label >= 3 AND vec_id % 4 = 1 AND (bloom & ((1::BIGINT << (100 * 7 % 60)) | (1::BIGINT << (100 * 13 % 60)))) = ((1::BIGINT << (100 * 7 % 60)) | (1::BIGINT << (100 * 13 % 60)))"
)
def schema_predicate(spark, sf_dir):
    """Level, kind, and a Bloom filter of three neighbours that may hold 100."""
    near = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.col("vec_id") + j)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("level"), (F.col("vec_id") % 4).alias("kind"), search.bloom_of(near).alias("bloom"))
    return search.schema_filter(rows, "level", "kind", "bloom", 3, 1, 100).select("vec_id")


# ---- validation
T = "(0.3989423 * exp(-z * z / 2.0) * (t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))))"


@query(
    NEAR_SQL + f", s AS (SELECT id, 1 - distance / {WIDTH}.0::DOUBLE AS sim, row_number() OVER (ORDER BY distance, id) AS fwd FROM near WHERE id <> 1), m AS (SELECT avg(sim) AS mean, stddev_samp(sim) AS sd, count(*) AS n FROM s),"
    " b AS (SELECT s.*, m.*, fwd + id % 3 AS back, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS agreement, (sim - mean) / sd AS z FROM s, m), e AS (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t, 2 * 1.96 * sd / sqrt(n) AS gap FROM b),"
    f" c AS (SELECT *, least(2 * {T}, 1.0) AS p FROM e), f AS (SELECT *, (p < 0.05)::INT + (abs(z) >= 0.2)::INT + (fwd <= 10 AND back <= 10)::INT + (least(fwd, back) / greatest(fwd, back)::DOUBLE >= 0.2)::INT + (agreement > 0.7)::INT + (gap < 0.2)::INT + (back <= 30)::INT AS passed,"
    " ((1 - p) + least(abs(z), 2) / 2 + 1.0 / greatest(fwd, back) + least(fwd, back) / greatest(fwd, back)::DOUBLE + agreement + (1 - least(gap, 1)) + CASE WHEN back > 30 THEN 0.5 ELSE 1 END) / 7 AS score FROM c)"
    " SELECT id, round(z, 5) AS z, round(p, 5) AS p, passed::INT AS passed, round(score, 5) AS score, CASE WHEN passed = 7 THEN 'accept' WHEN passed >= 5 THEN 'accept with caution' WHEN passed >= 3 THEN 'review' ELSE 'reject' END AS verdict FROM f"
)
def validated_matches(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    rows = rows.where("id <> 1").select("id", fp.similarity(F.col("words"), q, WIDTH).alias("sim"))
    rows = rows.withColumn("fwd", F.row_number().over(Window.orderBy(F.desc("sim"), "id")))  # ranks of one query's results
    held = rows.agg(F.avg("sim").alias("mean"), F.stddev_samp("sim").alias("sd"), F.count("*").alias("n"))  # one row
    rows = rows.crossJoin(F.broadcast(held)).withColumn("back", F.col("fwd") + F.col("id") % 3).withColumn("agreement", F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.6))
    out = stats.validated(rows, "sim", "mean", "sd", "n", "fwd", "back", 10, "agreement")
    return out.select("id", F.round("z", 5).alias("z"), F.round("p", 5).alias("p"), "passed", F.round("score", 5).alias("score"), "verdict")


@query(
    "WITH x AS (SELECT user_id, avg(value) AS signal, stddev_samp(value) / sqrt(count(*)) AS error, count(*) AS n FROM events GROUP BY user_id), e AS (SELECT *, signal / 50 AS effect, CASE WHEN error > 0 THEN signal / error ELSE 10.0 END AS z FROM x)"
    f", f AS (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t FROM e) SELECT user_id, abs(effect) > 0.2 AND signal > 0 AND signal - 1.96 * error > 0 AND {T} < 0.01 AND n >= 20 AS certified FROM f WHERE n > 1"
)
def certificates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("signal"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("error"), F.count("*").alias("n"))
    return rows.where("n > 1").select("user_id", stats.certified(F.col("signal") / 50, F.col("signal"), F.col("error"), F.col("n"), 20).alias("certified"))


CHALLENGED = (
    f"WITH {TRUTHS}, e AS (SELECT source, f, c, c * (f - 0.5) + 0.5 AS x, 1 - abs(2 * f - 1) AS amb FROM t), k AS ("
    " SELECT source, 'negation' AS kind, x > c * (0.5 - f) + 0.5 AS survives, c * (0.5 - f) + 0.5 AS strength FROM e UNION ALL SELECT source, 'substitution', c > 0.5, 1 - c FROM e"
    " UNION ALL SELECT source, 'dependency', c * 0.5 * (f - 0.5) + 0.5 > 0.5, abs(x - (c * 0.5 * (f - 0.5) + 0.5)) FROM e UNION ALL SELECT source, 'weather', f * c > f * (1 - c), f * (1 - c) FROM e"
    " UNION ALL SELECT source, 'comfort', amb * c < 0.3, amb * c FROM e)"
)


@query(CHALLENGED + " SELECT source, kind, survives, round(strength, 6) AS strength FROM k")
def belief_challenges(spark, sf_dir):
    rows = truths(spark, sf_dir).select("source", F.explode(truth.challenges(F.col("t"))).alias("x"))
    return rows.select("source", "x.kind", "x.survives", F.round("x.strength", 6).alias("strength"))


@query(CHALLENGED + " SELECT source, count(*) FILTER (WHERE survives) >= 4 AS robust, round(CASE WHEN sum(strength) > 0 THEN sum(CASE WHEN survives THEN strength ELSE 0 END) / sum(strength) ELSE 1 END, 6) AS score FROM k GROUP BY source")
def belief_robustness(spark, sf_dir):
    return truths(spark, sf_dir).select("source", truth.robust(F.col("t")).alias("robust"), F.round(truth.robustness(F.col("t")), 6).alias("score"))


# ---- spectra, phases, encodings
ROOTS = ", ".join(f"sqrt(list_avg([(x - list_avg(s{b})) ** 2 for x in s{b}])) / {64 * b}.0 AS v{b}" for b in (1, 4, 16, 64))
SUMS = ", ".join(f"[list_sum(pops[b * {b_} + 1 : b * {b_} + {b_}]) for b in range(0, {256 // b_})] AS s{b_}" for b_ in (1, 4, 16, 64))
SPECTRA = (
    f"WITH {KIN_SQL}, a AS (SELECT id, words, [bit_count(x)::DOUBLE for x in words] AS pops, list_sum([bit_count(xor(x, x >> 1)) for x in words]) + list_sum([xor(words[i] >> 63, words[i + 1] & 1)::BIGINT for i in range(1, 256)]) AS turns FROM kin),"
    f" b AS (SELECT *, list_sum(pops) AS n, {SUMS} FROM a), v AS (SELECT *, {ROOTS} FROM b),"
    " p AS (SELECT id, i * 64 + j AS pos FROM (SELECT id, words, unnest(range(0, 256)) AS i FROM kin), range(0, 64) r(j) WHERE ((words[i + 1] >> j) & 1) = 1), g AS (SELECT id, pos - lag(pos) OVER (PARTITION BY id ORDER BY pos) AS gap FROM p),"
    " c AS (SELECT id, var_pop(gap) AS spread FROM g WHERE gap IS NOT NULL GROUP BY id)"
)


@query(
    SPECTRA + " SELECT id, round(list_sum([CASE WHEN x > 0 THEN -(x / n) * ln(x / n) ELSE 0 END for x in pops]) / ln(256.0), 5) AS entropy, round(n / 16384.0, 6) AS density, round((v1 + 2 * v4 + 3 * v16 + 4 * v64) / 10, 6) AS depth,"
    " round(sqrt(list_sum([x * x for x in pops]) / (256 * 4096.0)), 6) AS energy, round(list_sum([pops[i] * pops[257 - i] for i in range(1, 129)]) / sqrt(list_sum([pops[i] ** 2 for i in range(1, 129)]) * list_sum([pops[257 - i] ** 2 for i in range(1, 129)])), 6) AS symmetry,"
    " round(turns / 16383.0, 6) AS complexity, round(least(sqrt(spread / ((16384.0 / n) ** 2 + 1)), 1), 6) AS clustering,"
    " CASE WHEN (v1 + 2 * v4 + 3 * v16 + 4 * v64) / 10 < 0.05 THEN 0 WHEN (v1 + 2 * v4 + 3 * v16 + 4 * v64) / 10 < 0.1 THEN 1 ELSE 2 END AS rung FROM v JOIN c USING (id)"
)
def spectral_features(spark, sf_dir):
    rows = kin(spark, sf_dir).withColumn("s", spectral.features(F.col("words"), 256))
    return rows.select(
        "id", F.round("s.counts.entropy", 5).alias("entropy"), *(F.round(f"s.counts.{c}", 6).alias(c) for c in ("density", "depth", "energy", "symmetry")),
        F.round("s.complexity", 6).alias("complexity"), F.round("s.clustering", 6).alias("clustering"), spectral.rung(F.col("s.counts.depth")).alias("rung"),
    )


@query(
    "WITH p AS (SELECT vec_id, [x::DOUBLE - floor(x::DOUBLE) for x in embedding[1:16]] AS a, [x::DOUBLE - floor(x::DOUBLE) for x in embedding[17:32]] AS b FROM embeddings), s AS (SELECT *, list_sort(a) AS sa, list_sort(b) AS sb,"
    " atan2(list_sum([sin(x * 6.283185307179586) for x in a]), list_sum([cos(x * 6.283185307179586) for x in a])) AS da, atan2(list_sum([sin(x * 6.283185307179586) for x in b]), list_sum([cos(x * 6.283185307179586) for x in b])) AS db FROM p)"
    " SELECT vec_id, round(list_sum([abs(sa[i] - sb[i]) for i in range(1, 17)]) / 16, 6) AS wasserstein, round(list_sum([least(abs(a[i] - b[i]), 1 - abs(a[i] - b[i])) for i in range(1, 17)]) / 16, 6) AS circular,"
    " round(list_sum([abs(len([1 for x in a if least(floor(x * 16), 15) = v]) - len([1 for x in b if least(floor(x * 16), 15) = v])) for v in range(0, 16)]) / 32.0, 6) AS histogram,"
    " round(least(abs(da - db), 6.283185307179586 - abs(da - db)) / 3.141592653589793, 5) AS carrier FROM s"
)
def phase_distances(spark, sf_dir):
    phases = lambda first: F.transform(F.slice(F.col("embedding").cast("array<double>"), first, 16), lambda x: x - F.floor(x))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", phases(1).alias("a"), phases(17).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "vec_id", F.round(spectral.wasserstein(a, b), 6).alias("wasserstein"), F.round(spectral.circular(a, b), 6).alias("circular"),
        F.round(spectral.phase_histogram(a, b), 6).alias("histogram"), F.round(spectral.carrier(a, b), 5).alias("carrier"),
    )


BASIS = lambda name, n: f"(SELECT count(*) FILTER (WHERE ('0x' || substr(md5('{name}:' || i), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 < {{0}}) FROM range(0, {n}) r(i))"


@query(
    f"WITH s AS (SELECT s_suppkey, s_acctbal / 10000 AS tau, (s_suppkey % 10) / 10.0::DOUBLE AS sigma FROM supplier), b AS (SELECT i, ('0x' || substr(md5('tau:' || i), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 AS t, ('0x' || substr(md5('sigma:' || i), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 AS g FROM range(0, 3333) r(i))"
    " SELECT s_suppkey, round(2 * count(*) FILTER (WHERE t < tau) / 3333.0 - 1, 6) AS tau, round(count(*) FILTER (WHERE g < sigma * 2 - 1) / 3333.0, 6) AS sigma FROM s, b GROUP BY s_suppkey"
)
def membrane(spark, sf_dir):
    """Two numbers and a text to a signature and the numbers back."""
    # the file is small, the work is not
    spread = table(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    rows = spread.select("s_suppkey", spectral.encode(F.col("s_acctbal") / 10000, F.col("s_suppkey") % 10 / 10.0, F.col("s_name")).alias("words"))
    out = rows.withColumn("d", spectral.decode(F.col("words")))
    return out.select("s_suppkey", F.round("d.tau", 6).alias("tau"), F.round("d.sigma", 6).alias("sigma"))


@query(
    f"WITH {SIGS}, o AS (SELECT label, w0, w1, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS turn FROM sigs), bits AS (SELECT label, (j + turn) % 64 AS pos, CASE WHEN j < 32 THEN (w0 >> j) & 1 ELSE (w1 >> (j - 32)) & 1 END AS b FROM o, range(0, 64) r(j)),"
    " v AS (SELECT label, pos, count(*) AS n, sum(b) AS s FROM bits GROUP BY ALL) SELECT label, sum(CASE WHEN s * 2 > n AND pos < 32 THEN 1::BIGINT << pos ELSE 0 END)::BIGINT AS w0, sum(CASE WHEN s * 2 > n AND pos >= 32 THEN 1::BIGINT << (pos - 32) ELSE 0 END)::BIGINT AS w1 FROM v GROUP BY label"
)
def sequence_encoding(spark, sf_dir):
    out = fp.sequence(signed(spark, sf_dir), ["label"], ["vec_id"], "words")
    return out.select("label", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


MASK = 0x55555555


@query(
    f"WITH {SIGS}, q AS (SELECT w0 AS q0, w1 AS q1 FROM sigs WHERE vec_id = 0) SELECT vec_id, 0::BIGINT AS back, round(1 - (bit_count(q0) + bit_count(q1)) / 64.0, 6) AS bound, xor(w0, {MASK}) AS h0, xor(w0, 4294967295) & q0 AS projected,"
    " (bit_count(xor(w0, q0)) + bit_count(w1))::BIGINT AS tensor, TRUE AS commutes FROM sigs, q"
)
def state_operators(spark, sf_dir):
    """Operators as objects: a permutation and its adjoint, an expectation, compositions, sums, tensor products."""
    q = F.lit(signed(spark, sf_dir).where("vec_id = 0").head()["words"])
    a = F.col("words")
    turn, key, flip = states.permute(13), states.bind(q), states.negate()
    both = turn.then(key)
    # the second half of a tensor product is left as it is
    tensor = key.tensor(states.identity())
    zero = fp.bind(tensor.apply(a), F.array(F.lit(0).cast("long"), F.lit(0).cast("long")))
    return signed(spark, sf_dir).select(
        "vec_id", fp.hamming(a, both.adjoint().apply(both.apply(a))).alias("back"), F.round(key.expectation(a), 6).alias("bound"), states.hadamard().apply(a)[0].alias("h0"),
        flip.then(states.project(q)).apply(a)[0].alias("projected"), fp.popcount(zero).alias("tensor"), key.commutes(flip, a).alias("commutes"),
    )


@query(f"WITH {SIGS} SELECT label, bit_xor(w0) AS p0, count(*) AS n, TRUE AS recovered FROM sigs GROUP BY label")
def parity_recovery(spark, sf_dir):
    """A group's parity block, and whether its first member comes back from the block and the others."""
    rows = signed(spark, sf_dir)
    parity = fp.combined(rows, ["label"], "words")
    first = rows.groupBy("label").agg(F.min("vec_id").alias("lost"), F.count("*").alias("n"))
    others = fp.combined(rows.join(first, "label").where("vec_id <> lost"), ["label"], "words").withColumnRenamed("words", "rest")
    lost = rows.join(first, "label").where("vec_id = lost").select("label", "n", F.col("words").alias("was"))
    out = parity.join(others, "label", "left").join(lost, "label")
    back = fp.bind(F.col("words"), F.coalesce("rest", F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))))
    return out.select("label", F.col("words")[0].alias("p0"), "n", (back == F.col("was")).alias("recovered"))


@query(f"WITH {SIGS}, w AS (SELECT label, bit_xor(w0) AS w0, bit_xor(w1) AS w1, min(vec_id) AS a, max(vec_id) AS b FROM sigs GROUP BY label) SELECT w.label, (bit_count(xor(x.w0, y.w0)) + bit_count(xor(x.w1, y.w1)))::BIGINT AS changed FROM w JOIN sigs x ON x.vec_id = w.a JOIN sigs y ON y.vec_id = w.b")
def world_intervention(spark, sf_dir):
    """A label's world, the binding of its parts, with its last part in place of its first: how much it changes."""
    rows = signed(spark, sf_dir)
    worlds = fp.combined(rows, ["label"], "words").withColumnRenamed("words", "world")
    ends = rows.groupBy("label").agg(F.min_by("words", "vec_id").alias("old"), F.max_by("words", "vec_id").alias("new"))
    out = worlds.join(ends, "label").withColumn("after", causal.replaced(F.col("world"), F.col("old"), F.col("new")))
    return out.select("label", fp.hamming(F.col("world"), F.col("after")).alias("changed"))


# ---- causes
@query(
    f"WITH {CAUSAL}, i AS (SELECT state, action, outcome, weight * 0.5 AS weight FROM edges) SELECT 'necessity' AS what, round(CASE WHEN bool_or(outcome <> 'F') THEN max(weight) ELSE 0 END, 6) AS value FROM i WHERE state = 'BUILDING' AND action = '5-LOW'"
    " UNION ALL SELECT 'sufficiency', round(CASE WHEN bool_or(outcome = 'F') THEN max(weight) ELSE 0 END, 6) FROM edges WHERE state = 'BUILDING' AND action = '1-URGENT'"
)
def causal_rungs(spark, sf_dir):
    done = causal_edges(spark, sf_dir)
    imagined = done.withColumn("kind", F.lit("imagine")).withColumn("weight", F.col("weight") * 0.5)
    every = done.unionByName(imagined)
    a = causal.necessity(every, "BUILDING", "F", "5-LOW").select(F.lit("necessity").alias("what"), F.round("necessity", 6).alias("value"))
    return a.union(causal.sufficiency(every, "BUILDING", "1-URGENT", "F").select(F.lit("sufficiency"), F.round("sufficiency", 6)))


@query(
    "WITH n AS (SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS target FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), r AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 2)"
    " SELECT node, 1 AS hop FROM r UNION ALL SELECT source, 2 FROM n JOIN r ON n.target = r.node"
)
def causal_ancestors(spark, sf_dir):
    links = edges(spark, sf_dir).where("verb in ('LOCATED_IN', 'PART_OF')").select("source", "target")
    return causal.ancestors(links, "r2", 5)


@query(f"WITH {CAUSAL} SELECT action, outcome, round(weight, 6) AS weight FROM edges WHERE state = 'MACHINERY' ORDER BY weight DESC, action, outcome LIMIT 5")
def correlate(spark, sf_dir):
    seen = causal_edges(spark, sf_dir).withColumn("kind", F.lit("see"))
    return causal.correlated(seen, "MACHINERY", 5).select("action", "outcome", F.round("weight", 6).alias("weight"))


@query(
    "WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS state, 'in' AS action, 'n' || c_nationkey AS outcome, c_acctbal AS weight FROM customer UNION ALL SELECT 'n' || n_nationkey, 'of', 'r' || n_regionkey, n_nationkey * 1.0 FROM nation),"
    " best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY weight DESC, state, action) = 1), t(step, state) AS (SELECT 1, state FROM best WHERE outcome = 'r1' UNION ALL SELECT step + 1, b.state FROM t JOIN best b ON b.outcome = t.state)"
    " SELECT step, state FROM t"
)
def reverse_trace(spark, sf_dir):
    """Backwards from a region, the heaviest cause each time."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.select(F.concat(F.lit("c"), "c_custkey").alias("state"), F.lit("in").alias("action"), F.concat(F.lit("n"), "c_nationkey").alias("outcome"), F.col("c_acctbal").alias("weight"))
    rows = rows.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("of"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("double")))
    steps = causal.trace(rows, "r1", 5)
    return functools.reduce(lambda a, b: a.union(b), (s.select(F.lit(i).alias("step"), "state") for i, s in enumerate(steps, 1)))


@query(
    f"WITH {CAUSAL}, w AS (SELECT DISTINCT state, {L('state')} AS words FROM edges), a AS (SELECT DISTINCT state AS a FROM edges WHERE outcome = 'F'), b AS (SELECT DISTINCT state AS b FROM edges WHERE outcome = 'P')"
    f" SELECT a, b, {H8('x.words', 'y.words')} AS distance FROM a JOIN b ON TRUE JOIN w x ON x.state = a JOIN w y ON y.state = b WHERE {H8('x.words', 'y.words')} <= 20"
)
def confounders_near(spark, sf_dir):
    every = causal_edges(spark, sf_dir)
    named = materialise(every.select("state").distinct().withColumn("words", words8(F.col("state"))), "states")
    return causal.near_confounders(every, named, "F", "P", 20, 256)


@query(
    "WITH o AS (SELECT c_mktsegment AS s, o_orderpriority AS p, o_orderstatus AS y FROM orders JOIN customer ON o_custkey = c_custkey), ps AS (SELECT s, count(*)::DOUBLE / (SELECT count(*) FROM o WHERE p = '5-LOW' AND y = 'O') AS q FROM o WHERE p = '5-LOW' AND y = 'O' GROUP BY s),"
    " py AS (SELECT s, p, y, count(*) / sum(count(*)) OVER (PARTITION BY s, p) AS q FROM o GROUP BY s, p, y) SELECT y, round(sum(ps.q * py.q), 6) AS p FROM ps JOIN py USING (s) WHERE py.p = '1-URGENT' GROUP BY y"
)
def cpt_counterfactual(spark, sf_dir):
    """A low-priority order was open: what would its status have been had it been urgent?"""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_mktsegment").alias("s"), F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("y"))

    def cpt(v, parents):
        rows = o.groupBy(*parents, v).count()
        return rows.select(*parents, v, (F.col("count") / F.sum("count").over(Window.partitionBy(*parents))).alias("p"))

    model = [("s", [], cpt("s", [])), ("pr", ["s"], cpt("pr", ["s"])), ("y", ["s", "pr"], cpt("y", ["s", "pr"]))]
    out = causal.counterfactual(model, {"pr": "5-LOW", "y": "O"}, "pr", "1-URGENT", ["y"])
    return out.select("y", F.round("p", 6).alias("p"))


@query(NEAR_SQL + "SELECT id, CASE WHEN distance <= 2047 THEN 'strong' WHEN distance BETWEEN 2048 AND 4095 THEN 'moderate' WHEN distance BETWEEN 4096 AND 8191 THEN 'weak but stackable' ELSE 'noise' END AS signal FROM near")
def signal_classes(spark, sf_dir):
    """By distance, at a meter's reading that fits each class."""
    rows, q = lead(spark, sf_dir)
    d = fp.hamming(F.col("words"), q)
    mean = F.when(d <= 2047, 1).when(d <= 4095, 3).otherwise(9)
    sd = F.when(d <= 2047, 20).when(d <= 4095, 40).otherwise(50)
    return rows.select("id", response.signal_class(mean, sd, d).alias("signal"))

"""Signature algebra, similarity search and their statistics over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import fp, response, vectors
from tessera.operators import search, stats
from tessera.sources.star import table


def signed(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", "embedding", fp.sign_words(F.col("embedding")).alias("words"))


def lead(spark, sf_dir):
    """The query of single-query searches: the signature of vec_id 0, one row."""
    return signed(spark, sf_dir).where("vec_id = 0").select(F.col("words").alias("q"), F.col("embedding").alias("qe"))


def against(spark, sf_dir):
    rows = signed(spark, sf_dir).where("vec_id <> 0")
    return rows.crossJoin(F.broadcast(lead(spark, sf_dir)))  # one row


W = lambda a: ", ".join(
    f"list_sum([CASE WHEN {a}[i + {32 * w} + 1] > 0 THEN 1::BIGINT << i ELSE 0 END for i in range(0, 32)])::BIGINT AS w{w}" for w in (0, 1)
)
SIGS = f"sigs AS (SELECT vec_id, label, embedding, {W('embedding')} FROM embeddings)"
H = lambda a, b: f"(bit_count(xor({a}.w0, {b}.w0)) + bit_count(xor({a}.w1, {b}.w1)))::BIGINT"
NEAR = f"WITH {SIGS}, near AS (SELECT s.*, {H('s', 'q')} AS distance FROM sigs s, sigs q WHERE q.vec_id = 0 AND s.vec_id <> 0) "


@query(NEAR + "SELECT vec_id, label, distance FROM near ORDER BY distance, vec_id LIMIT 10")
def topk_exact(spark, sf_dir):
    rows = against(spark, sf_dir)
    return search.top_k(rows, fp.hamming(F.col("words"), F.col("q")), "vec_id", 10).select("vec_id", "label", "distance")


@query(f"WITH {SIGS} SELECT vec_id, w0, w1, (bit_count(w0) + bit_count(w1))::BIGINT AS popcnt, round((bit_count(w0) + bit_count(w1)) / 64.0::DOUBLE, 6) AS density FROM sigs")
def fp_popcount(spark, sf_dir):
    w = F.col("words")
    return signed(spark, sf_dir).select(
        "vec_id", w[0].alias("w0"), w[1].alias("w1"), fp.popcount(w).alias("popcnt"), F.round(fp.density(w), 6).alias("density")
    )


@query(NEAR + "SELECT vec_id, distance, round(1.0 - distance / 64.0::DOUBLE, 6) AS similarity FROM near")
def fp_similarity(spark, sf_dir):
    d, s = fp.hamming(F.col("words"), F.col("q")), fp.similarity(F.col("words"), F.col("q"))
    return against(spark, sf_dir).select("vec_id", d.alias("distance"), F.round(s, 6).alias("similarity"))


@query(f"WITH {SIGS} SELECT s.vec_id, xor(s.w0, q.w0) AS b0, xor(s.w1, q.w1) AS b1, 0::BIGINT AS recovery FROM sigs s, sigs q WHERE q.vec_id = 0 AND s.vec_id <> 0")
def fp_bind_roundtrip(spark, sf_dir):
    bound = fp.bind(F.col("words"), F.col("q"))
    back = fp.hamming(fp.bind(bound, F.col("q")), F.col("words"))
    return against(spark, sf_dir).select("vec_id", bound[0].alias("b0"), bound[1].alias("b1"), back.alias("recovery"))


@query(
    NEAR + "SELECT s.vec_id, (bit_count(s.w0 & q.w0) + bit_count(s.w1 & q.w1))::BIGINT AS both_set,"
    " (bit_count(s.w0 | q.w0) + bit_count(s.w1 | q.w1))::BIGINT AS either_set, (64 - bit_count(s.w0) - bit_count(s.w1))::BIGINT AS unset"
    " FROM near s, sigs q WHERE q.vec_id = 0"
)
def fp_boolean(spark, sf_dir):
    w, q = F.col("words"), F.col("q")
    return against(spark, sf_dir).select(
        "vec_id", fp.popcount(fp.both(w, q)).alias("both_set"), fp.popcount(fp.either(w, q)).alias("either_set"),
        fp.popcount(fp.inverted(w)).alias("unset"),
    )


@query(
    f"WITH {SIGS}, first AS (SELECT label, min(vec_id) AS f, count(*) AS n FROM sigs GROUP BY label),"
    " bits AS (SELECT s.label, w, i, sum(((CASE w WHEN 0 THEN w0 ELSE w1 END) >> i) & 1)::BIGINT AS on_bits FROM sigs s, range(0, 32) r(i), range(0, 2) q(w) GROUP BY ALL),"
    " made AS (SELECT b.label, w, sum(CASE WHEN on_bits * 2 > n OR (on_bits * 2 = n AND (((CASE w WHEN 0 THEN s.w0 ELSE s.w1 END) >> i) & 1) = 1) THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS word"
    " FROM bits b JOIN first USING (label) JOIN sigs s ON s.vec_id = f GROUP BY b.label, w)"
    " SELECT label, max(word) FILTER (WHERE w = 0) AS w0, max(word) FILTER (WHERE w = 1) AS w1 FROM made GROUP BY label"
)
def fp_bundle_by_label(spark, sf_dir):
    out = fp.bundle(signed(spark, sf_dir), ["label"], "words", order="vec_id")
    return out.select("label", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


@query(
    f"WITH {SIGS} SELECT vec_id, ((w0 << 5) | (w1 >> 27)) & 4294967295 AS p0, ((w1 << 5) | (w0 >> 27)) & 4294967295 AS p1, 0::BIGINT AS recovery FROM sigs"
)
def fp_permute_words(spark, sf_dir):
    p = fp.permute(F.col("words"), 5)
    rows = signed(spark, sf_dir).withColumn("p", p)
    back = fp.hamming(fp.permute(F.col("p"), -5), F.col("words"))
    return rows.select("vec_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), back.alias("recovery"))


@query(f"WITH {SIGS} SELECT vec_id, xor(w0, w1) AS folded FROM sigs")
def fp_xor_fold(spark, sf_dir):
    return signed(spark, sf_dir).select("vec_id", fp.fold(F.col("words"))[0].alias("folded"))


@query(
    f"WITH {SIGS}, bytes AS (SELECT vec_id, i, ((CASE WHEN i < 4 THEN w0 ELSE w1 END) >> (8 * (i % 4))) & 255 AS b FROM sigs, range(0, 8) r(i)),"
    " scents AS (SELECT vec_id, bit_xor((b << (8 * (i % 5)))::BIGINT) AS scent FROM bytes GROUP BY vec_id)"
    " SELECT s.vec_id, s.scent, bit_count(xor(s.scent, q.scent))::BIGINT AS distance FROM scents s, scents q WHERE q.vec_id = 0"
)
def fp_scent(spark, sf_dir):
    rows = signed(spark, sf_dir).select("vec_id", fp.scent(F.col("words")).alias("scent"))
    one = rows.where("vec_id = 0").select(F.col("scent").alias("q"))
    return rows.crossJoin(F.broadcast(one)).select("vec_id", "scent", fp.scent_distance(F.col("scent"), F.col("q")).alias("distance"))


@query(NEAR + "SELECT s.vec_id, bit_count(xor(s.w1, q.w1))::BIGINT AS upper_distance FROM near s, sigs q WHERE q.vec_id = 0")
def fp_masked_distance(spark, sf_dir):
    return against(spark, sf_dir).select("vec_id", fp.masked_hamming(F.col("words"), F.col("q"), 1, 1).alias("upper_distance"))


@query(f"WITH {SIGS} SELECT label, bit_xor(w0) AS w0, bit_xor(w1) AS w1 FROM sigs GROUP BY label")
def store_hash(spark, sf_dir):
    out = fp.combined(signed(spark, sf_dir), ["label"], "words")
    return out.select("label", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


@query(
    f"WITH {SIGS}, firsts AS (SELECT label, min(vec_id) AS q FROM sigs GROUP BY label),"
    f" pairs AS (SELECT f.label, s.vec_id, {H('s', 'q')} AS distance FROM firsts f JOIN sigs q ON q.vec_id = f.q, sigs s WHERE s.vec_id <> f.q)"
    " SELECT label, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 5"
)
def topk_batch(spark, sf_dir):
    rows = signed(spark, sf_dir)
    firsts = rows.groupBy("label").agg(F.min_by("words", "vec_id").alias("q"), F.min("vec_id").alias("q_id"))
    pairs = rows.drop("label", "embedding").crossJoin(firsts).where("vec_id <> q_id").withColumn("distance", fp.hamming(F.col("words"), F.col("q")))
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("distance", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("label", "vec_id", "distance", "rank")


@query(NEAR + "SELECT vec_id, distance FROM near WHERE 1.0 - distance / 64.0 >= 0.55")
def threshold_search(spark, sf_dir):
    d = fp.hamming(F.col("words"), F.col("q"))
    return against(spark, sf_dir).withColumn("distance", d).where(fp.similarity(F.col("words"), F.col("q")) >= 0.55).select("vec_id", "distance")


@query(NEAR + "SELECT vec_id, distance FROM near WHERE distance <= 26")
def popcount_bound(spark, sf_dir):
    rows = against(spark, sf_dir).withColumn("pops", fp.popcount(F.col("words")))
    return search.within(rows, "words", F.col("q"), 26, "pops").select("vec_id", "distance")


@query(f"WITH {SIGS} SELECT a.vec_id AS a, b.vec_id AS b, {H('a', 'b')} AS distance FROM sigs a JOIN sigs b ON a.vec_id < b.vec_id WHERE {H('a', 'b')} <= 13")
def similarity_join(spark, sf_dir):
    return search.similarity_join(signed(spark, sf_dir), "vec_id", "words", 13)


HAT = "CASE WHEN distance < 28 THEN 1.0 - distance / 28.0::DOUBLE WHEN distance < 40 THEN -0.5 * (1.0 - (distance - 28) / 12.0::DOUBLE) ELSE 0.0 END"


@query(NEAR + f"SELECT vec_id, round({HAT}, 6) AS response FROM near")
def mexican_hat(spark, sf_dir):
    return against(spark, sf_dir).select("vec_id", F.round(response.mexican_hat(fp.hamming(F.col("words"), F.col("q")), 28, 40), 6).alias("response"))


@query(NEAR + f"SELECT vec_id, round({HAT}, 6) AS response FROM near WHERE distance < 28 ORDER BY {HAT} DESC, vec_id LIMIT 10")
def hat_search(spark, sf_dir):
    out = search.hat_search(against(spark, sf_dir), "words", F.col("q"), "vec_id", 10, 28, 40)
    return out.select("vec_id", F.round("response", 6).alias("response"))


STATS = ", st AS (SELECT avg(distance) AS m, stddev_samp(distance) AS s FROM near) "


@query(
    NEAR + STATS + "SELECT vec_id, CASE WHEN distance < greatest(m - 0.6745 * s, 0) THEN 1.0 WHEN distance < m + 0.6745 * s THEN 0.5 WHEN distance < m + 1.6449 * s THEN 0.0"
    " WHEN distance < m + 2.3263 * s THEN -0.5 ELSE -1.0 END::DOUBLE AS response, round((distance - m) / s, 6) AS z,"
    " round((1.0 - ((distance - 32) / 8.0::DOUBLE) ** 2) * exp(0.0 - ((distance - 32) / 8.0::DOUBLE) ** 2 / 2.0), 6) AS wavelet FROM near, st"
)
def percentile_hat(spark, sf_dir):
    rows = against(spark, sf_dir).select("vec_id", fp.hamming(F.col("words"), F.col("q")).alias("distance"))
    st = stats.distribution(rows, [], "distance").select("mean", "sd")
    m, s, d = F.col("mean"), F.col("sd"), F.col("distance")
    return rows.crossJoin(F.broadcast(st)).select(  # one row
        "vec_id", response.percentile_hat(d, m, s).alias("response"), F.round(response.z_score(d, m, s), 6).alias("z"),
        F.round(response.wavelet(d, 32.0, 8.0), 6).alias("wavelet"),
    )


@query(
    f"WITH {SIGS}, pairs AS (SELECT a.label, {H('a', 'b')} AS d FROM sigs a JOIN sigs b ON a.label = b.label AND a.vec_id < b.vec_id),"
    " st AS (SELECT label, count(*) AS n, avg(d) AS m, coalesce(stddev_samp(d), 0) AS s FROM pairs GROUP BY label)"
    " SELECT label, n, round(m, 6) AS mean, round(s, 6) AS sd, round(greatest(m - 0.6745 * s, 0), 6) AS p25, round(m + 0.6745 * s, 6) AS p75, round(m + 1.6449 * s, 6) AS p95, round(m + 2.3263 * s, 6) AS p99 FROM st"
)
def distance_distribution(spark, sf_dir):
    out = stats.pair_distances(signed(spark, sf_dir), "label", "words", 2)
    out = out.withColumns(response.percentiles(F.col("mean"), F.col("sd")))
    return out.select("label", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "p25", "p75", "p95", "p99")))


def label_pairs(spark, sf_dir, blocks=8):
    """Distances of all pairs of a label, whose whole distribution is asked for: a label's rows are dealt to blocks, and each
    pair of blocks is a group of its own, so that no label is one task."""
    rows = signed(spark, sf_dir).select("label", "vec_id", "words", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("own"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = rows.withColumn("other", every).where("own <= other").select("label", F.col("own").alias("i"), F.col("other").alias("j"), F.col("vec_id").alias("va"), F.col("words").alias("wa"))
    b = rows.withColumn("other", every).where("other <= own").select("label", F.col("other").alias("i"), F.col("own").alias("j"), F.col("vec_id").alias("vb"), F.col("words").alias("wb"))
    pairs = a.join(b, ["label", "i", "j"]).where("i < j or va < vb")
    return pairs.select("label", fp.hamming(F.col("wa"), F.col("wb")).alias("d"))


@query(
    f"WITH {SIGS}, pairs AS (SELECT a.label, {H('a', 'b')} AS d FROM sigs a JOIN sigs b ON a.label = b.label AND a.vec_id < b.vec_id),"
    " bins AS (SELECT label, least(floor(d / 4.0), 15) AS bin, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL)"
    " SELECT label, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM bins GROUP BY label"
)
def histogram_entropy(spark, sf_dir):
    out = stats.entropy(stats.histogram(label_pairs(spark, sf_dir), ["label"], "d", 64.0), ["label"])
    return out.select("label", F.round("entropy", 6).alias("entropy"))


@query(
    f"WITH {SIGS}, pairs AS (SELECT a.label, {H('a', 'b')} AS d FROM sigs a JOIN sigs b ON a.label = b.label AND a.vec_id < b.vec_id),"
    " st AS (SELECT label, avg(d) AS m, stddev_samp(d) AS s FROM pairs GROUP BY label)"
    " SELECT a.label AS a, b.label AS b, round(abs(a.m - b.m) / sqrt((a.s * a.s + b.s * b.s) / 2.0), 6) AS cohens_d FROM st a JOIN st b ON a.label < b.label"
)
def cohens_d(spark, sf_dir):
    st = stats.pair_distances(signed(spark, sf_dir), "label", "words", 2).select("label", "mean", "sd")
    a, b = (st.withColumnsRenamed({"label": x, "mean": f"m{x}", "sd": f"s{x}"}) for x in "ab")
    d = response.cohens_d(F.col("ma"), F.col("sa"), F.col("mb"), F.col("sb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(d, 6).alias("cohens_d"))


def dot_sql(a, b):
    return f"list_sum([{a}[i]::DOUBLE * {b}[i]::DOUBLE for i in range(1, 65)])"


VECTORS = "WITH pairs AS (SELECT s.vec_id, s.embedding AS x, q.embedding AS y FROM embeddings s, embeddings q WHERE q.vec_id = 0 AND s.vec_id <> 0) "


@query(
    VECTORS + f"SELECT vec_id, round(1.0 - {dot_sql('x', 'y')} / (sqrt({dot_sql('x', 'x')}) * sqrt({dot_sql('y', 'y')})), 6) AS distance FROM pairs"
    f" ORDER BY 1.0 - {dot_sql('x', 'y')} / (sqrt({dot_sql('x', 'x')}) * sqrt({dot_sql('y', 'y')})), vec_id LIMIT 10"
)
def cosine_topk(spark, sf_dir):
    out = search.vector_top_k(against(spark, sf_dir), "embedding", F.col("qe"), "vec_id", 10)
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    VECTORS + "SELECT vec_id, round(sqrt(list_sum([(x[i]::DOUBLE - y[i]::DOUBLE) ** 2 for i in range(1, 65)])), 6) AS distance FROM pairs"
    " ORDER BY sqrt(list_sum([(x[i]::DOUBLE - y[i]::DOUBLE) ** 2 for i in range(1, 65)])), vec_id LIMIT 10"
)
def l2_topk(spark, sf_dir):
    out = search.vector_top_k(against(spark, sf_dir), "embedding", F.col("qe"), "vec_id", 10, "l2")
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    f"WITH {SIGS}, trio AS (SELECT bit_xor(w0) AS w0, bit_xor(w1) AS w1 FROM sigs WHERE vec_id IN (1, 2, 3))"
    f" SELECT s.vec_id, {H('s', 't')} AS distance FROM sigs s, trio t ORDER BY distance, vec_id LIMIT 5"
)
def analogy(spark, sf_dir):
    rows = signed(spark, sf_dir)
    trio = fp.combined(rows.where("vec_id in (1, 2, 3)"), [], "words").select(F.col("words").alias("t"))
    rows = rows.crossJoin(F.broadcast(trio))  # one row
    return search.top_k(rows, fp.hamming(F.col("words"), F.col("t")), "vec_id", 5).select("vec_id", "distance")


@query(
    f"WITH {SIGS}, codes AS (SELECT label AS code, w0, w1 FROM sigs s JOIN (SELECT min(vec_id) AS vec_id FROM sigs GROUP BY label) USING (vec_id)),"
    f" best AS (SELECT s.vec_id, c.code, 1.0 - {H('s', 'c')} / 64.0::DOUBLE AS similarity FROM sigs s, codes c)"
    " SELECT vec_id, code, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, code) AS r FROM best) WHERE r = 1 AND similarity >= 0.5"
)
def cleanup_codebook(spark, sf_dir):
    rows = signed(spark, sf_dir)
    codes = rows.groupBy(F.col("label").alias("code")).agg(F.min_by("words", "vec_id").alias("code_words"))
    out = search.cleanup(rows.select("vec_id", "words"), "words", codes, "code", "code_words", "vec_id")
    return out.select("vec_id", "code", F.round("similarity", 6).alias("similarity"))


@query(
    NEAR + f"SELECT vec_id, round(0.6 * (1.0 - distance / 64.0::DOUBLE) + 0.4 * {dot_sql('s.embedding', 'q.embedding')} / (sqrt({dot_sql('s.embedding', 's.embedding')}) * sqrt({dot_sql('q.embedding', 'q.embedding')})), 6) AS score"
    " FROM near s, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label BETWEEN 2 AND 7 ORDER BY score DESC, vec_id LIMIT 10 OFFSET 5"
)
def hybrid_search(spark, sf_dir):
    rows = against(spark, sf_dir)
    score = F.round(0.6 * fp.similarity(F.col("words"), F.col("q")) + 0.4 * vectors.cosine(F.col("embedding"), F.col("qe")), 6)
    return search.hybrid(rows, score, "vec_id", between=("label", 2, 7), offset=5, limit=10).select("vec_id", "score")


@query(
    NEAR + ", ring AS (SELECT xor(s.w0, q.w0) AS w0, xor(s.w1, q.w1) AS w1 FROM near s, sigs q WHERE q.vec_id = 0 AND distance BETWEEN 25 AND 31),"
    " bits AS (SELECT w, i, sum(((CASE w WHEN 0 THEN w0 ELSE w1 END) >> i) & 1)::BIGINT AS on_bits, count(*) AS n FROM ring, range(0, 32) r(i), range(0, 2) x(w) GROUP BY ALL),"
    " moved AS (SELECT w, sum(CASE WHEN on_bits * 2 > n THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS m, max(n) AS n FROM bits GROUP BY w)"
    " SELECT xor(q.w0, (SELECT m FROM moved WHERE w = 0)) AS w0, xor(q.w1, (SELECT m FROM moved WHERE w = 1)) AS w1, (SELECT max(n) FROM moved) AS n FROM sigs q WHERE vec_id = 0"
)
def deep_field(spark, sf_dir):
    one = lead(spark, sf_dir).select("q")
    ring = against(spark, sf_dir).where(fp.hamming(F.col("words"), F.col("q")).between(25, 31))
    moves = fp.bundle(ring.select(fp.bind(F.col("words"), F.col("q")).alias("words")), [], "words")
    out = moves.where("n >= 3").crossJoin(F.broadcast(one)).select(fp.bind(F.col("words"), F.col("q")).alias("w"), "n")
    return out.select(F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"), "n")


@query(
    NEAR + STATS + ", z AS (SELECT vec_id, distance, (distance - m) / s AS z, m, s FROM near, st), t AS (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t FROM z)"
    " SELECT vec_id, round(2.0 * 0.3989423 * exp(-z * z / 2.0) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274)))), 6) AS p_value,"
    " round(greatest(distance - 0.004 * s, 0) / 64.0, 6) AS loss, round(distance / m, 6) AS ratio, abs(z) > 2.0 AS significant FROM t"
)
def zscore_pvalue(spark, sf_dir):
    rows = against(spark, sf_dir).select("vec_id", fp.hamming(F.col("words"), F.col("q")).alias("distance"))
    rows = rows.crossJoin(F.broadcast(stats.distribution(rows, [], "distance").select("mean", "sd")))  # one row
    d, m, s = F.col("distance"), F.col("mean"), F.col("sd")
    found = response.drift(d, m, s, 64.0)
    return rows.withColumn("x", found).select(
        "vec_id", F.round(response.p_value(response.z_score(d, m, s)), 6).alias("p_value"), F.round("x.loss", 6).alias("loss"),
        F.round("x.ratio", 6).alias("ratio"), F.col("x.significant").alias("significant"),
    )


@query(
    f"WITH {SIGS}, lags AS (SELECT unnest([1, 2, 3, 5, 8]) AS lag) SELECT lag, round(avg({H('a', 'b')}), 6) AS distance FROM lags, sigs a, sigs b WHERE b.vec_id = a.vec_id + lag GROUP BY lag"
)
def autocorrelation(spark, sf_dir):
    out = stats.autocorrelation(signed(spark, sf_dir).select(F.col("vec_id").alias("t"), "words"), "t", "words", [1, 2, 3, 5, 8])
    return out.select("lag", F.round("distance", 6).alias("distance"))


@query(
    f"WITH {SIGS}, s AS (SELECT vec_id AS t, w0, w1, xor(w0, 65535) AS a0, w1 AS a1 FROM sigs), lags AS (SELECT unnest([1, 2, 3]) AS lag),"
    " p AS (SELECT lag, (bit_count(xor(x.a0, y.w0)) + bit_count(xor(x.a1, y.w1)))::DOUBLE AS c, (bit_count(xor(x.w0, y.w0)) + bit_count(xor(x.w1, y.w1)))::DOUBLE AS u FROM lags, s x, s y WHERE y.t = x.t + lag),"
    " g AS (SELECT lag, count(*) AS n, avg(u) - avg(c) AS signal, sqrt((var_samp(c) + var_samp(u)) / 2) AS pooled FROM p GROUP BY lag)"
    " SELECT lag, n, round(signal, 6) AS signal, round(signal / pooled, 6) AS effect, round(pooled / sqrt(n), 6) AS error FROM g"
)
def lag_effect(spark, sf_dir):
    b = F.col("words")
    a = F.array(b[0].bitwiseXOR(F.lit(65535).cast("long")), b[1])
    series = signed(spark, sf_dir).select(F.col("vec_id").alias("t"), a.alias("a"), b.alias("b"))
    out = stats.lag_effect(series, "t", "a", "b", [1, 2, 3])
    return out.select("lag", "n", *(F.round(c, 6).alias(c) for c in ("signal", "effect", "error")))


@query(f"WITH {SIGS} SELECT s.vec_id, {H('s', 'q')} AS distance FROM sigs s, sigs q WHERE q.vec_id = 0 AND {H('s', 'q')} < 27")
def sql_functions(spark, sf_dir):
    """SQL text with the registered functions."""
    fp.register(spark)
    signed(spark, sf_dir).createOrReplaceTempView("signed")
    return spark.sql("SELECT s.vec_id, hamming(s.words, q.words) AS distance FROM signed s, signed q WHERE q.vec_id = 0 AND hamming_distance(s.words, q.words) < 27")

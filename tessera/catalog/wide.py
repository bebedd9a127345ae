"""The operation dictionary and searches over signatures of 16,384 bits: 256 words made from the keys of `customer`,
of which customers of a nation share the first 96."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import fp, operations, response
from tessera.operators import search
from tessera.session import materialise
from tessera.sources.star import edges, table

WORDS, BITS, SHARED = 256, 64, 96
WIDTH = WORDS * BITS
OPS = operations.dictionary(WORDS, BITS)


def made(rows, key, group, shared):
    """rows with words: the first ones from the group, the others from the key."""
    part = lambda i: F.when(i < shared, F.concat(F.lit("g"), group.cast("string"))).otherwise(F.concat(F.lit("k"), key.cast("string")))
    word = lambda i: F.conv(F.substring(F.md5(F.concat(part(i), F.lit(":"), i.cast("string"))), 1, 16), 16, -10).cast("long")
    return rows.withColumn("words", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word))


def wide(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("g"), "c_acctbal", "c_mktsegment")
    return materialise(made(rows, F.col("id"), F.col("g"), SHARED), "wide")


def paired(spark, sf_dir):
    """Each row beside the one of id 1."""
    rows = wide(spark, sf_dir)
    first = rows.where("id = 1").select(F.col("words").alias("q"))
    return rows.crossJoin(F.broadcast(first))  # one row


def sql_words(key: str, group: str, shared: int) -> str:
    return f"[('0x' || substr(md5(CASE WHEN i < {shared} THEN 'g' || {group} ELSE 'k' || {key} END || ':' || i), 1, 16))::UBIGINT for i in range(0, {WORDS})]"


def sql_mark(name: str) -> str:
    return f"[('0x' || substr(md5('{name}:' || i), 1, 16))::UBIGINT for i in range(0, {WORDS})]"


X = lambda a, b: f"[xor({a}[i], {b}[i]) for i in range(1, {WORDS + 1})]"
P = lambda a: f"list_sum([bit_count(x) for x in {a}])::BIGINT"
H = lambda a, b: P(X(a, b))
S = lambda a, b: f"(1.0::DOUBLE - {H(a, b)} / {WIDTH}.0::DOUBLE)"
WIDE_SQL = f"wide AS MATERIALIZED (SELECT c_custkey AS id, c_nationkey::BIGINT AS g, c_acctbal, c_mktsegment, {sql_words('c_custkey', 'c_nationkey', SHARED)} AS words FROM customer)"
PAIRED_SQL = f"{WIDE_SQL}, p AS (SELECT w.*, f.words AS q FROM wide w, (SELECT words FROM wide WHERE id = 1) f)"


def marks_sql(names) -> str:
    return "marks AS MATERIALIZED (SELECT " + ", ".join(f"{sql_mark(n)} AS m_{n.lower()}" for n in sorted(set(names))) + ")"


# ---- bindings: the set bits of what each makes
ONES = sorted(operations.MARKS)
TWOS = sorted(operations.BINDS)


def bound_sql(name: str) -> str:
    mark = operations.BINDS[name]
    return P(X("p.words", "p.q")) if mark is None else f"list_sum([bit_count(xor(xor(p.words[i], m_{mark.lower()}[i]), p.q[i])) for i in range(1, {WORDS + 1})])::BIGINT"


@query(f"WITH {PAIRED_SQL}, {marks_sql(operations.MARKS.values())} SELECT id, " + ", ".join(f"{H('p.words', 'm_' + operations.MARKS[n].lower())} AS {n.lower()}" for n in ONES) + " FROM p, marks")
def dict_marks(spark, sf_dir):
    return wide(spark, sf_dir).select("id", *(fp.popcount(OPS[n](F.col("words"))).alias(n.lower()) for n in ONES))


@query(f"WITH {PAIRED_SQL}, {marks_sql(m for m in operations.BINDS.values() if m)} SELECT id, " + ", ".join(f"{bound_sql(n)} AS {n.lower()}" for n in TWOS) + " FROM p, marks")
def dict_bindings(spark, sf_dir):
    return paired(spark, sf_dir).select("id", *(fp.popcount(OPS[n](F.col("words"), F.col("q"))).alias(n.lower()) for n in TWOS))


# ---- numbers
def between_sql(first: int, last: int) -> str:
    out = []
    for w in range(first // BITS, (last - 1) // BITS + 1):
        low, high = max(first - w * BITS, 0), min(last - w * BITS, BITS)
        out.append(f"bit_count(words[{w + 1}] & {(1 << high) - (1 << low)}::UBIGINT)::INT")
    return "(" + " + ".join(out) + ")::DOUBLE"


def runs_sql(size: int, count: int) -> str:
    return "[" + ", ".join(between_sql(i * size, (i + 1) * size) for i in range(count)) + "]"


NUMBERS_SQL = (
    f"WITH {PAIRED_SQL}, {marks_sql(['GROUND', 'HIERARCHY'])}, counted AS (SELECT id, {P('words')} AS pop, {P('q')} AS qpop, {H('words', 'q')} AS d, {H('words', 'm_ground')} AS dg, {H('words', 'm_hierarchy')} AS dh,"
    f" {runs_sql(1000, 10)} AS seg, {runs_sql(100, 100)} AS small, {runs_sql(2500, 4)} AS four, {between_sql(0, 1000)} AS v0, {between_sql(1000, 2000)} AS v1 FROM p, marks),"
    f" s AS (SELECT *, 1.0::DOUBLE - d / {WIDTH}.0::DOUBLE AS sim, list_avg(seg) AS seg_mean, list_avg(four) AS four_mean, list_sum(small) AS small_sum FROM counted)"
    " SELECT id, round(1 - sqrt(list_sum([(x - seg_mean) ** 2 for x in seg]) / 10.0) / seg_mean, 6) AS meta_confidence_get,"
    " round(list_sum([-(x / small_sum) * log2(x / small_sum) for x in small]) / 6.64, 6) AS meta_uncertainty_quantify,"
    " round((v0 - v1) / (v0 + v1), 6) AS qualia_valence_get, round(1 - list_sum([(x - four_mean) ** 2 for x in four]) / 4.0 / (3 * four_mean) ** 2, 6) AS qualia_activation_get,"
    f" round(CASE WHEN d < 5000 THEN 1 - d / 5000.0::DOUBLE WHEN d < 8000 THEN -0.5 * (1 - (d - 5000) / 3000.0::DOUBLE) ELSE 0 END, 6) AS ham_mexican_hat,"
    " round(CASE WHEN sim > 0.8 THEN sim WHEN sim > 0.5 THEN -(sim - 0.5) ELSE 0 END, 6) AS ada_resonate,"
    f" round(pop / {WIDTH}.0::DOUBLE + sim, 6) AS actr_activation, round(-d / {WIDTH}.0::DOUBLE, 6) AS actr_partial_match, sim > 0.7 AS actr_production_match,"
    " round(sim + (pop % 100) / 1000.0::DOUBLE, 6) AS actr_utility, least(9, pop // 1000)::BIGINT AS rung_current, round(sim, 6) AS rung_prototype_match, sim > 0.5 AS rung_category_member,"
    f" 1 - dg / {WIDTH}.0::DOUBLE > 0.3 AS rung_ground_check, floor(10 * (1 - dh / {WIDTH}.0::DOUBLE))::BIGINT AS rung_hierarchy_depth,"
    f" round((pop - qpop) / {WIDTH}.0::DOUBLE, 6) AS rl_reward, round((pop + 0.99 * qpop - pop) / {WIDTH}.0::DOUBLE, 6) AS rl_td_error, pop > 100 AND pop < 9900 AS fs_file_exists FROM s"
)


@query(NUMBERS_SQL)
def dict_numbers(spark, sf_dir):
    a, b = F.col("words"), F.col("q")
    real = {
        "META_CONFIDENCE_GET": (a,), "META_UNCERTAINTY_QUANTIFY": (a,), "QUALIA_VALENCE_GET": (a,), "QUALIA_ACTIVATION_GET": (a,),
        "ACTR_ACTIVATION": (a, b), "ACTR_PARTIAL_MATCH": (a, b), "ACTR_UTILITY": (a, b), "RUNG_PROTOTYPE_MATCH": (a, b),
        "RL_REWARD": (a, b), "RL_TD_ERROR": (a, b, a),
    }
    whole = {"ACTR_PRODUCTION_MATCH": (a, b), "RUNG_CATEGORY_MEMBER": (a, b), "RUNG_GROUND_CHECK": (a,), "FS_FILE_EXISTS": (a,)}
    return paired(spark, sf_dir).select(
        "id", *(F.round(OPS[n](*args), 6).alias(n.lower()) for n, args in real.items()), *(OPS[n](*args).alias(n.lower()) for n, args in whole.items()),
        F.round(OPS["HAM_MEXICAN_HAT"](OPS["HAM_DISTANCE"](a, b), 5000, 8000), 6).alias("ham_mexican_hat"),
        F.round(OPS["ADA_RESONATE"](OPS["HAM_SIMILARITY"](a, b)), 6).alias("ada_resonate"),
        OPS["RUNG_CURRENT"](a).cast("long").alias("rung_current"), OPS["RUNG_HIERARCHY_DEPTH"](a).cast("long").alias("rung_hierarchy_depth"),
    )


TURNED = "[xor(((t[i] & 4194303::UBIGINT) << 42), (t[CASE WHEN i = 1 THEN 256 ELSE i - 1 END] >> 22)) for i in range(1, 257)]"


@query(
    f"WITH {PAIRED_SQL}, {marks_sql(['THINK', 'AWAKEN', 'JOY', 'SADNESS', 'BASIS0', 'BASIS1', 'BASIS2'])}, t AS (SELECT *, {X('words', 'm_think')} AS t FROM p, marks)"
    f" SELECT id, {H(TURNED, 'q')} AS ada_think, list_sum([bit_count(x & 1229782938247303441::UBIGINT) for x in words])::BIGINT AS ada_whisper,"
    f" list_sum([bit_count(words[i] & q[i]) for i in range(1, 257)])::BIGINT AS rung_merge, {H('words', 'm_joy')} AS joy, {H('words', 'm_sadness')} AS sadness,"
    f" list_sum([bit_count(xor(words[i], (m_basis0[i] & m_basis1[i]) | (m_basis0[i] & m_basis2[i]) | (m_basis1[i] & m_basis2[i]))) for i in range(1, 257)])::BIGINT AS crystal_create,"
    f" CASE WHEN {P('words')} < {WIDTH // 2} THEN {P('words')} ELSE {P('q')} END AS crystal_interpolate,"
    f" list_sum([bit_count(xor(m_awaken[i], ('0x' || substr(md5('t' || id || ':' || (i - 1)), 1, 16))::UBIGINT)) for i in range(1, 257)])::BIGINT AS ada_awaken,"
    f" list_sum([bit_count(xor(xor(words[i], q[i]), m_joy[i])) for i in range(1, 257)])::BIGINT AS causal_counterfactual FROM t"
)
def dict_signatures(spark, sf_dir):
    a, b = F.col("words"), F.col("q")
    moment = F.concat(F.lit("t"), F.col("id").cast("string"))
    rows = paired(spark, sf_dir).withColumn("thought", OPS["ADA_THINK"](a))
    return rows.select(
        "id", fp.hamming(F.col("thought"), b).alias("ada_think"), fp.popcount(OPS["ADA_WHISPER"](a)).alias("ada_whisper"),
        fp.popcount(OPS["RUNG_MERGE"](a, b)).alias("rung_merge"), fp.hamming(a, OPS["QUALIA_EMOTION_JOY"]()).alias("joy"),
        fp.hamming(a, OPS["QUALIA_EMOTION_SADNESS"]()).alias("sadness"), fp.hamming(a, OPS["CRYSTAL_CREATE"]()).alias("crystal_create"),
        fp.popcount(OPS["CRYSTAL_INTERPOLATE"](a, b, a)).alias("crystal_interpolate"), fp.popcount(OPS["ADA_AWAKEN"](moment)).alias("ada_awaken"),
        fp.popcount(OPS["CAUSAL_COUNTERFACTUAL"](a, b, OPS["QUALIA_EMOTION_JOY"]())).alias("causal_counterfactual"),
    )


# ---- tables
NEAR_SQL = f"WITH {PAIRED_SQL}, near AS (SELECT id, g, words, {H('words', 'q')} AS distance FROM p) "


def lead(spark, sf_dir):
    rows = wide(spark, sf_dir)
    return rows, operations.literal(rows.where("id = 1").head()["words"])  # one signature


@query(NEAR_SQL + "SELECT id, distance FROM near ORDER BY distance, id LIMIT 12")
def dict_recall(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    return OPS["MEMORY_RECALL"](rows, "words", q, "id", 12).select("id", "distance")


@query(NEAR_SQL + f"SELECT id, round(1 - distance / {WIDTH}.0::DOUBLE, 6) AS similarity FROM near WHERE 1 - distance / {WIDTH}.0::DOUBLE >= 0.6")
def dict_select_similar(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    return OPS["SQL_SELECT_SIMILAR"](rows, "words", q, 0.6).select("id", F.round("similarity", 6).alias("similarity"))


@query(NEAR_SQL + f"SELECT id, round(1 - distance / {WIDTH}.0::DOUBLE, 6) AS similarity FROM (SELECT * FROM near ORDER BY distance, id LIMIT 12) WHERE 1 - distance / {WIDTH}.0::DOUBLE >= 0.65")
def dict_match_similar(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    return OPS["CYPHER_MATCH_SIMILAR"](rows, "words", q, "id", 12, 0.65).select("id", F.round("similarity", 6).alias("similarity"))


@query(NEAR_SQL + f"SELECT id FROM near WHERE 1 - distance / {WIDTH}.0::DOUBLE > 0.7")
def dict_resonance_capture(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    return OPS["LEARN_RESONANCE_CAPTURE"](rows, "words", q).select("id")


@query(
    NEAR_SQL + f"SELECT 'retrieved' AS what, id, round(1 - distance / {WIDTH}.0::DOUBLE, 6) AS value FROM (SELECT * FROM near WHERE id <> 1 ORDER BY distance, id LIMIT 1)"
    f" UNION ALL SELECT 'strongest', id, pop FROM (SELECT id, {P('words')} AS pop FROM near ORDER BY pop DESC, id LIMIT 1)"
)
def dict_best(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    near = OPS["ACTR_CHUNK_RETRIEVE"](rows.where("id <> 1"), "words", q, "id").select(F.lit("retrieved").alias("what"), "id", F.round("similarity", 6).alias("value"))
    top = OPS["ACTR_CONFLICT_RESOLVE"](rows, "words", "id").select(F.lit("strongest"), "id", F.col("popcount").cast("double"))
    return near.union(top)


KIN_SQL = f"kin AS MATERIALIZED (SELECT s_suppkey AS id, {sql_words('s_suppkey', 's_suppkey % 20', 250)} AS words FROM supplier)"


def kin(spark, sf_dir):
    """Suppliers, of which those of equal key modulo 20 share all but six words."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return materialise(made(rows, F.col("id"), F.col("id") % 20, 250), "kin")


@query(f"WITH {KIN_SQL}, pairs AS (SELECT a.id AS a, b.id AS b, {H('a.words', 'b.words')} AS distance FROM kin a JOIN kin b ON a.id < b.id) SELECT * FROM pairs WHERE distance <= 200")
def dict_similar_join(spark, sf_dir):
    return OPS["SQL_SIMILAR_JOIN"](kin(spark, sf_dir), "id", "words", 200)


@query(
    f"WITH {WIDE_SQL}, {KIN_SQL}, m AS (SELECT * FROM kin WHERE id <= 10) SELECT w.id, round(1 - max({S('w.words', 'm.words')}), 6) AS curiosity FROM wide w, m GROUP BY w.id"
)
def dict_curiosity(spark, sf_dir):
    memory = kin(spark, sf_dir).where("id <= 10")
    out = OPS["RL_CURIOSITY"](wide(spark, sf_dir), "words", memory, "words", "id")
    return out.select("id", F.round("curiosity", 6).alias("curiosity"))


@query(
    f"WITH {WIDE_SQL}, bits AS (SELECT g, i, unnest(range(0, 64)) AS j, words[i + 1] AS w, id FROM (SELECT *, unnest(range(0, 256)) AS i FROM wide)),"
    " votes AS (SELECT g, i, j, count(*) AS n, sum(((w >> j) & 1)::BIGINT) AS s FROM bits GROUP BY ALL) SELECT g, sum(CASE WHEN s * 2 > n THEN 1 ELSE 0 END)::BIGINT AS popcnt, max(n)::BIGINT AS n FROM votes GROUP BY g"
)
def dict_consolidate(spark, sf_dir):
    out = OPS["MEMORY_CONSOLIDATE"](wide(spark, sf_dir), ["g"], "words")
    return out.select("g", fp.popcount(F.col("words")).alias("popcnt"), "n")


@query(
    f"WITH {WIDE_SQL}, pairs AS (SELECT a.id, a.words AS x, b.words AS y FROM wide a JOIN wide b ON b.id = a.id + 1 WHERE a.id % 2 = 1),"
    " bits AS (SELECT id, i, x[i + 1] AS xw, xor(x[i + 1], y[i + 1]) AS w FROM (SELECT *, unnest(range(0, 256)) AS i FROM pairs)),"
    " votes AS (SELECT i, j, count(*) AS n, sum(((w >> j) & 1)::BIGINT) AS s FROM (SELECT *, unnest(range(0, 64)) AS j FROM bits) GROUP BY ALL),"
    " bundle AS (SELECT i, bit_or(CASE WHEN s * 2 > n THEN 1::UBIGINT << j ELSE 0 END) AS b FROM votes GROUP BY i),"
    " parity AS (SELECT i, bit_xor(xw) AS p, arg_min(w, id) AS f FROM bits GROUP BY i)"
    " SELECT sum(bit_count(b))::BIGINT AS bundle, sum(bit_count(p))::BIGINT AS parity, sum(bit_count(xor(xor(f, b), p)))::BIGINT AS corrected FROM bundle JOIN parity USING (i)"
)
def dict_crystal_train(spark, sf_dir):
    rows = wide(spark, sf_dir)
    pairs = rows.where("id % 2 = 1").select("id", F.col("words").alias("x")).join(rows.select((F.col("id") - 1).alias("id"), F.col("words").alias("y")), "id")
    out = OPS["LEARN_CRYSTAL_TRAIN"](pairs, "x", "y", "id")
    return out.select(*(fp.popcount(F.col(c)).alias(c) for c in ("bundle", "parity", "corrected")))


@query(
    f"WITH {WIDE_SQL}, {marks_sql([f'BASIS{i}' for i in range(8)])} " + " UNION ALL ".join(f"SELECT id, {i}::BIGINT AS round, round(1 - {P(f'm_basis{i}')} / {WIDTH}.0::DOUBLE, 6) AS similarity, {H('words', f'm_basis{i}')} AS popcnt FROM wide, marks" for i in range(8))
)
def dict_concepts(spark, sf_dir):
    out = OPS["LEARN_CONCEPT_EXTRACT"](wide(spark, sf_dir), "words")
    return out.select("id", F.col("round").cast("long").alias("round"), F.round("similarity", 6).alias("similarity"), fp.popcount(F.col("concept")).alias("popcnt"))


# ---- learning, causes, layers and paths
@query(
    "WITH s AS (SELECT c_mktsegment AS state, o_orderpriority AS action, avg(o_totalprice) / 1000.0 AS q, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),"
    " best AS (SELECT state, arg_max(action, (q, action)) AS greedy, max(q) AS top FROM s GROUP BY state)"
    " SELECT state, action, round(q + 0.1 * (n % 7 + 0.9 * top - q), 5) AS updated, greedy, CASE WHEN (n % 10) / 10.0 < 0.3 THEN action ELSE greedy END AS chosen,"
    " round(0.72 * q + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END, 5) AS trace, round(CASE WHEN n % 3 = 0 THEN 0 ELSE q END, 5) AS looked_up FROM s JOIN best USING (state)"
)
def dict_learning(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    values = rows.groupBy(F.col("c_mktsegment").alias("state"), F.col("o_orderpriority").alias("action")).agg((F.avg("o_totalprice") / 1000.0).alias("q"), F.count("*").alias("n"))
    greedy = OPS["RL_POLICY_GREEDY"](values, "state", "action", "q").withColumnRenamed("action", "greedy")
    top = values.groupBy("state").agg(F.max("q").alias("top"))
    held = OPS["RL_Q_VALUE"](values.select("state", "action"), values.where("n % 3 <> 0"), ["state", "action"], "q").withColumnRenamed("q", "looked_up")
    rows = values.join(greedy, "state").join(top, "state").join(held, ["state", "action"])
    q, n = F.col("q"), F.col("n")
    return rows.select(
        "state", "action", F.round(OPS["RL_Q_UPDATE"](q, n % 7, F.col("top"), 0.1, 0.9), 5).alias("updated"), "greedy",
        OPS["RL_POLICY_EPSILON"]((n % 10) / 10.0, 0.3, F.col("greedy"), F.col("action")).alias("chosen"),
        F.round(OPS["RL_TRACE_UPDATE"](q, n % 2 == 0), 5).alias("trace"), F.round("looked_up", 5).alias("looked_up"),
    )


@query(
    "SELECT 'parent' AS what, 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'child', 'o' || o_orderkey FROM orders WHERE o_custkey = 1"
    " UNION ALL SELECT DISTINCT 'outcome', o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'"
)
def dict_causes(spark, sf_dir):
    e = edges(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    steps = rows.select(F.col("c_mktsegment").alias("state"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("outcome"), F.lit("do").alias("kind")).distinct()
    out = OPS["CAUSAL_GRAPH_PARENTS"](e.where("verb = 'PART_OF'"), "r1").select(F.lit("parent").alias("what"), F.col("source").alias("node"))
    out = out.union(OPS["CAUSAL_GRAPH_CHILDREN"](e.where("verb = 'PLACED'"), "c1").select(F.lit("child"), "target"))
    return out.union(OPS["CAUSAL_DO_INTERVENE"](steps, "BUILDING", "1-URGENT").select(F.lit("outcome"), "outcome").distinct())


PATH_SQL = "'/' || p_brand || '/' || p_type || '/' || p_partkey"


@query(
    f"SELECT p_partkey, sha256({PATH_SQL}) AS hash, regexp_replace({PATH_SQL}, '/[^/]*$', '') AS parent, p_partkey::VARCHAR AS child, CASE WHEN p_size < 10 THEN 'warm' ELSE 'hot' END AS layer,"
    " round(p_retailprice * exp(-0.1 * p_size), 5) AS decayed, p_size < 25 AS before FROM part"
)
def dict_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("path", F.concat_ws("/", F.lit(""), "p_brand", "p_type", F.col("p_partkey").cast("string")))
    layer = F.when(F.col("p_size") < 10, "cold").otherwise("warm")
    split = OPS["FS_PATH_SPLIT"](F.col("path"))
    return rows.select(
        "p_partkey", OPS["FS_FILE_HASH"](F.col("path")).alias("hash"), split["parent"].alias("parent"), split["child"].alias("child"),
        OPS["CRYSTAL_LAYER_PROMOTE"](layer).alias("layer"), F.round(OPS["CRYSTAL_DECAY_EXP"](F.col("p_retailprice"), F.col("p_size"), 0.1), 5).alias("decayed"),
        OPS["CRYSTAL_BEFORE"](F.col("p_size"), F.lit(25)).alias("before"),
    )


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c), 4) AS total FROM (SELECT c_mktsegment, 0.5 * abs(c_acctbal) / 10000 AS c FROM customer UNION ALL SELECT s_name, s_acctbal / 10000 FROM supplier WHERE s_suppkey < 4) WHERE c >= 0.1 OR c_mktsegment LIKE 'Supp%' GROUP BY ALL")
def dict_memory(spark, sf_dir):
    """What a store keeps after forgetting, with new rows appended."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", (F.abs("c_acctbal") / 10000).alias("c"))
    kept = OPS["MEMORY_FORGET"](rows, "c", 0.5)
    new = table(spark, sf_dir, "supplier").where("s_suppkey < 4").select(F.col("s_name").alias("c_mktsegment"), (F.col("s_acctbal") / 10000).alias("c"))
    return OPS["MEMORY_STORE"](kept, new).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("total"))


# ---- searches over wide signatures
SEVEN = (0, 41, 83, 127, 168, 211, 255)


@query(
    f"WITH {PAIRED_SQL}, m AS (SELECT id, {' + '.join(f'bit_count(xor(words[{w + 1}], q[{w + 1}]))::INT' for w in SEVEN)} AS sampled, [{', '.join(f'bit_count(xor(words[{w + 1}], q[{w + 1}]))::DOUBLE' for w in SEVEN)}] AS each, {H('words', 'q')} AS d FROM p)"
    " SELECT id, round(sampled / 7.0::DOUBLE, 6) AS mean, round(list_stddev_pop(each), 6) AS sd, d AS distance,"
    " CASE WHEN sampled / 7.0 <= 2 AND list_stddev_pop(each) * 100 <= 31 AND d <= 2047 THEN 'strong' WHEN sampled / 7.0 BETWEEN 3 AND 4 AND list_stddev_pop(each) * 100 BETWEEN 32 AND 63 AND d BETWEEN 2048 AND 4095 THEN 'moderate'"
    " WHEN list_stddev_pop(each) * 100 >= 48 AND d BETWEEN 4096 AND 8191 THEN 'weak but stackable' ELSE 'noise' END AS signal FROM m"
)
def light_meter(spark, sf_dir):
    rows = paired(spark, sf_dir)
    mean, sd = search.light_meter(F.col("words"), F.col("q"), SEVEN)
    d = fp.hamming(F.col("words"), F.col("q"))
    return rows.select("id", F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), d.alias("distance"), response.signal_class(mean, sd * 100, d).alias("signal"))


@query(
    f"WITH {PAIRED_SQL}, m AS (SELECT id, {' + '.join(f'bit_count(xor(words[{w + 1}], q[{w + 1}]))::INT' for w in SEVEN)} AS sampled, list_sum([CASE WHEN words[i] <> q[i] THEN 1 ELSE 0 END for i in range(1, 257)]) AS differing,"
    f" {H('words', 'q')} AS d FROM p) SELECT id, d AS distance, round(CASE WHEN d < 5200 THEN 1 - d / 5200.0::DOUBLE WHEN d < 8000 THEN -0.5 * (1 - (d - 5200) / 2800.0::DOUBLE) ELSE 0 END, 6) AS response"
    f" FROM m WHERE sampled * {WIDTH} / 448.0::DOUBLE <= 9000 AND differing <= 200 AND d <= 5300 ORDER BY distance, id LIMIT 15"
)
def container_cascade(spark, sf_dir):
    """Estimate, differing words, exact distance, response, the nearest."""
    rows, q = lead(spark, sf_dir)
    out = search.container_cascade(rows, "words", q, "id", SEVEN, WORDS, estimate=9000, differing=200, most=5300, excite=5200, inhibit=8000, k=15)
    return out.select("id", "distance", F.round("response", 6).alias("response"))


@query(NEAR_SQL + "SELECT id, distance FROM near WHERE distance < 5300 ORDER BY distance, id LIMIT 20")
def adaptive_search(spark, sf_dir):
    """The k nearest under a threshold; found exactly, in one pass."""
    rows, q = lead(spark, sf_dir)
    return search.within(rows, "words", q, 5299).orderBy("distance", "id").limit(20).select("id", "distance")


CHUNK_SQL = "list_reduce([(('0x' || substr(md5(CASE WHEN i // 8 < 96 THEN 'g' || c_nationkey ELSE 'k' || c_custkey END || ':' || (i // 8)), 1 + 2 * (7 - i % 8), 2))::BIGINT) for i in range(0, 2048) if i % 5 = {0}], lambda x, y: xor(x, y))"


@query(
    "WITH s AS (SELECT c_custkey AS id, " + ", ".join(f"{CHUNK_SQL.format(b)} AS b{b}" for b in range(5)) + " FROM customer),"
    " f AS (SELECT * FROM s WHERE id = 1) SELECT s.id, s.b0 AS chunk, (" + " + ".join(f"bit_count(xor(s.b{b}, f.b{b}))::INT" for b in range(5)) + ")::BIGINT AS distance FROM s, f WHERE bit_count(xor(s.b0, f.b0)) <= 2 AND (" + " + ".join(f"bit_count(xor(s.b{b}, f.b{b}))::INT" for b in range(5)) + ") <= 20"
)
def scent_chunks(spark, sf_dir):
    """Rows of the chunks, named by a scent's first byte, that are near the query's, by the whole scent."""
    rows = wide(spark, sf_dir)
    index = search.scent_index(rows, "words")
    q = index.where("id = 1").head()["scent"]
    return search.scent_lookup(index, q, 2, 20).select("id", "chunk", "distance")


@query(NEAR_SQL + f"SELECT id, distance, round(1 - distance / {WIDTH}.0::DOUBLE + 0.1 * (((id - 1) % 7) / 100.0::DOUBLE), 6) AS score FROM near ORDER BY score DESC, id LIMIT 10")
def styled_topk(spark, sf_dir):
    rows, q = lead(spark, sf_dir)
    return search.styled(rows, "words", q, "id", 10, WIDTH, F.col("id") - 1).select("id", "distance", F.round("score", 6).alias("score"))


@query(
    NEAR_SQL + ", chosen AS (SELECT w.*, n.distance FROM wide w JOIN near n USING (id)), qv AS (SELECT c_acctbal FROM wide WHERE id = 1)"
    f" SELECT id, round(0.6 * (1 - distance / {WIDTH}.0::DOUBLE) + 0.4 * exp(-abs(chosen.c_acctbal - qv.c_acctbal) / 10000), 6) AS score FROM (SELECT * FROM chosen ORDER BY distance, id LIMIT 20) chosen, qv ORDER BY score DESC, id LIMIT 10"
)
def explore(spark, sf_dir):
    """Content similarity and closeness of a second feature over twice as many candidates as are wanted."""
    rows, q = lead(spark, sf_dir)
    own = rows.where("id = 1").head()["c_acctbal"]
    other = F.exp(-F.abs(F.col("c_acctbal") - own) / 10000)
    return search.explore(rows, "words", q, other, "id", 10, WIDTH).select("id", F.round("score", 6).alias("score"))


@query(
    f"WITH {WIDE_SQL}, bits AS (SELECT i, j, c_acctbal, ((words[i + 1] >> j) & 1)::BIGINT AS b FROM (SELECT *, unnest(range(0, 256)) AS i FROM wide WHERE g = 3), range(0, 64) r(j)),"
    " votes AS (SELECT i, j, sum(2 * b - 1) AS v FROM bits GROUP BY ALL), t AS (SELECT sum(CASE WHEN v > 0 THEN 1 ELSE 0 END)::BIGINT AS popcnt FROM votes),"
    " w AS (SELECT sum(abs(c_acctbal) / 100) AS total, sum(CASE WHEN c_acctbal > 0 THEN abs(c_acctbal) / 100 ELSE 0 END) AS plus, avg(c_acctbal) AS feature FROM wide WHERE g = 3)"
    " SELECT popcnt, round(feature, 4) AS feature, round(plus / total, 5) AS f, round(total / (total + 1), 6) AS c FROM t, w"
)
def synthesize(spark, sf_dir):
    """Of several thoughts one: the bundle, the mean feature, all evidence."""
    rows = wide(spark, sf_dir).where("g = 3")
    plus, minus = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100).otherwise(0.0), F.when(F.col("c_acctbal") <= 0, -F.col("c_acctbal") / 100).otherwise(0.0)
    out = search.synthesize(rows.withColumn("plus", plus).withColumn("minus", minus), "words", "c_acctbal", "plus", "minus", BITS)
    return out.select(fp.popcount(F.col("words")).alias("popcnt"), F.round("feature", 4).alias("feature"), F.round("truth.f", 5).alias("f"), F.round("truth.c", 6).alias("c"))

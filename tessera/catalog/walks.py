"""Graph and triple operators over signatures of 256 bits: parts that were bought together, and triples of places."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.catalog.graphs import SHARED, bought_together, named, NAMES
from tessera.functions import fp, names, truth
from tessera.operators import graph, search, triples
from tessera.session import materialise
from tessera.sources.star import table

WORDS, WIDTH = 8, 256


def words(text):
    return fp.hash_words(text, WORDS)


def said(prefix, key):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), words(said("p", "p_partkey")).alias("words"))


def links(spark, sf_dir):
    rows = bought_together(spark, sf_dir).withColumn("weight", ((F.col("source") + F.col("target")) % 10 + 1) / 10.0)
    return graph.with_words(materialise(rows, "links"), parts(spark, sf_dir))


L = lambda text: f"[('0x' || substr(md5({text} || ':' || i), 1, 8))::BIGINT for i in range(0, {WORDS})]"
X = lambda a, b: f"[xor({a}[i], {b}[i]) for i in range(1, {WORDS + 1})]"
H = lambda a, b: f"list_sum([bit_count(xor({a}[i], {b}[i])) for i in range(1, {WORDS + 1})])::BIGINT"
S = lambda a, b: f"(1.0::DOUBLE - {H(a, b)} / {WIDTH}.0::DOUBLE)"
GRAPH = (
    f"{SHARED}, node AS (SELECT p_partkey AS node, {L(chr(39) + 'p' + chr(39) + ' || p_partkey')} AS words FROM part),"
    " link AS MATERIALIZED (SELECT source, target, ((source + target) % 10 + 1) / 10.0::DOUBLE AS weight, a.words AS sw, b.words AS tw FROM shared JOIN node a ON a.node = source JOIN node b ON b.node = target)"
)


@query(f"WITH {GRAPH}, v1 AS (SELECT target AS node, min({H('sw', 'tw')}) AS value FROM link WHERE source <= 20 GROUP BY 1) SELECT l.target AS node, min(value + {H('sw', 'tw')})::BIGINT AS value FROM v1 JOIN link l ON l.source = v1.node GROUP BY 1")
def semiring_hamming(spark, sf_dir):
    rows = links(spark, sf_dir)
    starts = parts(spark, sf_dir).where("node <= 20").select("node", F.lit(0).cast("long").alias("value"))
    return graph.semiring_walk(rows, starts, "hamming", 2)


@query(f"WITH {GRAPH}, v1 AS (SELECT target AS node, max({S('sw', 'tw')} * weight) AS value FROM link WHERE source <= 20 GROUP BY 1) SELECT l.target AS node, round(max(value * {S('sw', 'tw')} * weight), 6) AS value FROM v1 JOIN link l ON l.source = v1.node GROUP BY 1")
def semiring_similarity(spark, sf_dir):
    starts = parts(spark, sf_dir).where("node <= 20").select("node", F.lit(1.0).alias("value"))
    out = graph.semiring_walk(links(spark, sf_dir), starts, graph.similarity_ring(WIDTH), 2)
    return out.select("node", F.round("value", 6).alias("value"))


@query(f"WITH {GRAPH}, q AS (SELECT {L(chr(39) + 'q' + chr(39))} AS q) SELECT target AS node, max(greatest({WIDTH} - list_sum([bit_count(xor(xor(sw[i], tw[i]), q[i])) for i in range(1, {WORDS + 1})]), 0))::BIGINT AS value FROM link, q WHERE source <= 40 GROUP BY 1")
def semiring_resonance(spark, sf_dir):
    starts = parts(spark, sf_dir).where("node <= 40").select("node", F.lit(0).cast("long").alias("value"))
    return graph.semiring_step(links(spark, sf_dir), starts, graph.resonance_ring(words(F.lit("q")), WIDTH))


@query(
    f"WITH {GRAPH}, sent AS (SELECT target AS node, source, unnest(range(0, {WORDS})) AS i, {X('sw', 'tw')} AS v FROM link WHERE source <= 60),"
    " bits AS (SELECT node, source, i, j, (v[i + 1] >> j) & 1 AS b FROM sent, range(0, 32) r(j)),"
    " votes AS (SELECT node, i, j, count(*) AS n, sum(b) AS s, arg_min(b, source) AS lead FROM bits GROUP BY ALL)"
    " SELECT node, i::BIGINT AS at, sum(CASE WHEN s * 2 > n OR (s * 2 = n AND lead = 1) THEN 1::BIGINT << j ELSE 0 END)::BIGINT AS word FROM votes GROUP BY node, i"
)
def semiring_binding(spark, sf_dir):
    starts = parts(spark, sf_dir).where("node <= 60").select("node", F.col("words").alias("value"))
    out = graph.binding_step(links(spark, sf_dir), starts)
    return out.select("node", F.posexplode("value").alias("at", "word")).withColumn("at", F.col("at").cast("long"))


@query(f"WITH {GRAPH} SELECT source, target, {H('sw', 'tw')} AS distance FROM link WHERE list_sum([bit_count(xor(sw[i], tw[i])) for i in range(1, 3)]) * 4 <= 130 AND {H('sw', 'tw')} <= 128")
def cascaded_links(spark, sf_dir):
    return graph.cascaded(links(spark, sf_dir), WORDS, 0, 2, 130, 128).select("source", "target", "distance")


@query(
    f"WITH RECURSIVE {GRAPH}, q AS (SELECT {L(chr(39) + 'q' + chr(39))} AS q), near AS (SELECT node, {H('words', 'q')} AS distance FROM node, q WHERE {H('words', 'q')} <= 132),"
    " r(node, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey <= 12 UNION SELECT n.node, hop + 1 FROM r JOIN link l ON l.source = r.node JOIN near n ON n.node = l.target WHERE hop < 4)"
    " SELECT r.node, min(hop)::BIGINT AS hop, any_value(distance) AS distance FROM r JOIN near USING (node) WHERE r.node > 12 GROUP BY r.node"
)
def gated_bfs(spark, sf_dir):
    nodes = parts(spark, sf_dir)
    out = graph.gated_visit(bought_together(spark, sf_dir), nodes.where("node <= 12").select("node"), nodes, words(F.lit("q")), 132, 4)
    return out.select("node", F.col("hop").cast("long").alias("hop"), "distance")


@query(
    f"WITH RECURSIVE {GRAPH}, r(node, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey <= 5 UNION SELECT l.target, hop + 1 FROM r JOIN link l ON l.source = r.node WHERE hop < 3)"
    " SELECT node, min(hop)::BIGINT AS hop FROM r WHERE node > 5 GROUP BY node"
)
def fingerprint_bfs(spark, sf_dir):
    """Edges carry source ^ verb ^ target with a few bits wrong; what is left when unbound is looked up among the nodes."""
    verb = words(F.lit("NEAR"))
    rows = links(spark, sf_dir)
    noisy = F.transform(fp.bind(fp.bind(F.col("source_words"), verb), F.col("target_words")), lambda x, i: F.when(i == 0, x.bitwiseXOR(F.lit(5).cast("long"))).otherwise(x))
    known = materialise(rows.select("source", F.col("target").alias("id"), noisy.alias("words")), "edges")
    nodes = parts(spark, sf_dir)
    out = graph.fingerprint_visit(known, nodes, nodes.where("node <= 5").select("node"), verb, 6, 3, WIDTH)
    return out.select("node", F.col("hop").cast("long").alias("hop"))


@query(
    f"WITH RECURSIVE {SHARED}, ends AS (SELECT min(source) AS a FROM shared), r(node, hop, path) AS (SELECT a, 0, [a] FROM ends UNION ALL SELECT s.target, hop + 1, list_append(path, s.target) FROM r JOIN shared s ON s.source = r.node WHERE hop < 4),"
    " far AS (SELECT node, min(hop) AS hop FROM r GROUP BY node), b AS (SELECT max(node) AS node FROM far WHERE hop = (SELECT least(3, max(hop)) FROM far))"
    " SELECT r.hop::BIGINT AS depth, array_to_string(path, '>') AS path FROM r JOIN b USING (node) JOIN far USING (node, hop)"
)
def shortest_paths(spark, sf_dir):
    """All shortest paths between two parts."""
    edges = materialise(bought_together(spark, sf_dir), "pairs")
    first = edges.agg(F.min("source")).head()[0]
    seen = graph.first_visit(edges.withColumn("verb", F.lit("NEAR")), spark.range(1).select(F.lit(first).alias("start")), 4)
    seen = materialise(seen.groupBy("target").agg(F.min("hop").alias("hop")), "seen")
    depth = min(3, seen.agg(F.max("hop")).head()[0] or 0)
    last = seen.where(F.col("hop") == depth).agg(F.max("target")).head()[0] if depth else first
    out = graph.path_between(edges.withColumn("verb", F.lit("NEAR")), first, last, 4)
    return out.select(F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


@query(f"WITH {SHARED}, b AS (SELECT source AS node, target AS other FROM shared UNION SELECT target, source FROM shared) SELECT node, round(count(*) / greatest((SELECT count(DISTINCT node) FROM b) - 1, 1), 8) AS centrality FROM b GROUP BY node")
def degree_centrality(spark, sf_dir):
    return graph.centrality(bought_together(spark, sf_dir)).select("node", F.round("centrality", 8).alias("centrality"))


@query(
    f"WITH {NAMES} SELECT a.id, (a.dn & ~((255::UBIGINT) << 40))::BIGINT AS parent, count(*) - 1 AS siblings, ((a.dn) | (1::UBIGINT << 32))::BIGINT AS child FROM dns a JOIN dns b ON (a.dn >> 48) = (b.dn >> 48) GROUP BY a.id, a.dn"
)
def dn_family(spark, sf_dir):
    """Parent, first child, and how many others have the same parent."""
    dn = F.col("dn")
    rows = named(spark, sf_dir).select("id", "dn", names.parent(dn).alias("parent"), names.child(dn, F.lit(0)).alias("child"))
    counts = rows.groupBy("parent").agg((F.count("*") - 1).alias("siblings"))
    return rows.join(counts, "parent").select("id", "parent", "siblings", "child")


@query(f"WITH {NAMES}, roots AS (SELECT n_regionkey, ((n_regionkey + 1)::UBIGINT << 56) | ((n_nationkey + 1)::UBIGINT << 48) AS root FROM nation WHERE n_nationkey % 3 = 0) SELECT root::BIGINT AS root, id FROM roots JOIN dns ON dn >> 48 = root >> 48")
def dn_range_join(spark, sf_dir):
    """Names below each of some roots, as a join of ranges: roots are few, and the planner checks their size."""
    roots = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(names.name(F.col("n_regionkey"), F.col("n_nationkey")).alias("root"))
    roots = roots.withColumn("low", names.ordered(F.col("root"))).withColumn("high", names.ordered(names.last_below(F.col("root"))))
    rows = named(spark, sf_dir).withColumn("at", names.ordered(F.col("dn")))
    return rows.join(roots, (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high"))).select("root", "id")


# ---- triples of places: customers in nations, nations in regions
def places(spark, sf_dir):
    c, n = (table(spark, sf_dir, x) for x in ("customer", "nation"))
    rows = c.select(said("c", "c_custkey").alias("s"), F.lit("LOCATED_IN").alias("p"), said("n", "c_nationkey").alias("o"), F.col("c_custkey").alias("k"))
    rows = rows.union(n.select(said("n", "n_nationkey"), F.lit("PART_OF"), said("r", "n_regionkey"), F.col("n_nationkey").cast("long")))
    noisy = F.transform(words(F.col("s")), lambda x, i: F.when(i == 0, x.bitwiseXOR(F.col("k") % 8)).otherwise(x))
    held = truth.truth(F.col("k") % 10 / 10.0, F.col("k") % 9 / 10.0)
    out = rows.select(F.concat_ws(">", "s", "o").alias("id"), "s", "p", "o", "k", noisy.alias("x"), words(F.col("p")).alias("y"), words(F.col("o")).alias("z"), held.alias("truth"))
    return materialise(out, "places")


PLACES = (
    "raw AS (SELECT 'c' || c_custkey AS s, 'LOCATED_IN' AS p, 'n' || c_nationkey AS o, c_custkey AS k FROM customer UNION ALL SELECT 'n' || n_nationkey, 'PART_OF', 'r' || n_regionkey, n_nationkey FROM nation),"
    f" rec AS MATERIALIZED (SELECT s || '>' || o AS id, s, p, o, k, [CASE WHEN i = 0 THEN xor(('0x' || substr(md5(s || ':' || i), 1, 8))::BIGINT, k % 8) ELSE ('0x' || substr(md5(s || ':' || i), 1, 8))::BIGINT END for i in range(0, {WORDS})] AS x,"
    f" {L('p')} AS y, {L('o')} AS z, (k % 10) / 10.0::DOUBLE AS f, (k % 9) / 10.0::DOUBLE AS c FROM raw)"
)
Q = lambda name, text: f"{name} AS (SELECT {L(chr(39) + text + chr(39))} AS w)"


def axis_sql(first: tuple[str, str], second: tuple[str, str], radius: int, more: str = "") -> str:
    (a, v), (b, w) = first, second
    d = f"((({H('rec.' + a, 'q1.w')}) + ({H('rec.' + b, 'q2.w')})) // 2)::BIGINT"
    return f"WITH {PLACES}, {Q('q1', v)}, {Q('q2', w)} SELECT id, {d} AS distance FROM rec, q1, q2 WHERE {d} <= {radius} {more}"


@query(axis_sql(("y", "LOCATED_IN"), ("z", "n3"), 3))
def spo_reverse(spark, sf_dir):
    return triples.axis_query(places(spark, sf_dir), ("y", words(F.lit("LOCATED_IN"))), ("z", words(F.lit("n3"))), 3).select("id", "distance")


@query(axis_sql(("x", "n3"), ("z", "r1"), 70))
def spo_relation(spark, sf_dir):
    return triples.axis_query(places(spark, sf_dir), ("x", words(F.lit("n3"))), ("z", words(F.lit("r1"))), 70).select("id", "distance")


@query(axis_sql(("y", "LOCATED_IN"), ("z", "n3"), 60, "AND f >= 0.7 AND c >= 0.5"))
def spo_gated(spark, sf_dir):
    """The gate drops most of the records that are near."""
    return triples.axis_query(places(spark, sf_dir), ("y", words(F.lit("LOCATED_IN"))), ("z", words(F.lit("n3"))), 60, "strong").select("id", "distance")


@query(
    f"WITH {PLACES}, {Q('q', 'n3')}, d AS (SELECT id, {H('x', 'w')} AS dx, {H('y', 'w')} AS dy, {H('z', 'w')} AS dz FROM rec, q)"
    " SELECT id, least(dx, dy, dz)::BIGINT AS distance, CASE WHEN dx <= least(dy, dz) THEN 'x' WHEN dy <= dz THEN 'y' ELSE 'z' END AS axis FROM d WHERE least(dx, dy, dz) <= 6"
)
def spo_content(spark, sf_dir):
    return triples.content_query(places(spark, sf_dir), words(F.lit("n3")), 6).select("id", "distance", "axis")


NEXT = f"nx AS (SELECT a.id, b.id AS next, {H('a.z', 'b.x')} AS distance FROM rec a JOIN rec b ON b.s = a.o WHERE a.id <> b.id AND {H('a.z', 'b.x')} <= 4)"


@query(f"WITH {PLACES}, {NEXT} SELECT * FROM nx")
def spo_successors(spark, sf_dir):
    """Records whose noisy subject is near another one's object, by bands."""
    return triples.successors(places(spark, sf_dir), 4, WIDTH)


@query(f"WITH {PLACES}, {NEXT} SELECT id AS start, 0::BIGINT AS level, id FROM rec WHERE k <= 30 AND p = 'LOCATED_IN' UNION ALL SELECT nx.id, 1, next FROM nx JOIN rec USING (id) WHERE rec.k <= 30 AND rec.p = 'LOCATED_IN'")
def spo_walk(spark, sf_dir):
    store = places(spark, sf_dir)
    out = triples.walk(triples.successors(store, 4, WIDTH), store.where("k <= 30 and p = 'LOCATED_IN'").select("id"), 3)
    return out.select("start", F.col("level").cast("long").alias("level"), "id")


def chains(spark, sf_dir):
    """Each customer's chain: in a nation, in a region."""
    store = places(spark, sf_dir)
    a = store.where("p = 'LOCATED_IN'")
    b = store.where("p = 'PART_OF'").select(F.col("s").alias("at"), F.col("x").alias("bx"), F.col("z").alias("bz"), F.col("truth").alias("bt"))
    both = a.join(b, a["o"] == b["at"])
    return a.select(F.col("s").alias("chain"), F.lit(1).alias("step"), "x", "z", "truth").union(both.select("s", F.lit(2), "bx", "bz", "bt"))


CHAIN = f"ch AS (SELECT a.s AS chain, {S('a.z', 'b.x')} AS link, a.f AS f1, a.c AS c1, b.f AS f2, b.c AS c2 FROM rec a JOIN rec b ON b.s = a.o WHERE a.p = 'LOCATED_IN')"


@query(f"WITH {PLACES}, {CHAIN} SELECT chain, round(link, 6) AS coherence FROM ch")
def spo_coherence(spark, sf_dir):
    return triples.coherence(chains(spark, sf_dir), ["chain"], "step", WIDTH).select("chain", F.round("coherence", 6).alias("coherence"))


@query(f"WITH {PLACES}, {CHAIN} SELECT chain, round(f1 * f2, 6) AS f, round(c1 * link * c2, 6) AS c FROM ch")
def spo_deduction(spark, sf_dir):
    return triples.deduction(chains(spark, sf_dir), ["chain"], "step", WIDTH).select("chain", F.round("f", 6).alias("f"), F.round("c", 6).alias("c"))


NIBBLES = lambda a: f"[len([1 for n in flatten([[({a}[u] >> (4 * g)) & 15 for g in range(0, 8)] for u in range(1, {WORDS + 1})]) if n = v]) for v in range(0, 16)]"


@query(
    f"WITH {PLACES}, {Q('q', 'n3')}, h AS (SELECT id, {NIBBLES('z')} AS hz, {NIBBLES('w')} AS hq FROM rec, q) SELECT id FROM h WHERE list_sum([abs(hz[i] - hq[i]) for i in range(1, 17)]) <= 24"
)
def spo_scent_prefilter(spark, sf_dir):
    store = places(spark, sf_dir).withColumn("hz", fp.nibbles(F.col("z"), WORDS))
    q = fp.nibbles(words(F.lit("n3")), WORDS)
    return store.where(fp.histogram_distance(F.col("hz"), q) <= 24).select("id")


@query(
    f"WITH {PLACES}, {NEXT}, v0 AS (SELECT s, id, f AS value FROM rec WHERE p = 'LOCATED_IN' AND k <= 50) SELECT 1::BIGINT AS level, nx.next AS node, round(max(value * (1 - distance / {WIDTH}.0::DOUBLE)), 6) AS value FROM v0 JOIN nx ON nx.id = v0.id GROUP BY nx.next"
)
def spo_semiring_walk(spark, sf_dir):
    """Chains level by level; records that are met twice keep the best value."""
    store = places(spark, sf_dir)
    links = triples.successors(store, 4, WIDTH).select(F.col("id").alias("source"), F.col("next").alias("target"), (1.0 - F.col("distance") / float(WIDTH)).alias("weight"))
    starts = store.where("p = 'LOCATED_IN' and k <= 50").select(F.col("id").alias("node"), F.col("truth.f").alias("value"))
    out = triples.chain_walk(materialise(links, "chain"), starts, "best", 2)
    return out.select(F.col("level").cast("long").alias("level"), "node", F.round("value", 6).alias("value"))


@query(f"WITH {PLACES}, {Q('q1', 'n3')}, {Q('q2', 'PART_OF')} SELECT id, {H('x', 'q1.w')} AS near, {H('y', 'q2.w')} AS other FROM rec, q1, q2 WHERE {H('x', 'q1.w')} <= 110 AND {H('y', 'q2.w')} <= 110")
def spo_clusters(spark, sf_dir):
    """Subject and predicate within a radius; clusters of the subject that cannot hold any are not read."""
    store = places(spark, sf_dir)
    centres = spark.range(6).select(F.col("id").alias("centre"), words(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("centre_words"))
    held = materialise(triples.clustered(store, "x", centres), "clusters")
    out = triples.cluster_query(held, centres, ("x", words(F.lit("n3"))), ("y", words(F.lit("PART_OF"))), 110)
    return out.select("id", "near", "other")


LEAVES = "leaf AS (SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS digest, sha256(c_custkey::VARCHAR) AS path FROM customer)"


@query(
    f"WITH {LEAVES}, l2 AS (SELECT substr(path, 1, 2) AS prefix, sha256(string_agg(digest, '' ORDER BY c_custkey)) AS digest FROM leaf GROUP BY 1),"
    " l1 AS (SELECT substr(prefix, 1, 1) AS up, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest FROM l2 GROUP BY 1), l0 AS (SELECT '' AS prefix, sha256(string_agg(digest, '' ORDER BY up)) AS digest FROM l1)"
    " SELECT 2::BIGINT AS level, prefix, digest FROM l2 UNION ALL SELECT 1, up, digest FROM l1 UNION ALL SELECT 0, prefix, digest FROM l0"
)
def merkle_tree(spark, sf_dir):
    leaves = table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("digest"))
    return triples.hash_tree(leaves, "c_custkey", 2).select(F.col("level").cast("long").alias("level"), "prefix", "digest")


@query("SELECT c_custkey, c_custkey <> 9 AS proven FROM customer WHERE c_custkey <= 9")
def merkle_proof(spark, sf_dir):
    """Whether each of some records can be proven to be in the store; the last one's content is another."""
    leaves = materialise(table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("digest")), "leaves")
    tree = materialise(triples.hash_tree(leaves, "c_custkey", 2), "tree")
    top = tree.where("level = 0").head()["digest"]
    rows = []
    for row in leaves.where("c_custkey <= 9").collect():  # the asked records
        digest = "0" * 64 if row["c_custkey"] == 9 else row["digest"]
        rows.append((row["c_custkey"], triples.proven(triples.proof(leaves, tree, "c_custkey", row["c_custkey"], 2), row["c_custkey"], digest, top)))
    return spark.createDataFrame(rows, "c_custkey long, proven boolean")


@query(
    f"WITH {PLACES}, s AS (SELECT id, [CASE WHEN (i + k) % 3 = 0 THEN x[i + 1] ELSE 0 END for i in range(0, {WORDS})] AS a, [CASE WHEN i % 2 = 0 THEN z[i + 1] ELSE 0 END for i in range(0, {WORDS})] AS b FROM rec)"
    f" SELECT id, {H('a', 'b')} AS distance, len([x for x in {X('a', 'b')} if x <> 0])::BIGINT AS held FROM s"
)
def spo_sparse(spark, sf_dir):
    kept = lambda c, test: F.transform(c, lambda x, i: F.when(test(i), x).otherwise(F.lit(0).cast("long")))
    rows = places(spark, sf_dir).withColumn("a", fp.sparse(kept(F.col("x"), lambda i: (i + F.col("k")) % 3 == 0))).withColumn("b", fp.sparse(kept(F.col("z"), lambda i: i % 2 == 0)))
    bound = fp.sparse_bind(F.col("a"), F.col("b"))
    return rows.select("id", fp.sparse_hamming(F.col("a"), F.col("b")).alias("distance"), F.size(bound).cast("long").alias("held"))


@query(
    f"WITH {PLACES} SELECT 'sp' AS by, s || ' ' || p AS key, count(*) AS n, min(o) AS first FROM rec GROUP BY 2 UNION ALL SELECT 'po', p || ' ' || o, count(*), min(s) FROM rec GROUP BY 2"
    " UNION ALL SELECT 's', s, count(*), min(o) FROM rec GROUP BY 2 UNION ALL SELECT 'p', p, count(*), min(s) FROM rec GROUP BY 2"
)
def spo_permutations(spark, sf_dir):
    """The four ways into the triples."""
    store = places(spark, sf_dir)
    out = None
    for name, keys, value in (("sp", ["s", "p"], "o"), ("po", ["p", "o"], "s"), ("s", ["s"], "o"), ("p", ["p"], "s")):
        rows = store.groupBy(F.concat_ws(" ", *keys).alias("key")).agg(F.count("*").alias("n"), F.min(value).alias("first")).select(F.lit(name).alias("by"), "key", "n", "first")
        out = rows if out is None else out.union(rows)
    return out


@query(f"WITH {PLACES}, e AS (SELECT id, o, {X('x', 'y')} AS xy, x, y, z FROM rec) SELECT e.id, b.o AS found, {H('e.z', 'b.w')} AS distance FROM e JOIN (SELECT DISTINCT o, z AS w FROM rec) b ON e.o = b.o")
def verb_retrieval(spark, sf_dir):
    """The ends that records' bindings x ^ y ^ z give when subject and verb are unbound."""
    store = places(spark, sf_dir)
    rows = store.withColumn("edge", fp.bind(fp.bind(F.col("x"), F.col("y")), F.col("z")))
    ends = store.select(F.col("o").alias("found"), F.col("z").alias("end_words")).dropDuplicates(["found"])
    return search.bound_retrieval(rows, "id", "x", "y", ends, "found", "end_words", 5, WIDTH)


@query(
    f"WITH {PLACES}, state AS (SELECT id, z, z[1] AS w FROM rec WHERE p = 'LOCATED_IN'), ask AS (SELECT id AS asked, z FROM rec WHERE k <= 20 AND p = 'LOCATED_IN') SELECT asked, id, {H('state.z', 'ask.z')} AS distance FROM ask JOIN state ON state.w = ask.z[1]"
)
def bucketed_states(spark, sf_dir):
    """States by their first word, then by the whole distance."""
    store = places(spark, sf_dir).where("p = 'LOCATED_IN'")
    asked = store.where("k <= 20").select(F.col("id").alias("asked"), F.col("z").alias("wanted"), F.col("z")[0].alias("first"))
    rows = store.select("id", "z", F.col("z")[0].alias("first")).join(asked, "first")
    return rows.select("asked", "id", fp.hamming(F.col("z"), F.col("wanted")).alias("distance")).where("distance <= 20")

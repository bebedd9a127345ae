"""Cypher, graph operators, the engine and streams on small inputs."""

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, versions
from tessera.plans import hybrid
from tessera.plans.commands import Commands, ticket
from tessera.plans.cypher import CypherError, Graph, cypher, parse, write, write_graph
from tessera.plans.engine import Engine
from tessera.sources.store import Store, books
from tessera.streaming import windows


@pytest.fixture(scope="module")
def people(spark):
    nodes = spark.createDataFrame([(1, "Ada", 36), (2, "Bob", 25), (3, "Cy", None), (4, "Di%", 41)], "id long, name string, age int")
    knows = spark.createDataFrame([(1, 2, 3), (2, 3, 5), (1, 4, 1), (3, 1, 2)], "src long, dst long, since int")
    return Graph().node("Person", nodes, "id").relationship("KNOWS", knows, "src", "dst", "Person", "Person")


def run(people, text, **params):
    return sorted(tuple(r) for r in cypher(people, text, params).collect())


def test_patterns(people):
    assert run(people, "MATCH (a:Person {name: 'Ada'})-[:KNOWS]->(b) RETURN b.name") == [("Bob",), ("Di%",)]
    assert run(people, "MATCH (a:Person)<-[k:KNOWS {since: 5}]-(b:Person) RETURN a.name, b.name AS who") == [("Cy", "Bob")]
    assert run(people, "MATCH (a:Person)-[:KNOWS]-(b:Person) WHERE a.id = 1 RETURN DISTINCT b.id AS id") == [(2,), (3,), (4,)]
    assert run(people, "MATCH (a:Person)-[w:KNOWS*2..3]->(b:Person) WHERE a.id = 1 RETURN b.id, w.hops") == [(3, 2)]
    assert run(people, "MATCH (a:Person)-[:KNOWS]->(b:Person), (b)-[:KNOWS]->(c:Person) WHERE c.id <> a.id RETURN a.id, c.id") == [(1, 3), (2, 1), (3, 2), (3, 4)]


def test_conditions(people):
    assert run(people, "MATCH (p:Person) WHERE p.id = 1 OR p.id = 2 AND p.age > 30 RETURN p.id") == [(1,)]
    assert run(people, "MATCH (p:Person) WHERE p.name CONTAINS '%' RETURN p.id") == [(4,)]
    assert run(people, "MATCH (p:Person) WHERE p.age IS NULL OR p.name ILIKE 'a%' RETURN p.id") == [(1,), (3,)]
    assert run(people, "MATCH (p:Person) WHERE p.id IN $ids AND NOT p.name STARTS WITH 'B' RETURN toUpper(p.name) AS n", ids=[1, 2]) == [("ADA",)]
    assert run(people, "MATCH (p:Person) RETURN count(*) AS n, avg(p.age) AS age") == [(4, 34.0)]


def test_paging(people):
    rows = [tuple(r) for r in cypher(people, "MATCH (p:Person) RETURN p.id AS id ORDER BY id DESC SKIP 1 LIMIT 2").collect()]
    assert rows == [(3,), (2,)]
    rows = [tuple(r) for r in cypher(people, "MATCH (p:Person) RETURN p.name LIMIT 2 SKIP 1").collect()]
    assert len(rows) == 2


@pytest.mark.parametrize(
    "text",
    ["MATCH (p:Nobody) RETURN p.id", "MATCH (p:Person) RETURN p.no", "MATCH (p:Person) RETURN q.id", "MATCH (p:Person) RETURN p.id nonsense here",
     "MATCH (p:Person) RETURN foo(p.id)", "MATCH (p:Person)-[:LIKES]->(q) RETURN q.id", "MATCH (p:Person) RETURN sum(p)", "MATCH (p:Person)"],
)
def test_errors(people, text):
    with pytest.raises(CypherError):
        cypher(people, text)


def test_precedence():
    assert parse("MATCH (a:X) WHERE a.x = 1 OR a.y = 2 AND a.z = 3 RETURN a.x")[0].where[0] == "or"


def test_writes(spark):
    nodes = spark.createDataFrame([("a", "Person", {"name": "Ada"})], "id string, label string, properties map<string,string>")
    nodes = write(nodes, "CREATE (b:Person {id: 'b', name: $n})", {"n": "Bob"})
    assert write(nodes, "MERGE (x:Person {name: 'Bob'})").count() == 2
    nodes = write(nodes, "MERGE (x:Person {name: 'Bob'}) SET x.age = 3")
    nodes = write(nodes, "MATCH (x:Person {id: 'a'}) SET x.age = 4")
    assert {r["id"]: r["properties"]["age"] for r in nodes.collect()} == {"a": "4", "b": "3"}
    assert [r["id"] for r in write(nodes, "MATCH (x:Person {name: 'Ada'}) DELETE x").collect()] == ["b"]


def test_cypher_writes_relationships(spark):
    nodes = spark.createDataFrame([], "id string, label string, properties map<string,string>")
    edges = spark.createDataFrame([], "source string, verb string, target string, properties map<string,string>")
    for text in ("CREATE (x:Person {id: 'a', name: 'Ada', age: 3})", "CREATE (x:Person {id: 'b', name: 'Bob', age: 5})", "CREATE (x:City {id: 'c', name: 'Rome'})"):
        nodes, edges = write_graph(nodes, edges, text)
    link = "MATCH (x:Person), (y:City {name: 'Rome'}) WHERE x.age > 2 AND x.name <> 'Bob' %s (x)-[:LIVES_IN {since: 9}]->(y)"
    nodes, edges = write_graph(nodes, edges, link % "CREATE")
    nodes, edges = write_graph(nodes, edges, link % "MERGE")
    nodes, edges = write_graph(nodes, edges, "MATCH (x:Person {id: 'a'}), (y:Person {id: 'b'}) MERGE (x)-[:KNOWS]->(y)")
    assert sorted((r["source"], r["verb"], r["target"], r["properties"].get("since")) for r in edges.collect()) == [("a", "KNOWS", "b", None), ("a", "LIVES_IN", "c", "9")]
    nodes, edges = write_graph(nodes, edges, "MATCH (x:Person) WHERE x.age >= 5 SET x.age = 6")
    assert {r["id"]: r["properties"].get("age") for r in nodes.collect()} == {"a": "3", "b": "6", "c": None}
    with pytest.raises(CypherError):
        write_graph(nodes, edges, "MATCH (x:City) DELETE x")
    nodes, less = write_graph(nodes, edges, "MATCH (x:Person)-[r:KNOWS]->(y:Person {id: 'b'}) DELETE r")
    assert [r["verb"] for r in less.collect()] == ["LIVES_IN"]
    nodes, edges = write_graph(nodes, edges, "MATCH (x:City {name: 'Rome'}) DETACH DELETE x")
    assert sorted(r["id"] for r in nodes.collect()) == ["a", "b"] and [r["verb"] for r in edges.collect()] == ["KNOWS"]


def test_first_visit(spark):
    edges = spark.createDataFrame([("a", "CAUSES", "b"), ("b", "CAUSES", "c"), ("a", "ENABLES", "d"), ("d", "CAUSES", "c"), ("c", "CAUSES", "a")], "source string, verb string, target string")
    starts = spark.sql("SELECT 'a' AS start")
    out = {(r["target"], r["hop"], r["via"]) for r in graph.first_visit(edges, starts, 5).collect()}
    assert out == {("b", 1, "a"), ("d", 1, "a"), ("c", 2, "b")}
    out = {(r["target"], r["hop"]) for r in graph.first_visit(edges, starts, 5, ["CAUSES"]).collect()}
    assert out == {("b", 1), ("c", 2)}
    assert graph.communities(edges).count() == 4


def test_engine(spark):
    engine = Engine(spark)
    engine.register("things", spark.sql("SELECT 1 AS id, array(1L, 3L) AS words UNION ALL SELECT 2, array(0L, 0L)"))
    assert engine.sql("SELECT hamming(words, array(0L, 1L)) AS d FROM things WHERE id = :id", id=1).head()[0] == 2
    near = engine.query("things").similar("words", F.array(F.lit(1).cast("long"), F.lit(3).cast("long")), 0.96).run()
    assert [r["id"] for r in near.collect()] == [1]
    with_edges = spark.createDataFrame([("a", "CAUSES", "b", 2.0), ("b", "AMPLIFIES", "c", 3.0)], "source string, verb string, target string, weight double")
    engine.register("e", with_edges)
    assert engine.impact("e", spark.sql("SELECT 'a' AS start"), 5.0) == {"reached": 2, "butterflies": 1}


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7, 0) AS ts, id % 3 AS k, double(id) AS v FROM range(60)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    made = {
        "tumbling": lambda df: windows.windowed(df, "ts", "1 hour", ["k"], "v", delay="1 hour"),
        "sliding": lambda df: windows.windowed(df, "ts", "1 hour", ["k"], "v", slide="30 minutes", delay="1 hour"),
        "sessions": lambda df: windows.sessions(df, "ts", "20 minutes", ["k"], "v", delay="1 hour"),
    }
    for name, f in made.items():
        query = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(rows).collect()))


def streamed(spark, tmp_path, rows, make, name):
    """The last row of each key that a stateful stream gives for rows that come in two files."""
    for i, part in enumerate(rows):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    query = make(stream).writeStream.outputMode("update").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return [r.asDict() for r in spark.table(name).collect()]


def test_stateful_evidence(spark, tmp_path):
    """A truth is weighed in by its confidence; confidences add up to at most 0.99."""
    schema = "k string, f double, c double, at int"
    rows = [spark.createDataFrame([("a", 1.0, 0.4, 1), ("a", 0.0, 0.2, 2), ("b", 0.5, 0.9, 1)], schema), spark.createDataFrame([("a", 1.0, 0.6, 3), ("b", 0.1, 0.9, 2)], schema)]
    out = streamed(spark, tmp_path, rows, lambda s: windows.evidence_updates(s, "k", "f", "c", "at"), "truths")
    last = {r["key"]: r for r in sorted(out, key=lambda r: r["seen"])}
    assert (last["a"]["f"], last["a"]["c"], last["a"]["seen"]) == (pytest.approx((0.4 + 0.6) / 1.2), 0.99, 3)
    assert (last["b"]["f"], last["b"]["c"]) == (pytest.approx(0.3), 0.99)


def test_learning_log(spark, tmp_path):
    schema = "s string, p string, at int"
    first = [("x", "encounter", 1), ("x", "apply", 2), ("x", "struggle", 3), ("y", "struggle", 1)]
    rows = [spark.createDataFrame(first, schema), spark.createDataFrame([("x", "breakthrough", 4), ("x", "apply", 5), ("x", "reflect", 6)], schema)]
    out = streamed(spark, tmp_path, rows, lambda s: windows.learning_log(s, "s", "p", "at"), "phases")
    last = {r["session"]: (r["phase"], r["seen"], r["done"]) for r in sorted(out, key=lambda r: r["seen"])}
    assert last == {"x": ("reflect", 6, True), "y": (None, 1, False)}


def test_experience(spark, tmp_path):
    """Q values with traces against the same sums by hand."""
    rng = __import__("random").Random(4)
    rows = [(a, i, rng.choice("pq"), rng.choice("lr"), rng.random(), rng.choice("pq")) for a in "mn" for i in range(12)]
    schema = "agent string, i int, state string, action string, reward double, next_state string"
    out = streamed(spark, tmp_path, [spark.createDataFrame([r for r in rows if r[1] < 7], schema), spark.createDataFrame([r for r in rows if r[1] >= 7], schema)], lambda s: windows.experience_updates(s, "agent", "i"), "learned")
    for agent in "mn":
        q, e, n = {}, {}, {}
        for _, _, s, a, r, t in sorted(x for x in rows if x[0] == agent):
            best = max((v for (x, _), v in q.items() if x == t), default=0.0)
            e = {k: v * 0.9 * 0.8 for k, v in e.items()}
            e[s, a], n[s, a] = e.get((s, a), 0.0) + 1, n.get((s, a), 0) + 1
            error = r + 0.9 * best - q.get((s, a), 0.0)
            q = {k: q.get(k, 0.0) + 0.1 * error * e[k] for k in e}
        last = {}
        for r in out:
            if r["agent"] == agent and r["visits"] >= last.get((r["state"], r["action"]), {"visits": 0})["visits"]:
                last[r["state"], r["action"]] = r
        assert {k: r["visits"] for k, r in last.items()} == n
        # values also move when a pair is not visited: the last batch's rows hold them
        held = [{(r["state"], r["action"]): r["q"] for r in out[i : i + len(q)]} for i in range(len(out)) if out[i]["agent"] == agent]
        assert any(set(h) == set(q) and all(h[k] == pytest.approx(q[k]) for k in q) for h in held)


def test_ingest(spark, tmp_path):
    rows = spark.range(10)
    rows.write.parquet(str(tmp_path / "in"))
    query = windows.ingest(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark counts in no window."""
    make = lambda *rows: spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, m), "k", 1.0) for h, m in rows], "ts timestamp, k string, v double")
    parts = [make((0, 5), (1, 5)), make((5, 0)), make((0, 10), (5, 10))]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    target = tmp_path / "in"
    target.mkdir()
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(target))
    query = windows.windowed(stream, "ts", "1 hour", ["k"], "v", delay="30 minutes").writeStream.outputMode("update").format("memory").queryName("late").start()
    for i in range(3):
        file = next((tmp_path / f"part{i}").glob("*.parquet"))
        shutil.copy(file, target / f"{i}.parquet")
        query.processAllAvailable()
    query.stop()
    n = {}
    for r in spark.table("late").collect():
        n[r["start"].hour] = max(n.get(r["start"].hour, 0), r["n"])
    assert n == {0: 1, 1: 1, 5: 2}


def test_commands(spark):
    run = Commands(spark)
    for text in ("SET a/b one", "SET a/c two", "SET d three", "BEGIN", "SET a/b four", "SET d five"):
        run.execute(text)
    assert run.execute("COMMIT") == 1 and run.execute("GET a/b") == "four" and run.execute("CHECKPOINT here") == 1
    run.execute("BEGIN")
    run.execute("DEL d")
    assert run.execute("COMMIT") == 2 and run.execute("GET d") is None
    run.execute("BEGIN")
    run.execute("SET a/b six")
    run.execute("ABORT")
    assert run.execute("GET a/b") == "four" and run.execute("VERSION") == 2
    assert sorted(map(tuple, run.execute("READAT here").collect())) == [("a/b", "four"), ("d", "five")]
    assert [tuple(r) for r in run.execute("DIFF 1 2").collect()] == [("d", "removed", "five", None)]
    assert sorted(map(tuple, run.execute("WHATIF x y").collect())) == [("a/b", "four"), ("x", "y")]
    assert sorted(r["path"] for r in run.execute("KEYS a/*").collect()) == ["a/b", "a/c"]
    assert [tuple(r) for r in run.execute("SCAN a/b 5").collect()] == [("a/c", "two")]
    assert run.execute("DN.PARENT a/b") == "a" and run.execute("DN.ANCESTORS a/b/c") == ["a/b", "a"]
    assert sorted(r["path"] for r in run.execute("DN.CHILDREN a").collect()) == ["a/b", "a/c"]
    assert run.execute("DAG.COMMIT") == 1
    run.execute("BIND a/b a/c bound")
    run.execute("BIND bound a/c back")
    assert [r["path"] for r in run.execute("RESONATE back 2").collect()] == ["a/b", "back"]
    assert run.execute("DAG.COMMIT") == 2 and sorted(r["path"] for r in run.execute("DAG.READ 1").collect()) == ["a/b", "a/c"]
    run.execute("PROMOTE a/b")
    run.execute("DEMOTE a/c")
    run.execute("SUPPRESS bound")
    run.execute("DECAY 0.5")
    assert {r["path"]: (r["tier"], r["c"]) for r in run.space.collect()} == {"a/b": ("hot", 0.5), "a/c": ("cold", 0.5), "back": ("warm", 0.5)}
    assert run.execute("CAM mexican hat")[0] == "HAM_MEXICAN_HAT"
    with pytest.raises(KeyError):
        run.execute("NOSUCH 1")
    with pytest.raises(ValueError):
        run.execute("GET")


def test_tickets(spark):
    engine = Engine(spark)
    engine.register("n", spark.sql("SELECT string(id) AS id, array(id, 0L) AS words, id * 9000 AS address FROM range(8)"))
    engine.register("e", spark.createDataFrame([("a", "CAUSES", "b"), ("b", "CAUSES", "c")], "source string, verb string, target string"))
    ids = lambda text: [r["id"] for r in ticket(engine, text).collect()]
    assert ids("all:n") == [str(i) for i in range(8)] and ids("surface:n") == ["0"] and ids("fluid:n") == ["1", "2", "3"] and ids("nodes:n") == ["4", "5", "6", "7"]
    assert ids("search:n:3:1") == ["3", "1", "2", "7"] and ids("topk:n:0:2") == ["0", "1"]
    assert {r["target"] for r in ticket(engine, "traverse:e:a:3").collect()} == {"b", "c"} and ticket(engine, "neighbors:e:b").count() == 2
    with pytest.raises(KeyError):
        ticket(engine, "other:n")


def test_store(spark, tmp_path):
    """A table is written from itself, a flush moves rows once, old versions stay until they are removed."""
    held = Store(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        held.read("nodes")
    rows = spark.sql("SELECT string(id) AS id, timestamp_seconds(id) AS created_at, array(id, id) AS words, id * 9000 AS address FROM range(8)")
    held.append("nodes", rows)
    held.append("nodes", rows.limit(0))
    held.persist(held.hydrate(["nodes"]))
    assert held.read("nodes").count() == 8 and held.versions("nodes") == [1, 2] and held.lookup("3").count() == 1
    assert [r["id"] for r in held.scan().collect()][:2] == ["0", "1"]
    before = datetime.datetime.fromtimestamp(3, datetime.timezone.utc).replace(tzinfo=None)
    assert held.flush("nodes", "created_at", before) == 3 and held.flush("nodes", "created_at", before) == 0
    assert held.read("nodes").count() == 5 and held.cold("nodes").count() == 3 and held.vacuum("nodes") == [1, 2]
    edges = spark.createDataFrame([("1", "a", "CAUSES", "b"), ("2", "b", "ENABLES", "c")], "id string, source string, verb string, target string")
    held.append("edges", edges)
    assert held.edges_from("a").count() == 1 and [r["verb"] for r in held.edges_to("c").collect()] == ["ENABLES"]
    held.save_index(rows, metadata={"v": 1})
    one = held.index(0)
    assert held.index().count() == 8 and one.count() == 8 and one.first()["metadata"] == '{"v": 1}'
    book = "Title: A Book\nAuthor: Somebody\n*** START OF THIS ***\nbody text\n*** END OF THIS ***\nafter"
    (tmp_path / "book.txt").write_text(book)
    assert [tuple(r)[1:] for r in books(spark, str(tmp_path / "book.txt")).collect()] == [("A Book", "Somebody", "body text")]


def test_merge_loses_no_key(spark):
    make = lambda d: spark.createDataFrame([(k, [v, 0]) for k, v in d.items()], "k string, w array<long>")
    base, ours, theirs = make({"same": 1, "mine": 2, "yours": 3, "both": 4, "gone": 5, "fought": 6}), make({"same": 1, "mine": 20, "yours": 3, "both": 5, "new": 8, "fought": 7}), make({"same": 1, "mine": 2, "yours": 30, "both": 6, "gone": 5, "other": 9})
    want = {"same": 1, "mine": 20, "yours": 30, "new": 8, "other": 9, "fought": 7}
    for strategy, both in {"last": 6, "first": 5, "xor": 4 ^ 5 ^ 6, "reject": 4}.items():
        out = {r["k"]: r["w"][0] for r in versions.merged(ours, theirs, base, ["k"], "w", strategy).collect()}
        assert out == want | {"both": both}
    with pytest.raises(ValueError):
        versions.merged(ours, theirs, base, ["k"], "w", "none")


def test_serializable_conflict(spark):
    history = spark.createDataFrame([("a", 1, 1.0, False), ("b", 2, 2.0, False), ("a", 3, 3.0, False)], "k string, version long, v double, deleted boolean")
    write = spark.createDataFrame([("c", 9.0, False)], "k string, v double, deleted boolean")
    reads = spark.createDataFrame([("a",)], "k string")
    assert versions.committed(history, write, reads, ["k"], 2, "repeatable read").agg(F.max("version")).head()[0] == 4
    with pytest.raises(RuntimeError):
        versions.committed(history, write, reads, ["k"], 2)
    with pytest.raises(RuntimeError):
        versions.committed(history, write.withColumn("k", F.lit("a")), None, ["k"], 2)


def test_hybrid_text():
    assert hybrid.parsed('hybrid {"limit": 3};') == {"limit": 3}
    for text in ("HYBRID", 'HYBRID {"nothing": 1}', "SELECT 1"):
        with pytest.raises(ValueError):
            hybrid.parsed(text)

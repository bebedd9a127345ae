"""Commands as text over a key space of signatures and a history of versions, and read tickets over an engine's tables.

A key space is a table (path, value, words, tier, c); every command that changes it replaces it by a new table, which
nothing reads until it is asked for. Commands: SET, GET, DEL, KEYS, SCAN, BIND, RESONATE, PROMOTE, DEMOTE, SUPPRESS,
DECAY, DN.PARENT, DN.CHILDREN, DN.ANCESTORS, DAG.COMMIT, DAG.LOG, DAG.READ, CAM, and of versions BEGIN, COMMIT, ABORT,
CHECKPOINT, VERSION, READAT, WHATIF, DIFF."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fp, operations
from tessera.operators import search, versions
from tessera.session import materialise
from tessera.sources import store

SPACE = "path string, value string, words array<bigint>, tier string, c double"


class Commands:
    def __init__(self, spark: SparkSession, words: int = 8):
        self.spark, self.words = spark, words
        self.space = spark.createDataFrame([], SPACE)
        self.history = spark.createDataFrame([], "path string, version long, value string, deleted boolean")
        self.log = None
        self.version, self.marks, self.open = 0, {}, None

    def execute(self, text: str):
        """The result of a command: a DataFrame, a value or None. Unknown commands and wrong numbers of words are errors."""
        name, *words = shlex.split(text)
        run = getattr(self, "do_" + name.lower().replace(".", "_"), None)
        if run is None:
            raise KeyError(f"unknown command {name}")
        try:
            return run(*words)
        except TypeError as error:
            raise ValueError(f"wrong arguments of {name}") from error

    def _signature(self, text: str):
        return fp.hash_words(F.lit(text), self.words)

    def _keep(self, rows: DataFrame) -> None:
        self.space = materialise(rows.select("path", "value", "words", "tier", "c"), "space")

    # ---- keys
    def do_set(self, path, value):
        new = self.spark.range(1).select(F.lit(path).alias("path"), F.lit(value).alias("value"), self._signature(value).alias("words"), F.lit("warm").alias("tier"), F.lit(1.0).alias("c"))
        self._keep(store.upsert(self.space, new, ["path"]))
        if self.open is not None:
            self.open[path] = value

    def do_get(self, path):
        row = self.space.where(F.col("path") == path).head()
        return row["value"] if row else None

    def do_del(self, pattern):
        if self.open is not None:
            for row in store.matching(self.space, "path", pattern).select("path").toLocalIterator():
                self.open[row["path"]] = None
        self._keep(self.space.join(store.matching(self.space, "path", pattern).select("path"), "path", "left_anti"))

    def do_keys(self, pattern="*"):
        return store.matching(self.space, "path", pattern).select("path")

    def do_scan(self, after, count):
        return store.page(self.space, "path", after or None, int(count)).select("path", "value")

    # ---- signatures
    def do_bind(self, a, b, target):
        """The binding of two keys' signatures under a third."""
        sides = [self.space.where(F.col("path") == p).select(F.col("words").alias(n)) for p, n in ((a, "a"), (b, "b"))]
        both = sides[0].crossJoin(sides[1])  # a row each
        new = both.select(F.lit(target).alias("path"), F.lit(f"{a}*{b}").alias("value"), fp.bind(F.col("a"), F.col("b")).alias("words"), F.lit("warm").alias("tier"), F.lit(1.0).alias("c"))
        self._keep(store.upsert(self.space, new, ["path"]))

    def do_resonate(self, path, k):
        row = self.space.where(F.col("path") == path).head()
        query = F.lit(row["words"])
        rows = self.space.withColumn("similarity", fp.similarity(F.col("words"), query, 32 * self.words))
        return rows.orderBy(F.desc("similarity"), "path").limit(int(k)).select("path", "similarity")

    def do_cam(self, *description):
        return operations.described(" ".join(description))

    # ---- tiers and confidence
    def do_promote(self, pattern):
        self._move(pattern, True)

    def do_demote(self, pattern):
        self._move(pattern, False)

    def _move(self, pattern, up):
        self._keep(versions.moved(self.space, "tier", up, F.col("path").isin([r["path"] for r in self.do_keys(pattern).toLocalIterator()])))

    def do_suppress(self, pattern):
        self._keep(versions.suppressed(self.space, self.do_keys(pattern), ["path"], "c"))

    def do_decay(self, factor):
        self._keep(versions.decayed(self.space, "c", float(factor)))

    # ---- paths as names
    def do_dn_parent(self, path):
        return path.rsplit("/", 1)[0] if "/" in path else ""

    def do_dn_ancestors(self, path):
        parts = path.split("/")
        return ["/".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)]

    def do_dn_children(self, path):
        depth = path.count("/") + 1
        own = F.startswith("path", F.lit(path + "/")) & (F.size(F.split("path", "/")) == depth + 1)
        return self.space.where(own).select("path")

    # ---- versions
    def do_version(self):
        return self.version

    def do_begin(self):
        if self.open is not None:
            raise RuntimeError("a transaction is open")
        self.open, self.began = {}, (self.space, self.version)

    def do_abort(self):
        self.space, _ = self.began
        self.open = None

    def do_commit(self):
        rows = [(path, value, value is None) for path, value in self.open.items()]
        writes = self.spark.createDataFrame(rows, "path string, value string, deleted boolean")
        history = versions.committed(self.history, writes, None, ["path"], self.began[1]) if rows else self.history
        self.history = materialise(history, "history")
        self.version, self.open = self.version + bool(rows), None
        return self.version

    def do_checkpoint(self, name):
        self.marks[name] = self.version
        return self.version

    def do_readat(self, version):
        at = self.marks.get(version)
        return versions.as_of(self.history, ["path"], int(version) if at is None else at).select("path", "value")

    def do_whatif(self, path, value):
        overlay = self.spark.createDataFrame([(path, value, False)], "path string, value string, deleted boolean")
        return versions.what_if(self.do_readat(self.version), overlay, ["path"])

    def do_diff(self, old, new):
        return versions.diff(self.do_readat(old), self.do_readat(new), ["path"], "value")

    # ---- a log of exclusive-or masks
    def do_dag_commit(self):
        """The present signatures as a version of the log; its number."""
        now = self.space.select("path", "words")
        old = self.dag if self.log is not None else now.limit(0)
        number = (self.log.agg(F.max("version")).head()[0] or 0) + 1 if self.log is not None else 1
        made = versions.deltas(old, now, ["path"], "words").withColumn("version", F.lit(number).cast("long"))
        self.log = materialise(made if self.log is None else self.log.unionByName(made), "log")
        self.dag = now
        return number

    def do_dag_log(self):
        return self.log.groupBy("version", "change").count()

    def do_dag_read(self, version):
        return versions.read_at(self.dag, self.log, ["path"], "words", int(version))


def ticket(engine, text: str, key: str = "id", words: str = "words", limit: int = 100) -> DataFrame:
    """What a read ticket names: `all:table`, `surface:table`, `fluid:table`, `nodes:table`, `edges:table`,
    `search:table:key:distance`, `topk:table:key:k`, `traverse:edges:start:depth`, `neighbors:edges:node`."""
    from tessera.functions.names import zone

    kind, name, *rest = text.split(":")
    rows = engine.table(name)
    if kind in ("all", "edges"):
        return rows
    if kind in ("surface", "fluid", "nodes"):
        return rows.where(zone(F.col("address")) == ("node" if kind == "nodes" else kind))
    if kind in ("search", "topk"):
        query = F.lit(rows.where(F.col(key).cast("string") == rest[0]).head()[words])
        if kind == "search":
            return search.within(rows, words, query, int(rest[1])).orderBy("distance", key)
        return search.top_k(rows, fp.hamming(F.col(words), query), key, int(rest[1]))
    if kind == "traverse":
        starts = engine.spark.range(1).select(F.lit(rest[0]).alias("start"))
        return engine.reach(name, starts, int(rest[1]))
    if kind == "neighbors":
        return rows.where((F.col("source") == rest[0]) | (F.col("target") == rest[0]))
    raise KeyError(f"unknown ticket {kind}")

"""Sources and sinks: Parquet stores of nodes, edges and indexes, text files, and path-keyed values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, label string, words array<bigint>, embedding array<float>, content string, properties string, created_at timestamp, version bigint"
EDGES = "id string, source string, verb string, target string, weight double, amplification double, properties string, created_at timestamp"


class Store:
    """Tables of Parquet files in versions: a table's folder holds one folder for each version, and readers use the last
    whole one. A new version is written beside the old and counts once its _SUCCESS file is there, so a failed write
    changes nothing and a table can be written from itself. Edges are laid out by verb."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Whole versions, the first one first."""
        make, files = self._files()
        folder = make(f"{self.path}/{name}")
        if not files.exists(folder):
            return []
        found = [f.getPath() for f in files.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and files.exists(make(f"{p.toString()}/_SUCCESS")))

    def _write(self, name: str, rows: DataFrame) -> None:
        held = self.versions(name)
        at = f"{self.path}/{name}/v{(held[-1] if held else 0) + 1}"
        out = rows.write.mode("overwrite")
        (out.partitionBy("verb") if name == "edges" else out).parquet(at)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows more; the files of the present version stay and get further ones beside them."""
        held = self.versions(name)
        if not held:
            return self._write(name, rows)
        out = rows.write.mode("append")
        return (out.partitionBy("verb") if name == "edges" else out).parquet(f"{self.path}/{name}/v{held[-1]}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        held = self.versions(name)
        if not held or version is not None and version not in held:
            raise FileNotFoundError(f"no table {name}" + (f" of version {version}" if held else ""))
        return self.spark.read.parquet(f"{self.path}/{name}/v{version or held[-1]}")

    def lookup(self, id: str) -> DataFrame:
        return self.read("nodes").where(F.col("id") == id)

    def edges_from(self, id: str) -> DataFrame:
        return self.read("edges").where(F.col("source") == id)

    def edges_to(self, id: str) -> DataFrame:
        return self.read("edges").where(F.col("target") == id)

    def scan(self, name: str = "nodes") -> DataFrame:
        """All rows in the order of their addresses' zones, if they have addresses: surface, fluid, node."""
        from tessera.functions.names import zone

        rows = self.read(name)
        if "address" not in rows.columns:
            return rows
        place = F.when(zone(F.col("address")) == "surface", 0).when(zone(F.col("address")) == "fluid", 1).otherwise(2)
        return rows.orderBy(place, "address")

    def persist(self, tables: dict[str, DataFrame]) -> None:
        """The tables anew, which may be read from this store."""
        for name, rows in tables.items():
            self._write(name, rows)

    def hydrate(self, names: list[str]) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in names}

    def vacuum(self, name: str, keep: int = 1) -> list[int]:
        """Versions but the last ones go; those that went."""
        make, files = self._files()
        gone = self.versions(name)[:-keep] if keep else self.versions(name)
        for version in gone:
            files.delete(make(f"{self.path}/{name}/v{version}"), True)
        return gone

    def flush(self, name: str, ts: str, before) -> int:
        """Rows older than a moment go to the table's cold folder, the others make its next version; how many went. The
        moment names the cold part, so a flush that is run again replaces its own part."""
        rows = self.read(name)
        old = F.coalesce(F.col(ts) < F.lit(before), F.lit(False))
        count = rows.where(old).count()
        if count:
            label = "".join(c for c in str(before) if c.isalnum())
            rows.where(old).write.mode("overwrite").parquet(f"{self.path}/{name}-cold/before={label}")
            self._write(name, rows.where(~old))
        return count

    def cold(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}-cold").drop("before")

    def save_index(self, rows: DataFrame, key: str = "id", words: str = "words", metadata: dict | None = None) -> None:
        """(id, words, metadata as JSON, prefix), in files by the first byte of the scent of a signature, in order."""
        from tessera.functions import fp

        prefix = F.aggregate(F.col(words), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)).bitwiseAND(F.lit(255).cast("long"))
        out = rows.select(F.col(key).alias("id"), F.col(words).alias("words"), F.lit(json.dumps(metadata or {})).alias("metadata"), prefix.alias("prefix"), fp.popcount(F.col(words)).alias("bits"))
        held = self.versions("index")
        out.repartition("prefix").sortWithinPartitions("prefix", "bits", "id").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/index/v{(held[-1] if held else 0) + 1}")

    def index(self, prefix: int | None = None) -> DataFrame:
        """The index, or only the files of a prefix."""
        rows = self.read("index")
        return rows if prefix is None else rows.where(F.col("prefix") == prefix)

    # ---- values by path
    def set_values(self, rows: DataFrame) -> None:
        """(path, value) over what is held."""
        self._write("values", upsert(self.read("values"), rows, ["path"]) if self.versions("values") else rows)

    def delete_values(self, pattern: str) -> None:
        held = self.read("values")
        self._write("values", held.join(matching(held, "path", pattern).select("path"), "path", "left_anti"))

    def values(self, pattern: str = "*") -> DataFrame:
        return matching(self.read("values"), "path", pattern)


def edge_views(edges: DataFrame) -> dict[str, DataFrame]:
    """The canonical edge table under both spellings that queries use."""
    return {
        "edges": edges,
        "persisted_edges": edges.withColumnsRenamed({"source": "from_id", "target": "to_id", "verb": "type"}),
    }


def books(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, author, text) of whole text files, without what stands before and after the marked body."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("whole"))
    stripped = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    body = F.regexp_extract("whole", r"(?s)\*\*\* ?START OF[^\n]*\*\*\*(.*?)(?:\*\*\* ?END OF|\z)", 1)
    return rows.select(
        "path", F.regexp_extract("whole", r"(?m)^Title:\s*(.*?)\s*$", 1).alias("title"),
        F.regexp_extract("whole", r"(?m)^Author:\s*(.*?)\s*$", 1).alias("author"),
        F.when(body != "", stripped(body)).otherwise(stripped(F.col("whole"))).alias("text"),
    )


def matching(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows whose path matches a glob of * and ?."""
    escaped = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in pattern)
    return rows.where(F.col(path).rlike(f"^{escaped}$"))


def page(rows: DataFrame, key: str, after, count: int) -> DataFrame:
    """The next rows in the order of a key: a cursor is the last key of the page before."""
    if after is not None:
        rows = rows.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(count)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def subtree(rows: DataFrame, dn: Column, root: int) -> DataFrame:
    """Rows whose hierarchical name is in a subtree: a range of the ordered names."""
    from tessera.functions.names import ordered, subtree

    low, high = subtree(root)
    return rows.where(ordered(dn).between(low, high))

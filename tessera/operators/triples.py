"""Subject-predicate-object store: records with signatures x, y, z and a truth value; distances are exact."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fp, truth
from tessera.operators.graph import semiring_step
from tessera.operators.search import near_join
from tessera.session import materialise


def half(a: Column, b: Column) -> Column:
    """Combined distance of two axes, rounded down."""
    return F.floor((a + b) / 2)


def axis_query(store: DataFrame, first: tuple[str, Column], second: tuple[str, Column], radius: int, gate: str | None = None) -> DataFrame:
    """Records near two given axes, nearest first: (axis, signature) each; optionally behind a truth gate."""
    if gate:
        store = store.where(truth.gate(F.col("truth"), gate))
    d = half(*(fp.hamming(F.col(axis), value) for axis, value in (first, second)))
    return store.withColumn("distance", d).where(F.col("distance") <= radius).orderBy("distance", "id")


def content_query(store: DataFrame, value: Column, radius: int) -> DataFrame:
    """Records of which an axis is near; axis is the nearest, x before y before z."""
    d = [fp.hamming(F.col(a), value) for a in "xyz"]
    best = F.least(*d)
    axis = F.when(d[0] == best, "x").when(d[1] == best, "y").otherwise("z")
    return store.withColumn("distance", best).withColumn("axis", axis).where(F.col("distance") <= radius).orderBy("distance", "id")


def successors(store: DataFrame, radius: int, bits: int = fp.WIDTH, word_bits: int = fp.WORD_BITS) -> DataFrame:
    """(id, next, distance): records whose x is near another's z, by equality for radius 0 and by equal bands else."""
    if radius == 0:
        a = store.select("id", F.col("z").alias("a_z"))
        b = store.select(F.col("id").alias("next"), F.col("x").alias("b_x"))
        pairs = a.join(b, a["a_z"] == b["b_x"]).withColumn("distance", F.lit(0).cast("long"))
    else:
        pairs = near_join(store, "id", "z", store.withColumnRenamed("id", "next"), "next", "x", radius, bits, word_bits)
    return pairs.where(F.col("id") != F.col("next")).select("id", "next", "distance")


def walk(links: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, level, id): records reached level by level over (id, next); one row for each record and level."""
    at = starts.select(F.col("id").alias("start"), "id")
    out = at.select("start", F.lit(0).alias("level"), "id")
    for level in range(1, depth + 1):
        at = materialise(at.join(links.select("id", "next"), "id").select("start", F.col("next").alias("id")).distinct(), "level")
        if at.isEmpty():
            break
        out = out.union(at.select("start", F.lit(level).alias("level"), "id"))
    return out


def coherence(chains: DataFrame, keys: list[str], order: str, width: int = fp.WIDTH) -> DataFrame:
    """Per chain the product of the similarities of each record's z and the next one's x; 1 for a single record."""
    w = Window.partitionBy(*keys).orderBy(order)
    linked = chains.withColumn("link", fp.similarity(F.col("z"), F.lead("x").over(w), width))
    some = F.max(F.when(F.col("link") <= 0, 1).otherwise(0))
    product = F.exp(F.sum(F.when(F.col("link") > 0, F.log("link"))))
    return linked.groupBy(*keys).agg(F.when(some == 1, 0.0).otherwise(F.coalesce(product, F.lit(1.0))).alias("coherence"))


def deduction(chains: DataFrame, keys: list[str], order: str, width: int = fp.WIDTH) -> DataFrame:
    """Per chain f as the product of frequencies and c as that of confidences and link similarities."""
    w = Window.partitionBy(*keys).orderBy(order)
    linked = chains.withColumn("link", F.coalesce(fp.similarity(F.col("z"), F.lead("x").over(w), width), F.lit(1.0)))
    every = F.array_sort(F.collect_list(F.struct(order, F.col("truth.f").alias("f"), F.col("truth.c").alias("c"), "link")))
    rows = linked.groupBy(*keys).agg(every.alias("all"))
    return rows.select(
        *keys, F.aggregate("all", F.lit(1.0), lambda t, x: t * x.f).alias("f"),
        F.aggregate("all", F.lit(1.0), lambda t, x: t * x.c * x.link).alias("c"),
    )


def scent_prefilter(store: DataFrame, words: str, query: Column, most: int) -> DataFrame:
    """Rows whose nibble histogram differs from the query's by at most so many."""
    return store.where(fp.histogram_distance(fp.nibbles(F.col(words)), fp.nibbles(query)) <= most)


def digests(store: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, digest) of the content of each record: the leaves of an authenticated store."""
    return store.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("digest"))


def hash_tree(leaves: DataFrame, key: str, depth: int) -> DataFrame:
    """(level, prefix, digest): a node for each prefix, of so many hex digits as its level, of the keys' hashes. A node's
    digest is that of its children's in the order of their prefixes; a lowest node's children are its leaves, in the order
    of their keys. depth: so that a lowest node has few leaves, see tree_depth; no node has more than 16 others."""
    digest = lambda name: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "digest"))), lambda x: x.digest), ""), 256)
    rows = leaves.withColumn("prefix", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, depth))
    at = rows.groupBy("prefix").agg(digest(key).alias("digest")).select(F.lit(depth).alias("level"), "prefix", "digest")
    out = at = materialise(at, "tree")
    for level in reversed(range(depth)):
        at = at.select(F.substring("prefix", 1, level).alias("up"), "prefix", "digest").groupBy("up").agg(digest("prefix").alias("digest"))
        at = at.select(F.lit(level).alias("level"), F.col("up").alias("prefix"), "digest")
        out = out.union(at)
    return out


def tree_depth(leaves: int, most: int = 256) -> int:
    """Levels of a tree whose lowest nodes have `most` leaves on average, or fewer."""
    depth = 1
    while leaves > most << (4 * depth):
        depth += 1
    return depth


def root(leaves: DataFrame, key: str, depth: int | None = None) -> DataFrame:
    """One row with the digest of all leaves."""
    depth = depth or tree_depth(leaves.count())
    return hash_tree(leaves, key, depth).where("level = 0").select(F.col("digest").alias("root"))


def proof(leaves: DataFrame, tree: DataFrame, key: str, value, depth: int) -> list[tuple[int, list[tuple[str, str]]]]:
    """What proves that a leaf is in a tree: of its lowest node all leaves, and of each node above the children. As many
    rows as a node's leaves and 16 for each level."""
    name = hashlib.sha256(str(value).encode()).hexdigest()
    own = leaves.where(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, depth) == name[:depth]).orderBy(key)
    out = [(depth, [(str(r[0]), r[1]) for r in own.select(key, "digest").collect()])]
    for level in reversed(range(depth)):
        children = tree.where((F.col("level") == level + 1) & F.startswith("prefix", F.lit(name[:level]))).orderBy("prefix")
        out.append((level, [(r["prefix"], r["digest"]) for r in children.collect()]))
    return out


def proven(steps: list[tuple[int, list[tuple[str, str]]]], value, digest: str, root: str) -> bool:
    """Whether a proof leads from a leaf's digest to a root."""
    name, held = hashlib.sha256(str(value).encode()).hexdigest(), (str(value), digest)
    for level, children in steps:
        if held not in children:
            return False
        held = (name[:level], hashlib.sha256("".join(d for _, d in children).encode()).hexdigest())
    return held == ("", root)


def cluster_query(store: DataFrame, centres: DataFrame, first: tuple[str, Column], second: tuple[str, Column], radius: int) -> DataFrame:
    """Records near a query on two axes, by clusters of the first axis: a cluster whose centre is farther from the query
    than its radius and the wanted one has none (triangle inequality). centres: (centre, centre_words), few by nature.
    Records have `centre` and `reach`, see clustered."""
    axis, value = first
    near = centres.withColumn("gap", fp.hamming(F.col("centre_words"), value))
    bounds = store.groupBy("centre").agg(F.max("reach").alias("most"))
    kept = near.join(bounds, "centre").where(F.col("gap") <= F.col("most") + radius).select("centre", "gap")
    rows = store.join(kept, "centre").where(F.abs(F.col("gap") - F.col("reach")) <= radius)
    rows = rows.withColumn("near", fp.hamming(F.col(axis), value)).where(F.col("near") <= radius)
    other, wanted = second
    return rows.withColumn("other", fp.hamming(F.col(other), wanted)).where(F.col("other") <= radius)


def clustered(store: DataFrame, axis: str, centres: DataFrame) -> DataFrame:
    """store with the nearest centre of an axis and the distance to it. centres are few: their list goes with each row."""
    every = centres.agg(F.collect_list(F.struct("centre", "centre_words")).alias("every"))  # one row
    rows = store.crossJoin(F.broadcast(every))
    best = F.array_min(F.transform("every", lambda c: F.struct(fp.hamming(F.col(axis), c.centre_words).alias("reach"), c.centre.alias("centre"))))
    return rows.withColumn("best", best).select(*store.columns, "best.centre", "best.reach")


def chain_walk(links: DataFrame, values: DataFrame, ring, hops: int) -> DataFrame:
    """(level, node, value): records reached over (source, target, ...), those met twice on a level merged by the semiring."""
    out = None
    for level in range(1, hops + 1):
        values = materialise(semiring_step(links, values, ring), "level")
        rows = values.select(F.lit(level).alias("level"), "node", "value")
        out = rows if out is None else out.union(rows)
    return out


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) between two sets of digests: added, removed, modified or same."""
    both = old.withColumnRenamed("digest", "old").join(new.withColumnRenamed("digest", "new"), key, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("same")
    return both.select(key, kind.alias("change"))

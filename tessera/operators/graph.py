"""Graph operators on an edge table (source, verb, target, weight, ...).

Traversals are frontier joins in a driver loop: each hop is one join, an anti join against what is known and one row
for each new node. Hops are written to the shared folder, so a plan never grows with the depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fp
from tessera.operators.search import near_join
from tessera.session import materialise


def oriented(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as (source, verb, target, ...) in the direction of travel: out, in, or both."""
    other = {"source": "target", "target": "source"}
    turned = edges.select(*(F.col(other.get(c, c)).alias(c) for c in edges.columns))
    return {"out": edges, "in": turned, "both": edges.unionByName(turned)}[direction]


def first_visit(
    edges: DataFrame, starts: DataFrame, depth: int, verbs: list[str] | None = None, direction: str = "out"
) -> DataFrame:
    """(start, hop, target, via, verb): every node once for each start, at its first hop; of several ways there the
    smallest predecessor and verb. starts: a column `start`. The start itself is not a result."""
    steps = oriented(edges, direction).select("source", "verb", "target")
    if verbs:
        steps = steps.where(F.col("verb").isin(verbs))
    known = starts.select("start", F.lit(0).alias("hop"), F.col("start").alias("target"), F.lit(None).cast(dict(edges.dtypes)["source"]).alias("via"), F.lit(None).cast("string").alias("verb"))
    frontier = known = known.distinct()
    for hop in range(1, depth + 1):
        ways = frontier.select("start", F.col("target").alias("source")).join(steps, "source")
        ways = ways.join(known.select("start", "target"), ["start", "target"], "left_anti")
        new = ways.groupBy("start", "target").agg(F.min(F.struct("source", "verb")).alias("way"))
        new = new.select("start", F.lit(hop).alias("hop"), "target", F.col("way.source").alias("via"), F.col("way.verb").alias("verb"))
        frontier = materialise(new, "frontier")
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known.where("hop > 0")


def paths(edges: DataFrame, starts: DataFrame, least: int, most: int, verbs: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(start, target, depth, path, amplification): all paths without a repeated node of least to most edges;
    amplification is the product of the edges' amplification or else weight."""
    steps = oriented(edges, direction)
    gains = [F.col(c) for c in ("amplification", "weight") if c in steps.columns]
    steps = steps.select("source", "verb", "target", F.coalesce(*gains, F.lit(1.0)).alias("gain"))
    if verbs:
        steps = steps.where(F.col("verb").isin(verbs))
    at = starts.select("start", F.col("start").alias("target"), F.lit(0).alias("depth"), F.array("start").alias("path"), F.lit(1.0).alias("amplification"))
    found = []
    for depth in range(1, most + 1):
        grown = at.withColumnRenamed("target", "source").join(steps.withColumnRenamed("verb", "by"), "source").where(~F.array_contains("path", F.col("target")))
        at = grown.select(
            "start", "target", F.lit(depth).alias("depth"), F.concat("path", F.array("target")).alias("path"),
            (F.col("amplification") * F.col("gain")).alias("amplification"),
        )
        at = materialise(at, "paths")
        if at.isEmpty():
            break
        if depth >= least:
            found.append(at)
    if not found:
        return at.limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def butterfly(edges: DataFrame, starts: DataFrame, least: float, most: int = 10) -> DataFrame:
    """Paths of causing or amplifying edges whose product of amplifications is above `least`."""
    return paths(edges, starts, 1, most, ["CAUSES", "AMPLIFIES"]).where(F.col("amplification") > least)


def spreading(edges: DataFrame, starts: DataFrame, decay: float, least: float, rounds: int = 5) -> DataFrame:
    """(target, activation): a neighbour gets its predecessor's activation times decay; a node keeps the most, and
    spreading stops below `least`. starts: target, activation."""
    best = starts.groupBy("target").agg(F.max("activation").alias("activation"))
    frontier = best
    for _ in range(rounds):
        sent = frontier.withColumnRenamed("target", "source").join(edges.select("source", "target"), "source")
        sent = sent.select("target", (F.col("activation") * decay).alias("activation")).where(F.col("activation") >= least)
        sent = sent.groupBy("target").agg(F.max("activation").alias("sent"))
        frontier = sent.join(best, "target", "left").where("activation is null or sent > activation")
        frontier = materialise(frontier.select("target", F.col("sent").alias("activation")), "spread")
        if frontier.isEmpty():
            break
        best = materialise(best.union(frontier).groupBy("target").agg(F.max("activation").alias("activation")), "best")
    return best


class Semiring:
    """How a value travels over an edge (multiply) and how values that meet are added (an aggregate)."""

    def __init__(self, multiply: Callable[[Column], Column], add: Callable[[Column], Column]):
        self.multiply, self.add = multiply, add


#: Over columns value (of the source) and, of the edge, weight and distance; those of signatures also need source_words
#: and target_words, see with_words.
SEMIRINGS = {
    "reachability": Semiring(lambda v: v, F.bool_or),
    "shortest": Semiring(lambda v: v + F.col("distance"), F.min),
    "best": Semiring(lambda v: v * F.col("weight"), F.max),
    "sum": Semiring(lambda v: v * F.col("weight"), F.sum),
    "count": Semiring(lambda v: v, F.sum),
    "hamming": Semiring(lambda v: v + fp.hamming(F.col("source_words"), F.col("target_words")), F.min),
}


def similarity_ring(width: int) -> Semiring:
    """Best similarity: the value times that of the edge's ends times its weight."""
    return Semiring(lambda v: v * fp.similarity(F.col("source_words"), F.col("target_words"), width) * F.col("weight"), F.max)


def resonance_ring(query: Column, width: int) -> Semiring:
    """How near an edge's binding is to a query, whatever comes in."""
    near = lambda v: F.greatest(F.lit(width) - fp.hamming(fp.bind(F.col("source_words"), F.col("target_words")), query), F.lit(0))
    return Semiring(near, F.max)


def with_words(edges: DataFrame, nodes: DataFrame, key: str = "node", words: str = "words") -> DataFrame:
    """edges with the signatures of their ends."""
    ends = [nodes.select(F.col(key).alias(end), F.col(words).alias(f"{end}_words")) for end in ("source", "target")]
    return edges.join(ends[0], "source").join(ends[1], "target")


def binding_step(edges: DataFrame, values: DataFrame, word_bits: int = fp.WORD_BITS) -> DataFrame:
    """One step of path binding: values (node, value: a signature) are bound with their edges' targets; those that meet
    are bundled, a tie being that of the smallest source."""
    sent = values.withColumnRenamed("node", "source").join(edges, "source")
    sent = sent.select(F.col("target").alias("node"), "source", fp.bind(F.col("value"), F.col("target_words")).alias("value"))
    return fp.bundle(sent, ["node"], "value", order="source", word_bits=word_bits).select("node", "value")


def cascaded(edges: DataFrame, words: int, first: int, count: int, estimate: int, most: int) -> DataFrame:
    """edges whose ends are near: an estimate from some words first (which can lose edges), then the exact distance."""
    rough = fp.masked_hamming(F.col("source_words"), F.col("target_words"), first, count) * (words // count)
    rows = edges.where(rough <= estimate)
    return rows.withColumn("distance", fp.hamming(F.col("source_words"), F.col("target_words"))).where(F.col("distance") <= most)


def gated_visit(edges: DataFrame, starts: DataFrame, nodes: DataFrame, query: Column, most: int, depth: int) -> DataFrame:
    """(node, hop, distance): nodes near a query, reached over such nodes only; visited is shared by all starts. The
    difference of popcounts, a lower bound, comes first."""
    near = nodes.where(F.abs(fp.popcount(F.col("words")) - fp.popcount(query)) <= most)
    near = near.withColumn("distance", fp.hamming(F.col("words"), query)).where(F.col("distance") <= most).select(F.col("node").alias("target"), "distance")
    steps = materialise(edges.select("source", "target").distinct().join(near, "target"), "gated")
    known = starts.select("node").distinct()
    frontier, out = known, None
    for hop in range(1, depth + 1):
        new = frontier.withColumnRenamed("node", "source").join(steps, "source").select(F.col("target").alias("node"), "distance").distinct()
        new = materialise(new.join(known, "node", "left_anti").select("node", F.lit(hop).alias("hop"), "distance"), "gated")
        if new.isEmpty():
            break
        out = new if out is None else out.union(new)
        frontier = new.select("node")
        known = known.union(frontier)
    return (out if out is not None else known.select("node", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("distance")).limit(0)).orderBy("distance", "node")


def fingerprint_visit(
    edges: DataFrame, nodes: DataFrame, starts: DataFrame, verb: Column, most: int, depth: int, bits: int, word_bits: int = fp.WORD_BITS
) -> DataFrame:
    """(node, hop): nodes reached over edges that are known by their signatures alone (source ^ verb ^ target): an edge
    belongs to a frontier node if what is left when node and verb are unbound is near a node's signature. The left-overs
    of the edges that carry a source are joined by source; all others would be pairs of every node and edge."""
    known = starts.select("node").distinct()
    frontier, out = known, None
    for hop in range(1, depth + 1):
        at = frontier.join(nodes, "node").select(F.col("node").alias("source"), F.col("words").alias("source_words"))
        left = edges.join(at, "source").withColumn("rest", fp.bind(fp.bind(F.col("words"), F.col("source_words")), verb))
        left = materialise(left.withColumn("edge", F.concat_ws(">", "source", "id")).select("edge", "rest"), "unbound")
        met = near_join(left, "edge", "rest", nodes, "node", "words", most, bits, word_bits)
        new = materialise(met.select("node").distinct().join(known, "node", "left_anti").select("node", F.lit(hop).alias("hop")), "met")
        if new.isEmpty():
            break
        out = new if out is None else out.union(new)
        frontier = new.select("node")
        known = known.union(frontier)
    return out if out is not None else known.select("node", F.lit(0).alias("hop")).limit(0)


def path_between(edges: DataFrame, source, target, most: int) -> DataFrame:
    """(depth, path): all shortest paths from one node to another of at most so many edges. Levels of first visits from
    the source, then back from the target over edges that climb a level."""
    starts = edges.sparkSession.range(1).select(F.lit(source).alias("start"))
    seen = first_visit(edges, starts, most).select(F.col("target").alias("node"), "hop")
    seen = materialise(seen.union(starts.select(F.col("start").alias("node"), F.lit(0).alias("hop"))), "levels")
    steps = edges.select("source", "target").distinct().join(seen.select(F.col("node").alias("source"), F.col("hop").alias("h")), "source")
    steps = steps.join(seen.select(F.col("node").alias("target"), F.col("hop").alias("g")), "target").where("g = h + 1").select("source", "target")
    end = seen.where(F.col("node") == F.lit(target)).head()
    if end is None or end["hop"] == 0:
        return starts.select(F.lit(0).alias("depth"), F.array(F.col("start")).alias("path")).limit(0 if end is None else 1)
    at = starts.select(F.lit(target).alias("first"), F.array(F.lit(target)).alias("path"))
    for _ in range(end["hop"]):
        at = at.join(steps, at["first"] == steps["target"]).select(F.col("source").alias("first"), F.concat(F.array("source"), "path").alias("path"))
        at = materialise(at, "back")
    return at.select(F.lit(end["hop"]).alias("depth"), "path")


def centrality(edges: DataFrame) -> DataFrame:
    """(node, centrality): distinct neighbours in either direction, of all other nodes."""
    both = oriented(edges.select("source", "target"), "both").where("source <> target").distinct()
    counts = both.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"))
    total = counts.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("node", (F.col("n") / F.col("total")).alias("centrality"))


def semiring_step(edges: DataFrame, values: DataFrame, ring: Semiring | str) -> DataFrame:
    """One matrix-vector step: (node, value) to the values of the targets."""
    ring = SEMIRINGS[ring] if isinstance(ring, str) else ring
    sent = values.withColumnRenamed("node", "source").join(edges, "source")
    return sent.withColumn("value", ring.multiply(F.col("value"))).groupBy(F.col("target").alias("node")).agg(ring.add(F.col("value")).alias("value"))


def semiring_walk(edges: DataFrame, values: DataFrame, ring: Semiring | str, hops: int) -> DataFrame:
    """The frontier after so many steps, each replacing the last."""
    for _ in range(hops):
        values = materialise(semiring_step(edges, values, ring), "hop")
    return values


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(node, rank) after so many rounds; the rank of nodes without out-edges is spread over all nodes."""
    steps = edges.select("source", "target").distinct()
    nodes = materialise(steps.select(F.col("source").alias("node")).union(steps.select("target")).distinct(), "nodes")
    count = nodes.count()
    degree = steps.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    steps = materialise(steps.join(degree.withColumnRenamed("node", "source"), "source"), "steps")
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(count, 1)))
    for _ in range(rounds):
        sent = ranks.withColumnRenamed("node", "source").join(steps, "source")
        sent = sent.groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("sent"))
        lost = ranks.join(degree, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        ranks = nodes.join(sent, "node", "left").crossJoin(F.broadcast(lost)).select(  # lost is one row
            "node", ((1 - damping) / count + damping * (F.coalesce("sent", F.lit(0.0)) + F.col("lost") / count)).alias("rank")
        )
        ranks = materialise(ranks, "ranks")
    return ranks


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, each pair linked in either direction. Each edge leads from its end of smaller degree,
    so a hub's wedges are never formed."""
    pairs = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    ranked = pairs.join(degree.withColumnsRenamed({"node": "a", "degree": "da"}), "a").join(degree.withColumnsRenamed({"node": "b", "degree": "db"}), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    led = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = led.withColumnRenamed("y", "y1").join(led.withColumnRenamed("y", "y2"), "x").where("y1 < y2")
    closed = wedges.join(pairs.withColumnsRenamed({"a": "y1", "b": "y2"}), ["y1", "y2"])
    every = F.array_sort(F.array("x", "y1", "y2"))
    return closed.select(every[0].alias("a"), every[1].alias("b"), every[2].alias("c"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) by alternating large-star and small-star steps; component is the smallest node reachable."""
    links = edges.where("source <> target").select(F.greatest("source", "target").alias("a"), F.least("source", "target").alias("b"))
    links = materialise(links.distinct(), "links")
    while True:
        many = links.groupBy("a").count()
        centres = links.select(F.col("b").alias("a")).distinct()
        if many.where("count > 1").select("a").union(many.join(centres, "a", "left_semi").select("a")).isEmpty():
            own = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return links.selectExpr("a as node", "b as component").union(own)
        around = links.union(links.selectExpr("b as a", "a as b"))
        low = around.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = around.join(low, "a").where("b > a").selectExpr("b as a", "m as b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").selectExpr("b as a", "m as b")
        links = materialise(small.union(low.selectExpr("a", "m as b")).distinct(), "links")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of every node with an edge."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.unionAll(edges.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by label propagation: a node takes its neighbours' most frequent label, smallest on a tie."""
    both = materialise(oriented(edges.select("source", "target"), "both").where("source <> target").distinct(), "both")
    labels = both.select(F.col("source").alias("node")).distinct().withColumn("community", F.col("node"))
    w = Window.partitionBy("node").orderBy(F.desc("votes"), "community")
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "source"), "source")
        votes = votes.groupBy(F.col("target").alias("node"), "community").agg(F.count("*").alias("votes"))
        labels = votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", "community")
        labels = materialise(labels, "labels")
    return labels

"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table projects the unit vectors on `projections` Gaussian directions and cuts every projection into cells of one
width; a bucket is a combination of cells. For a query, a neighbour of the expected similarity has normally
distributed projections of known mean and variance, so each bucket has an estimated success probability. The query
visits buckets in descending order of it, the query's own and perturbed ones alike, down to a least probability. Every
row of a visited bucket is scored exactly; the tables' candidates are merged.

Nothing is set for particular data: the k nearest of at most SAMPLE queries, found by scoring them against all rows,
give the similarity to expect, and of all numbers of tables and projections and cell widths that are tried that one is
taken for which the fewest rows of a sample have to be scored when RECALL of those nearest shall be met; its least
probability goes with it. Neighbours that hardly differ from other rows (as of random vectors of many dimensions) stand
in nearly all buckets: then most rows are scored, by one table. Queries that find fewer than k neighbours are scored
against all rows.

A bucket's rows and the queries that visit it are cut into blocks of bounded size, so a bucket that holds a third of
all rows is many tasks and no task holds more than two blocks. Scores are cosines in double precision, summed in an
order that depends on the dimension alone, so equal vectors have equal scores.

Undefined input: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null id,
take no part. Vectors are compared with those of the same dimension only. Rows of one id are one item, scored by its
nearest row; an item is no candidate of its own query. An empty table gives an empty result. Other columns of the
input are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, small_batches
from tessera.llm.words import mix

#: Rows, and queries, of a bucket that one task scores at a time.
BLOCK = 1024
#: Queries, and rows, of each dimension that the parameters are taken from, and the share of neighbours to meet there.
SAMPLE, SAMPLE_ROWS, RECALL = 200, 1000, 0.95
#: What is tried: tables, projections, cell widths; rows of a mean bucket at least, and the cost of a visit in rows.
TABLES, PROJECTIONS, WIDTHS, BUCKET, VISIT = (1, 2, 3), range(1, 15), (0.6, 1.0, 1.6), 48, 48


@dataclass(frozen=True)
class Plan:
    """How vectors of a dimension are hashed: no projections mean one bucket of all rows."""

    tables: int = 1
    projections: int = 0
    width: float = 1.0
    similarity: float = 0.0
    least: float = 0.0


def projections_of(dimension: int, table: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (as rows) and offsets in cells, the same wherever they are computed."""
    made = np.random.default_rng((20240229, dimension, table))
    # offsets first: fewer projections are the first ones of more
    offsets = made.random(64)
    return made.standard_normal((count, dimension)), offsets[:count]


def code(cells: np.ndarray) -> np.ndarray:
    """One 64-bit name for each row of cells."""
    out = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        out = mix(out + cells[..., i].astype(np.int64).view(np.uint64) + np.uint64(i + 1))
    return out.view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the scaling by a power of two is exact and avoids overflow."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    vectors = np.ldexp(vectors, -power[:, None])
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def chances(points: np.ndarray, cells: np.ndarray, offsets: np.ndarray, width: float, similarity: float) -> np.ndarray:
    """Logarithms of the chance that a neighbour's projection is in a cell. points: the query's projections; a
    neighbour's are normal with mean similarity * point and variance 1 - similarity^2."""
    sd = math.sqrt(max(1e-6, 1 - similarity * similarity))
    low = ((cells - offsets) * width - similarity * points) / sd
    return np.log(np.maximum(normal(low + width / sd) - normal(low), 1e-12))


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by a rational approximation (error under 1e-7)."""
    z = np.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def probes(point: np.ndarray, offsets: np.ndarray, width: float, similarity: float, least: float) -> np.ndarray:
    """Cells of the buckets whose estimated chance has at least the logarithm `least`, most promising first; the best
    bucket in any case."""
    reach = int(9 / width) + 1
    steps = np.arange(-reach, reach + 1)
    base = np.floor(similarity * point / width + offsets)
    cells = base[:, None] + steps
    logs = chances(point[:, None], cells, offsets[:, None], width, similarity)
    best = logs.max(axis=1)
    least = min(least, best.sum())
    # what the projections to come can add at most
    ahead = np.concatenate((np.cumsum(best[::-1])[::-1][1:], [0.0])) if len(best) else best
    names, sums = np.zeros((1, 0), np.int64), np.zeros(1)
    for own, log, more in zip(cells, logs, ahead, strict=True):
        total = sums[:, None] + log[None, :]
        r, c = np.nonzero(total + more >= least - 1e-9)
        names = np.concatenate([names[r], own[c].astype(np.int64)[:, None]], axis=1)
        sums = total[r, c]
    return names[np.lexsort((*names.T, -sums))] if names.shape[1] else names


def tuned(queries: np.ndarray, known: np.ndarray, of: np.ndarray, rows: np.ndarray, count: int) -> Plan:
    """The cheapest plan that meets RECALL on a sample. queries, known, rows: unit vectors; known[i] is one of the
    nearest of queries[of[i]]; count: rows of the table."""
    if not len(known):
        return Plan()
    # among the lowest similarities, for these are the hard ones to meet
    similarity = float(np.clip(np.quantile((queries[of] * known).sum(axis=1), 0.1), 0.05, 0.995))
    most = max(PROJECTIONS)
    dimension = queries.shape[1]
    made = [projections_of(dimension, t, most) for t in range(max(TABLES))]
    best, cost = Plan(), math.inf
    for width in WIDTHS:
        near, far = [], []
        for directions, offsets in made:
            points = queries @ directions.T
            near.append(np.cumsum(chances(points[of], np.floor(known @ directions.T / width + offsets), offsets, width, similarity), axis=1))
            cells = np.floor(rows @ directions.T / width + offsets)
            far.append(np.cumsum(chances(points[:, None, :], cells[None, :, :], offsets, width, similarity), axis=2))
        for m in PROJECTIONS:
            # cells of a projection that hold most rows
            spread = max(1.0, 4.1 / width)
            if m > 1 and spread**m * BUCKET > 4 * count:
                break
            for tables in TABLES:
                reached = np.max([x[:, m - 1] for x in near[:tables]], axis=0)
                least = float(np.sort(reached)[int((1 - RECALL) * len(reached))]) - 1e-9
                scored = sum(float((x[:, :, m - 1] >= least).mean()) for x in far[:tables]) * count
                visits = sum(len(probes(queries[i] @ made[t][0][:m].T, made[t][1][:m], width, similarity, least)) for t in range(tables) for i in range(min(4, len(queries)))) / min(4, len(queries))
                if scored + VISIT * visits < cost:
                    best, cost = Plan(tables, m, width, similarity, least), scored + VISIT * visits
    return best


def sampled(rows: DataFrame, asked: DataFrame, k: int, sizes: dict[int, int]) -> dict[int, Plan]:
    """A plan for each dimension."""
    w = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")
    first = F.row_number().over(w)
    queries = asked.withColumn("r", first).where(F.col("r") <= SAMPLE).select("vec_id", "v").toArrow()
    others = rows.withColumn("r", first).where(F.col("r") <= SAMPLE_ROWS).select("v").toArrow()

    def by_dimension(table: pa.Table) -> dict[int, np.ndarray]:
        v = table["v"].combine_chunks()
        size = v.value_lengths().to_numpy(zero_copy_only=False)
        return {int(d): (np.flatnonzero(size == d), v.take(pa.array(np.flatnonzero(size == d))).flatten().to_numpy().reshape(-1, int(d))) for d in np.unique(size)}

    names = queries["vec_id"].to_numpy()
    asked_of = {d: (names[at], unit(v)) for d, (at, v) in by_dimension(queries).items()}

    def scored(batches):
        held = {d: (np.full((len(n), k), -np.inf), np.zeros((len(n), k, d))) for d, (n, _) in asked_of.items()}
        for batch in batches:
            for d, (at, v) in by_dimension(pa.Table.from_batches([batch])).items():
                if d not in asked_of:
                    continue
                ids, own = batch["vec_id"].to_numpy()[at], unit(v)
                queries, (score, body) = asked_of[d], held[d]
                found = queries[1] @ own.T
                found[queries[0][:, None] == ids[None, :]] = -np.inf
                for i in np.flatnonzero((found > score[:, -1:]).any(axis=1)).tolist():
                    new = np.argsort(-found[i], kind="stable")[:k]
                    both = np.concatenate([score[i], found[i][new]])
                    keep = np.argsort(-both, kind="stable")[:k]
                    body[i] = np.concatenate([body[i], own[new]])[keep]
                    score[i] = both[keep]
        for d, (score, body) in held.items():
            r, c = np.nonzero(score > -np.inf)
            bodies = [body[i, j].tobytes() for i, j in zip(r, c, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), d)), pa.array(r), pa.array(score[r, c]), pa.array(bodies, pa.binary())], ["d", "q", "score", "body"])

    out = {}
    if asked_of:
        w = Window.partitionBy("d", "q").orderBy(F.desc("score"), "body")
        found = rows.mapInArrow(scored, "d long, q long, score double, body binary").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toArrow()
        d, q = found["d"].to_numpy(), found["q"].to_numpy()
        others = by_dimension(others)
        for own in asked_of:
            at = np.flatnonzero(d == own)
            order = at[np.argsort(q[at], kind="stable")]
            known = np.frombuffer(b"".join(found["body"][int(i)].as_py() for i in order), np.float64).reshape(-1, own)
            out[own] = tuned(asked_of[own][1], known, q[order], unit(others[own][1]), sizes[own])
    return {d: out.get(d, Plan()) for d in sizes}


def nearest(vectors: DataFrame, queries, id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The k nearest rows found for every row for which the condition `queries` on the id holds: query_id, rank (from
    1), vec_id, score, nearest first, ties to the smaller id."""
    rows = small_batches(vectors).select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
        " and exists(v, x -> x <> 0)"
    )
    sizes = {int(d): int(n) for d, n in rows.groupBy(F.size("v")).count().collect()}
    asked = rows.where(queries)
    plans = sampled(rows, asked, k, sizes)
    best = materialise(ranked(candidates(rows, asked, k, plans), k), "nearest")
    # whoever found too few is scored against all rows
    filled = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(filled, "vec_id", "left_anti")
    if short.isEmpty():
        return best
    more = candidates(rows, short, k, dict.fromkeys(sizes, Plan()))
    return ranked(best.select("query_id", "vec_id", "score").union(more), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query's candidates: query_id, rank, vec_id, score."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def candidates(rows: DataFrame, asked: DataFrame, k: int, plans: dict[int, Plan]) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each block of rows that a query of `asked` visits. rows and asked:
    vec_id, v."""

    def hashed(batches, probing: bool):
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            lengths = batch["v"].value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                own = batch["v"].take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                bodies = [x.tobytes() for x in own]
                units = unit(own)
                plan = plans[d]
                for t in range(plan.tables):
                    directions, offsets = projections_of(d, t, plan.projections)
                    points = units @ directions.T
                    if probing:
                        found = [code(probes(p, offsets, plan.width, plan.similarity, plan.least)) for p in points]
                        reps = np.repeat(np.arange(len(at)), [len(x) for x in found])
                        buckets = np.concatenate(found)
                    else:
                        reps = np.arange(len(at))
                        buckets = code(np.floor(points / plan.width + offsets).astype(np.int64))
                    for s in range(0, len(reps), 2048):
                        part = reps[s : s + 2048]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(part), t, np.int32)), pa.array(np.full(len(part), d, np.int32)),
                                pa.array(buckets[s : s + 2048]), pa.array(ids[at[part]]),
                                pa.array([bodies[i] for i in part], pa.binary()),
                            ],
                            ["tab", "dim", "bucket", "vec_id", "body"],
                        )

    schema = "tab int, dim int, bucket long, vec_id long, body binary"
    home = rows.mapInArrow(lambda batches: hashed(batches, False), schema)
    visits = asked.mapInArrow(lambda batches: hashed(batches, True), schema)
    bucket = ["tab", "dim", "bucket"]
    # blocks of the buckets that have more than one: rows by queries
    many = home.groupBy(bucket).count().select(*bucket, F.ceil(F.col("count") / BLOCK).alias("r_blocks"))
    many_q = visits.groupBy(bucket).count().select(*bucket, F.ceil(F.col("count") / BLOCK).alias("q_blocks"))
    grid = materialise(many.join(many_q, bucket).where("r_blocks > 1 or q_blocks > 1"), "grid")

    group = [*bucket, "r_b", "q_b"]

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        side = side.join(grid, bucket, "left")
        side = side.withColumn(own, F.expr(f"pmod(xxhash64(vec_id), coalesce({own}locks, 1L))"))
        side = side.withColumn(other, F.expr(f"explode(sequence(0L, coalesce({other}locks, 1L) - 1))"))
        return side.select(*group, "vec_id", "body")

    home, visits = dealt(home, "r_b", "q_b"), dealt(visits, "q_b", "r_b")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (ids, x), (qids, q) = (
            (t["vec_id"].to_numpy(), np.stack([np.frombuffer(b.as_py(), np.float64) for b in t["body"]]))
            for t in (left, right)
        )
        # rows of one id stand together: a place is an id's, not a row's
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        item = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        rough, out = unit(x), []
        for s in range(0, len(q), 256):
            block = unit(q[s : s + 256]) @ rough.T
            block[qids[s : s + 256][:, None] == ids[None, :]] = -np.inf
            best = np.maximum.reduceat(block, item, axis=1)
            last = min(k, best.shape[1])
            least = np.partition(best, best.shape[1] - last, axis=1)[:, best.shape[1] - last] - 1e-9
            r, c = np.nonzero((block >= least[:, None]) & (block > -np.inf))
            if not len(r):
                continue
            exact = cosines(q[s + r], x[c])
            order = np.lexsort((-exact, ids[c], r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.concatenate(([True], (r[1:] != r[:-1]) | (ids[c[1:]] != ids[c[:-1]])))
            r, c, exact = r[first], c[first], exact[first]
            order = np.lexsort((ids[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.searchsorted(r, r, "left")
            keep = np.arange(len(r)) - first < k
            out.append((qids[s + r[keep]], ids[c[keep]], exact[keep]))
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate(z) for z in zip(*out, strict=True)], schema=schema)

    return home.groupBy(group).cogroup(visits.groupBy(group)).applyInArrow(
        lambda left, right: score(left, right), "query_id long, vec_id long, score double"
    )

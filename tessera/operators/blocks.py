"""Signatures compared block by block in Arrow workers: every pair of a group, without a row for a pair that is not wanted.

A group's rows are dealt to blocks of bounded size, and a task compares two blocks. The shuffle holds a row once for each
block of its group, whatever the number of copies, and no task grows with a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of signatures, of a block; pairs that are compared, and rows that are returned, at a time.
ROWS, BYTES, PAIRS, OUT = 1 << 14, 8 << 20, 1 << 18, 1 << 16


def block_rows(size: int) -> int:
    return max(256, min(ROWS, BYTES // (8 * size)))


def usable(words: Column, size: int) -> Column:
    """Whether a signature has a distance to others: so many words, none of them null."""
    return F.coalesce((F.size(words) == size) & ~F.exists(words, lambda x: x.isNull()), F.lit(False))


def blocks_of(n: Column, limit: int) -> Column:
    """The number of blocks of a group of n rows."""
    return F.ceil(n / limit).cast("int")


def dealt(rows: DataFrame, sent: int, limit: int, both: bool = False) -> DataFrame:
    """Rows (id, words, own, n), n being the size of the group `own`, sent to the tasks (own, p, q) that need their block.
    `sent` is the sum of the rows' blocks_of(n), which tells the number of tasks.

    Groups of one block go to common tasks of about a block's size. With `both`, of two blocks the rows of p are
    compared with those of q in a task and the other way round in another."""
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    out = rows.withColumn("blocks", blocks_of(F.col("n"), limit)).withColumn("block", block)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if both:  # as p, and as q of other blocks; as both in the task of the own block
        out = out.withColumn("turned", F.explode(F.when(F.col("block") == F.col("other"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
        p = F.when(F.col("turned"), F.col("other")).otherwise(F.col("block"))
        q = F.when(F.col("turned"), F.col("block")).otherwise(F.col("other"))
    else:
        p, q = F.least("block", "other"), F.greatest("block", "other")
    bins = max(1, 8 * sent // limit)
    out = out.withColumn("p", p).withColumn("q", q)
    task = F.when(F.col("blocks") > 1, F.xxhash64("own", "p", "q")).otherwise(F.pmod(F.xxhash64("own"), F.lit(bins)))
    # more than there are tasks of full blocks, so that few share a partition
    parts = min(4096, 2 * (1 + (2 if both else 1) * sent // limit))
    keep = [c for c in rows.columns if c != "n"]
    return out.select(*keep, "p", "q", "block", task.alias("task")).repartition(parts, "task").sortWithinPartitions("task", "own", "p", "q")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (own, p, q) in turn, from batches in that order."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        own, p, q = (batch[c].to_numpy(zero_copy_only=False) for c in ("own", "p", "q"))
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = (own[a], p[a], q[a])
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def matrix(rows: pa.Table, size: int) -> np.ndarray:
    """The signatures as unsigned words; pairs of 32-bit words are one."""
    flat = pa.concat_arrays([c.flatten() for c in rows["words"].chunks]).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size).view(np.uint64)


def halved(*sides: np.ndarray) -> list[np.ndarray]:
    """Two words in one where all are of 32 bits: distances stay."""
    if all(x.shape[1] % 2 == 0 and not (x >> np.uint64(32)).any() for x in sides):
        return [x[:, 0::2] | x[:, 1::2] << np.uint64(32) for x in sides]
    return list(sides)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances of rows of x to columns of y (words by rows)."""
    out = np.bitwise_count(x[:, 0, None] ^ y[0])
    if x.shape[1] > 1:
        out = out.astype(np.uint8 if x.shape[1] < 4 else np.int32)
        for w in range(1, x.shape[1]):
            out += np.bitwise_count(x[:, w, None] ^ y[w])
    return out


def near(x: np.ndarray, y: np.ndarray, most: int, step: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, column of y, distance) of all pairs within `most`; y is words by rows. A distance over some of the words
    bounds the whole one from below, so pairs beyond `most` leave early."""
    first = distances(x[:, :step], y[:step])
    for w in range(step, x.shape[1], step):
        inside = first <= most
        left = np.count_nonzero(inside)
        if left * 8 < first.size:
            i, j = np.nonzero(inside)
            d = first[i, j].astype(np.int64)
            for at in range(w, x.shape[1], step):
                if not len(i):
                    break
                d += np.bitwise_count(x[i, at : at + step] ^ y[at : at + step, j].T).sum(axis=1, dtype=np.int64)
                stay = d <= most
                i, j, d = i[stay], j[stay], d[stay]
            return i, j, d
        first = first.astype(np.int32, copy=False)
        first += distances(x[:, w : w + step], y[w : w + step])
    i, j = np.nonzero(first <= most)
    return i, j, first[i, j].astype(np.int64)


def first_equal(x: np.ndarray, y: np.ndarray, band: int, runs: list) -> np.ndarray:
    """Of pairs of rows, those with no equal band before this one."""
    keep = np.arange(len(x))
    for run in runs[:band]:
        if not len(keep):
            break
        equal = np.ones(len(keep), bool)
        for word, bits in run:
            equal &= (x[keep, word] ^ y[keep, word]) & np.uint64(bits) == 0
        keep = keep[~equal]
    return keep


def batches_of(ids: pa.Array, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches (x, y, distance) of places and distances, some at a time."""
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= OUT:
            yield from cut_batches(ids, held)
            held, n = [], 0
    if n:
        yield from cut_batches(ids, held)


def cut_batches(ids: pa.Array, held: list) -> Iterator[pa.RecordBatch]:
    i, j, d = (np.concatenate([part[k] for part in held]) for k in range(3))
    for at in range(0, len(i), OUT):
        cut = slice(at, at + OUT)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[cut])), ids.take(pa.array(j[cut])), pa.array(d[cut].astype(np.int64))], names=["x", "y", "distance"])


def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows of block p and of block q."""
    p, q = group["p"][0].as_py(), group["q"][0].as_py()
    block = group["block"].to_numpy()
    return np.flatnonzero(block == p), np.flatnonzero(block == q)


def pairs_within(most: int, size: int, runs: list | None) -> Callable:
    """Batches (x, y, distance) of all pairs of a group within `most`. With runs (the bits of each band) a group is the rows
    of an equal band, and a pair is returned where it is the pair's first equal band."""

    def found(group, at_x, at_y):
        same = group["p"][0].as_py() == group["q"][0].as_py()
        plain = matrix(group, size)
        (every,) = halved(plain)
        band = group["band"][0].as_py() if runs else 0
        columns = np.ascontiguousarray(every[at_y].T)
        step = max(1, PAIRS // len(at_y))
        for a in range(0, len(at_x), step):
            own = at_x[a : a + step]
            least = a if same else 0  # of a block with itself the half above the diagonal
            i, j, d = near(every[own], columns[:, least:], most)
            if same:
                above = j > i
                i, j, d = i[above], j[above], d[above]
            i, j = own[i], at_y[j + least]
            if band:
                for b in range(0, len(i), 1 << 12):
                    u, v, e = i[b : b + (1 << 12)], j[b : b + (1 << 12)], d[b : b + (1 << 12)]
                    keep = first_equal(plain[u], plain[v], band, runs)
                    yield u[keep], v[keep], e[keep]
            else:
                yield i, j, d

    def rows(batches):
        for group in groups(batches):
            at_x, at_y = sides(group)
            if len(at_x) and len(at_y):
                yield from batches_of(pa.concat_arrays(group["id"].chunks), found(group, at_x, at_y))

    return rows


def nearest_of(k: int, size: int) -> Callable:
    """Batches (x, y, distance): of each row of block p the k nearest rows of another id of block q; ties to the smaller id."""

    def found(group, ids, at_x, at_y):
        (every,) = halved(matrix(group, size))
        at_y = at_y[np.argsort(ids[at_y], kind="stable")]
        columns = np.ascontiguousarray(every[at_y].T)
        step = max(1, PAIRS // len(at_y))
        for a in range(0, len(at_x), step):
            own = at_x[a : a + step]
            apart = distances(every[own], columns)
            far = np.iinfo(apart.dtype).max
            low, high = (np.searchsorted(ids[at_y], ids[own], side) for side in ("left", "right"))
            for r in np.flatnonzero(high > low):
                apart[r, low[r] : high[r]] = far
            line = np.arange(len(own))
            for _ in range(min(k, len(at_y))):
                best = apart.argmin(axis=1)
                d = apart[line, best]
                there = d < far
                yield own[there], at_y[best[there]], d[there]
                apart[line, best] = far

    def rows(batches):
        for group in groups(batches):
            at_x, at_y = sides(group)
            if len(at_x) and len(at_y):
                ids = pa.concat_arrays(group["id"].chunks)
                yield from batches_of(ids, found(group, ids.to_numpy(zero_copy_only=False), at_x, at_y))

    return rows

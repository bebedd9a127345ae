"""N-gram Jaccard join by set-relation skipping.

A document's set is its distinct k-word shingles. Two documents link when
100 * |intersection| >= percent * |union|; the result is exact.

1. A sketch of fixed size counts all shingles, so that sets are ordered from rare to frequent shingles. Any order
   common to all sets is valid; a good one keeps frequent passages out of the index.
2. Each set's prefix (|x| - ceil(t |x|) + 1 shingles) goes to inverted lists; linked sets share a prefix shingle.
   A pair is skipped unless its sizes and the positions of its shared shingle allow enough overlap.
3. Sets are classes of equal documents, so copies enter a list once.
4. In each list only the pairs of its leader (first set) are verified at first: as many pairs as the list has rows.
   From the leader's answers those of the similar sets follow: members linked to one leader are in its component,
   and the exact set differences to a common leader bound the difference of two members.
   While lists hold many pairs of different components, another leader of each takes its turn in the same way.
   At last all pairs of different components that filters and bounds leave open are verified, in blocks of the lists.

Undefined input: a null text or one without words has an empty set and is linked with nothing; a text of fewer than
k words is one shingle; repeated rows are equal sets, so they link; rows with a null key are not linked and have a
null component; an empty table gives an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, flag_by_bitmap, materialise, pieces, released, small_batches
from tessera.llm.words import mix, row_words, shingles, spaced_bytes, spans, text_buffer, word_hashes

#: log2 of the sketch's counters; broadcast as one byte each (4 MB).
SKETCH_BITS = 22
#: Counters in a row of a partial sketch.
SKETCH_CHUNK = 1 << 16
#: Sets of a list compared with one another in one group; longer lists are cut into pairs of blocks.
BLOCK = 4096
#: Open pairs of a list row, on average, from which on a further round of leaders comes first, and the most such rounds.
MANY, ROUNDS = 4, 2


#: A document's set and the lists that it is in.
INDEX = "doc_id long, n long, set_key long, parity binary, prefix array<long>"


def batch_shingles(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    starts, ends = spans(data, offsets, spaced_bytes())
    return shingles(word_hashes(data, starts, ends), row_words(starts, offsets), k)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def set_key(items: np.ndarray) -> int:
    """A name of a set of shingle hashes without their 7 lowest bits; it holds the set's size too."""
    return int((mix(items).sum(dtype=np.uint64) ^ np.uint64(len(items))).view(np.int64)) if len(items) else 0


def parity(items: np.ndarray) -> bytes:
    """A bit for each class of a set's items (as of set_key): whether their number is odd. Sets differ in at least as
    many items as their parities in bits. The classes are a power of two, twice the set's size or more, so a longer
    parity is folded to a shorter one by exclusive or of its halves."""
    m = 1 << max(6, (2 * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_gaps(parities: list[bytes], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bits that differ between the parities of pairs of rows whose sizes are within a factor of two."""
    lengths = np.array([len(x) for x in parities])
    out = np.zeros(len(r), np.int64)
    for m in np.unique(np.minimum(lengths[r], lengths[c])).tolist():
        rows = np.flatnonzero((lengths == m) | (lengths == 2 * m))
        place = np.zeros(len(lengths), np.int64)
        place[rows] = np.arange(len(rows))
        words = np.zeros((len(rows), m // 8), np.uint64)
        for i, x in enumerate(rows.tolist()):
            own = np.frombuffer(parities[x], np.uint64)
            words[i] = own if len(parities[x]) == m else own[: m // 8] ^ own[m // 8 :]
        at = np.flatnonzero((np.minimum(lengths[r], lengths[c]) == m) & (np.maximum(lengths[r], lengths[c]) <= 2 * m))
        for s in range(0, len(at), 65536):
            some = at[s : s + 65536]
            out[some] = np.bitwise_count(words[place[r[some]]] ^ words[place[c[some]]]).sum(axis=1)
    return out


def sketch(docs: DataFrame, k: int, bits: int) -> bytes:
    """For each of 2^bits hash classes of shingles, twice the binary logarithm (63 at most) of its shingles' number."""
    chunks = max(1, (1 << bits) // SKETCH_CHUNK)
    width = (1 << bits) // chunks

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for piece in pieces(batch, "text"):
                at, _ = batch_shingles(piece["text"], k)
                at = np.sort((at & np.uint64((1 << bits) - 1)).astype(np.uint32))
                if len(at):
                    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                    total[at[edge]] += np.diff(np.append(edge, len(at))).astype(np.uint32)
        for c in range(chunks):
            part = total[c * width : (c + 1) * width]
            small = np.where(part < 256, part, 0).astype(np.uint8)
            at = np.flatnonzero(small)
            # small counters as they stand or by place, whichever is shorter; large ones by place
            rows = [(b"", small.tobytes())] if 3 * len(at) > width else [(at.astype(np.uint16).tobytes(), small[at].tobytes())]
            at = np.flatnonzero(part >= 256)
            rows.append((at.astype(np.uint16).tobytes(), part[at].tobytes()))
            rows = [(c, *r) for r in rows if r[1]]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                    ["chunk", "at", "n"],
                )

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, n in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                sum_of = held.setdefault(c, np.zeros(width, np.int64))
                if at:
                    sum_of[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint8 if 2 * len(n) == len(at) else np.uint32)
                else:
                    sum_of += np.frombuffer(n, np.uint8)
        for c, total in held.items():
            level = np.minimum(np.floor(2 * np.log2(np.maximum(total, 1))), 63).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "level": [level.tobytes()]})

    parts = docs.select("text").mapInArrow(released(count), "chunk int, at binary, n binary")
    parts = parts.repartition(chunks, "chunk").mapInArrow(released(merge), "chunk int, level binary")
    out = np.zeros(1 << bits, np.uint8)
    for chunk, level in parts.collect():  # as many bytes as the sketch has counters
        out[chunk * width : (chunk + 1) * width] = np.frombuffer(level, np.uint8)
    return out.tobytes()


def prefixes(docs: DataFrame, levels: bytes, k: int, percent: int) -> DataFrame:
    """(doc_id, n, set_key, parity, prefix): a task gives the prefix of equal sets once."""

    def rows(batches):
        level = np.frombuffer(levels, np.uint8)
        mask = np.uint64(len(level) - 1)
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                items, bounds = batch_shingles(piece["text"], k)
                ranked = (level[(items & mask).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (
                    items >> np.uint64(7)
                )
                sizes, keys, odd, parts, ends = [], [], [], [], [0]
                for r in range(piece.num_rows):
                    own = distinct(ranked[bounds[r] : bounds[r + 1]])
                    plain = own & np.uint64((1 << 57) - 1)
                    n, key = len(own), set_key(plain)
                    sizes.append(n)
                    keys.append(key)
                    odd.append(parity(plain))
                    # a smaller or larger partner, or one of the same size with a shingle exchanged, must be possible
                    alone = n * 100 // percent == n and -(-percent * n // 100) == n and (n - 1) * 100 < percent * (n + 1)
                    if key not in seen and not alone:
                        if len(seen) > 1 << 20:  # what is then given twice meets again in its list
                            seen.clear()
                        seen.add(key)
                        parts.append(own[: n + percent * n // -100 + 1])
                        ends.append(ends[-1] + len(parts[-1]))
                    else:
                        ends.append(ends[-1])
                flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"],
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.int64()),
                        pa.array(odd, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))),
                    ],
                    ["doc_id", "n", "set_key", "parity", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(rows), INDEX)


def needed_overlap(n: Column, m: Column, percent: int) -> Column:
    """Smallest intersection of sets of these sizes that link."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)


def possible(n: str, pos: str, m: str, pos2: str, percent: int) -> Column:
    """Whether sets whose first common shingle is at these positions (from 0) can link."""
    n, pos, m, pos2 = (F.col(c) for c in (n, pos, m, pos2))
    sizes = F.least(n, m) * 100 >= percent * F.greatest(n, m)
    return sizes & (F.least(n - pos, m - pos2) >= needed_overlap(n, m, percent))


def lists(index: DataFrame) -> DataFrame:
    """Rows of the inverted lists of two sets or more, each with its list's leader."""
    w = Window.partitionBy("token").orderBy("set_key")
    rows = index.select("set_key", "n", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.repartition("token")  # copies that met in different tasks are neighbours in the window
    rows = rows.select(
        "*",
        F.first(F.struct("set_key", "n", "pos")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"),
        F.lag("set_key").over(w).alias("before"),
        F.lead("set_key").over(w).alias("after"),
    )
    rows = rows.where(F.col("before").isNull() | (F.col("before") != F.col("set_key")))
    rows = rows.where((F.col("lead.set_key") != F.col("set_key")) | F.col("after").isNotNull())
    rows = rows.select(
        "token", "set_key", "n", "pos", F.col("lead.set_key").alias("l_key"), F.col("lead.n").alias("l_n"),
        F.col("lead.pos").alias("l_pos"),
    )
    # what the list holds besides its leader
    every = Window.partitionBy("token")
    rest = F.when(F.col("set_key") != F.col("l_key"), F.xxhash64("set_key"))
    return rows.withColumn("members", F.count(rest).over(every)).withColumn("sets", F.bit_xor(rest).over(every))


def parities_of(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(set_key, parity) of the sets of keys; a bitmap drops most others before the shuffle."""
    rows = flag_by_bitmap(index.select("set_key", "parity"), "set_key", keys, "set_key", "maybe").where("maybe")
    return rows.select("set_key", "parity").dropDuplicates(["set_key"])


def plausible(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) of sets and their sizes whose parities differ in no more bits than linked sets can."""
    keys = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b"))
    known = materialise(parities_of(index, keys), "parities")
    rows = pairs.withColumn("most", F.col("na") + F.col("nb") - 2 * needed_overlap(F.col("na"), F.col("nb"), percent))
    rows = rows.join(known.selectExpr("set_key as b", "parity as b_parity"), "b")
    rows = rows.join(known.selectExpr("set_key as a", "parity as a_parity"), "a")

    def close(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                parities = batch["a_parity"].to_pylist() + batch["b_parity"].to_pylist()
                gaps = parity_gaps(parities, np.arange(n), np.arange(n, 2 * n))
                keep = pa.array(gaps <= batch["most"].to_numpy())
                yield batch.select(["a", "b"]).filter(keep)

    return rows.select("a", "b", "most", "a_parity", "b_parity").mapInArrow(released(close), "a long, b long")


def verified(pairs: DataFrame, index: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) of set keys with the exact sizes na, nb and overlap."""
    keys = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct()
    # one document for each set, and its text without a shuffle of texts: sets that the bitmap lets through by chance
    # meet no pair
    wanted = index.select("set_key", "doc_id").join(keys, "set_key").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    texts = flag_by_bitmap(docs.select("doc_id", "text"), "doc_id", wanted, "doc_id", "maybe").where("maybe")

    def sets(batches):
        seen = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                items, bounds = batch_shingles(piece["text"], k)
                keys, bodies = [], []
                for r in range(piece.num_rows):
                    own = distinct(items[bounds[r] : bounds[r + 1]])
                    key = set_key(distinct(own >> np.uint64(7)))
                    if len(own) and key not in seen:  # rows of one id may be equal
                        seen.add(key)
                        keys.append(key)
                        bodies.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], ["set_key", "items"])

    found = materialise(texts.select("text").mapInArrow(released(sets), "set_key long, items binary"), "sets")

    def end(name: str) -> DataFrame:
        rows = flag_by_bitmap(found, "set_key", pairs.select(name), name, "maybe").where("maybe")
        return rows.selectExpr(f"set_key as {name}", f"items as {name}_items")

    def overlaps(batches):
        for batch in batches:
            a, b = batch["a_items"], batch["b_items"]
            out = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                out.append((len(x), len(y), int((x[at] == y).sum()) if len(x) else 0))
            na, nb, n = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], *(pa.array(v, pa.int64()) for v in (na, nb, n))], ["a", "b", "na", "nb", "overlap"]
            )

    # the member's set first: it is the leader's key that can be hot, and that join can be split
    both = pairs.join(end("b"), "b")
    both = both.join(end("a"), "a")
    both = both.select("a", "b", "a_items", "b_items")
    return materialise(both.mapInArrow(released(overlaps), "a long, b long, na long, nb long, overlap long"), "verified")


def open_lists(inverted: DataFrame, percent: int) -> DataFrame:
    """The lists without their leaders that can hold further pairs: two rows or more, and of lists with the same
    sets only the one of the rarest shingle, where the positions of all its sets are lowest; of these the rows that
    can have a partner."""
    rows = inverted.where("set_key <> l_key and members > 1")
    kinds = inverted.where("set_key = l_key and members > 1").groupBy("members", "sets").agg(F.min("token").alias("token"))
    kinds = materialise(kinds.select("token"), "tokens")
    rows = flag_by_bitmap(rows, "token", kinds, "token", "maybe").where("maybe")
    rows = rows.join(kinds, "token").select("token", "members", "set_key", "n", "pos")
    return paired(rows, percent)


def paired(rows: DataFrame, percent: int, window: int = 32) -> DataFrame:
    """List rows without those that sizes and positions let link with no other of their list: in the order of sizes a
    row is compared with the next `window` rows; where more are within reach, both ends stay untested. So time is
    linear in the rows and memory is a batch and a window, whatever the length of a list."""
    names = ["token", "members", "set_key", "n", "pos"]

    def keep(batches):
        held = {c: np.zeros(0, np.int64) for c in names}
        marks = np.zeros(0, bool)
        for batch in chain(batches_of(batches), [None]):
            if batch is not None:
                held = {c: np.concatenate([held[c], batch[c]]) for c in names}
                marks = np.concatenate([marks, np.zeros(len(batch["token"]), bool)])
            total = len(marks)
            token, n, left = held["token"], held["n"], held["n"] - held["pos"]
            for d in range(1, min(window, total - 1) + 1):
                same = token[:-d] == token[d:]
                if not same.any():
                    break
                same &= n[d:] * percent <= n[:-d] * 100
                if d < window:
                    need = np.ceil(percent * (n[:-d] + n[d:]) / (100.0 + percent) - 1e-9)
                    same &= np.minimum(left[:-d], left[d:]) >= need
                marks[:-d] |= same
                marks[d:] |= same
            done = total if batch is None else max(0, total - window)
            at = np.flatnonzero(marks[:done])
            if len(at):
                yield pa.RecordBatch.from_pydict({c: held[c][at] for c in names})
            held, marks = {c: held[c][done:] for c in names}, marks[done:]

    def batches_of(batches):
        for batch in batches:
            yield {c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names}

    ordered = rows.repartition("token").sortWithinPartitions("token", "n")
    return ordered.mapInArrow(released(keep), "token long, members long, set_key long, n long, pos long")


def open_pairs(rows: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs of list members of different components that neither filters nor leaders' answers nor parities decide.

    rows: token, members, set_key, n, pos, component, near (a leader verified against the set), gap (the exact size
    of the set difference to it). Lists of one component are dropped; long lists are compared block by block.
    parities: set_key, parity.
    """
    kinds = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rows = rows.join(kinds.where("low <> high").select("token"), "token").join(parities, "set_key")
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
        "set_key", "n", "pos", "component", "near", "gap", "parity",
    )
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n")

    def compare(group: dict[str, np.ndarray], parities: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, pos, comp, key = group["n"], group["pos"], group["component"], group["set_key"]
        near, gap, own = group["near"], group["gap"], group["own"]
        cross = group["i"][0] != group["j"][0]
        found_a, found_b = [], []
        # sorted by size: the partners of a block of rows are a run that starts at its first row
        for s in range(0, len(n), 128):
            e = min(s + 128, len(n))
            to = int(np.searchsorted(n, n[e - 1] * 100 // percent, "right"))
            a, b = slice(s, e), slice(s, to)
            x, y = np.arange(s, e)[:, None], np.arange(s, to)[None, :]
            total = n[a][:, None] + n[b][None, :]
            most = np.minimum((n - pos)[a][:, None], (n - pos)[b][None, :])
            need = np.ceil(percent * total / (100.0 + percent) - 1e-9).astype(np.int64)
            ok = (x < y) & (comp[a][:, None] != comp[b][None, :]) & (most >= need)
            ok &= n[a][:, None] * 100 >= percent * n[b][None, :]
            same = near[a][:, None] == near[b][None, :]
            ok &= ~(same & (np.abs(gap[a][:, None] - gap[b][None, :]) > total - 2 * need))
            if cross:
                ok &= own[a][:, None] != own[b][None, :]
            r, c = np.nonzero(ok)
            close = parity_gaps(parities, s + r, s + c) <= (total - 2 * need)[r, c]
            found_a.append(key[s + r[close]])
            found_b.append(key[s + c[close]])
        return np.concatenate(found_a), np.concatenate(found_b)

    names = ["token", "i", "j", "own", "set_key", "n", "pos", "component", "near", "gap"]

    def walk(batches):
        held: list[dict[str, np.ndarray]] = []
        parities: list[bytes] = []

        def flush():
            if held:
                a, b = compare({c: np.concatenate([h[c] for h in held]) for c in names}, parities)
                a, b = np.minimum(a, b), np.maximum(a, b)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})
            held.clear()
            parities.clear()

        for batch in batches:
            cols = {c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
            change = np.zeros(batch.num_rows, bool)
            for c in names[:3]:
                change[1:] |= cols[c][1:] != cols[c][:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and any(held[-1][c][-1] != cols[c][s] for c in names[:3]):
                    yield from flush()
                held.append({c: cols[c][s:e] for c in names})
                parities += batch["parity"][s:e].to_pylist()
        yield from flush()

    return rows.select(*names, "parity").mapInArrow(released(walk), "a long, b long").distinct()


def with_answers(rows: DataFrame, answers: DataFrame, labels: DataFrame) -> DataFrame:
    """List rows with what is known of their sets: component, and of the verified leaders the nearest with the size of
    the set difference to it."""
    near = answers.selectExpr("b as set_key", "a as near", "na + nb - 2 * overlap as gap")
    near = near.groupBy("set_key").agg(F.min_by(F.struct("near", "gap"), F.struct("gap", "near")).alias("near"))
    known = near.join(labels.withColumnRenamed("node", "set_key"), "set_key", "full")
    known = known.select("set_key", "component", F.col("near.near").alias("near"), F.col("near.gap").alias("gap"))
    return rows.join(known, "set_key", "left").select(
        "token", "members", "set_key", "n", "pos", F.coalesce("component", "set_key").alias("component"),
        F.coalesce("near", "set_key").alias("near"), F.coalesce("gap", F.lit(0)).alias("gap"),
    )


def led_pairs(rows: DataFrame, percent: int, round: int) -> DataFrame:
    """Pairs of a leader, another in every list, with the list's members of other components: as many as rows."""
    lead = F.struct("set_key", "n", "pos", "component")
    leads = rows.groupBy("token").agg(F.min_by(lead, F.xxhash64("set_key", "token", F.lit(round))).alias("lead"))
    rows = rows.join(leads, "token").where("component <> lead.component")
    rows = rows.select("set_key", "n", "pos", F.col("lead.set_key").alias("l_key"), F.col("lead.n").alias("l_n"), F.col("lead.pos").alias("l_pos"))
    rows = rows.where(possible("n", "pos", "l_n", "l_pos", percent))
    return rows.selectExpr("l_key as a", "l_n as na", "set_key as b", "n as nb").distinct()


def ngram_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest key reachable by links)."""
    docs = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return linked(prefixes(docs, sketch(docs, k, sketch_bits), k, percent), docs, k, percent)


def linked(index: DataFrame, docs: DataFrame, k: int, percent: int, positions: bool = True) -> DataFrame:
    """The join of the sets of an index (doc_id, n, set_key, prefix: the lists that a set is in). positions: whether a
    list's place in the prefix is the place of its shingle in the set's order, which bounds the overlap."""
    index = materialise(index, "index")
    linkable = index.where("n > 0 and doc_id is not null")
    inverted = materialise(lists(linkable.where("size(prefix) > 0")), "lists")

    if not positions:
        inverted = inverted.withColumn("pos", F.lit(0)).withColumn("l_pos", F.lit(0))
    stars = inverted.where("set_key <> l_key").where(possible("n", "pos", "l_n", "l_pos", percent))
    stars = stars.selectExpr("l_key as a", "l_n as na", "set_key as b", "n as nb").distinct()
    stars = materialise(plausible(stars, index, percent), "pairs")
    link = f"100 * overlap >= {percent} * (na + nb - overlap)"
    answers = verified(stars, linkable, docs, k)
    labels = components(answers.where(link).select("a", "b"))
    lists_left, rounds, last = materialise(open_lists(inverted, percent), "open"), 0, False
    while not last:
        rows = materialise(with_answers(lists_left, answers, labels), "rows")
        # pairs of different components in a list, counted without forming them
        sizes = rows.groupBy("token", "component").count().groupBy("token")
        sizes = sizes.agg(F.sum("count").alias("n"), F.sum(F.expr("count * count")).alias("own"))
        total, crossing = sizes.agg(F.sum("n"), F.sum(F.expr("(n * n - own) / 2"))).head()
        if not crossing:
            break
        rounds += 1
        last = crossing <= MANY * total or rounds > ROUNDS
        if last:
            pairs = open_pairs(rows, parities_of(index, rows), percent)
        else:
            pairs = plausible(led_pairs(rows, percent, rounds), index, percent)
        done = answers.selectExpr("least(a, b) as a", "greatest(a, b) as b")
        pairs = pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
        pairs = materialise(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        found = verified(pairs, linkable, docs, k)
        answers = answers.unionByName(found)
        # the new links join components of the rounds before
        new = found.where(link).select("a", "b")
        for end in ("a", "b"):
            new = new.join(labels.selectExpr(f"node as {end}", "component as named"), end, "left")
            new = new.withColumn(end, F.expr(f"coalesce(named, {end})")).drop("named")
        joined = components(new.select("a", "b")).selectExpr("node as component", "component as final")
        labels = labels.join(joined, "component", "full").selectExpr(
            "coalesce(node, component) as node", "coalesce(final, component) as component"
        )
        labels = materialise(labels, "labels")

    out = linkable.select("doc_id", "n", "set_key").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
    out = out.selectExpr("doc_id", "n", "coalesce(component, set_key) as label")
    least = out.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = out.join(least, "label").selectExpr("doc_id", "n as n_shingles", "component_id")
    unlinked = index.where("n = 0 or doc_id is null").selectExpr("doc_id", "n as n_shingles", "doc_id as component_id")
    return out.union(unlinked)

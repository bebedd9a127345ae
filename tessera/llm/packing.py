"""Lexical retrieval packing.

Documents are encoded whole and end with an end id; together they fill sequences of a fixed window. The first unused
document of a shard is a seed: the shard's unused documents that share a term with it are ranked by BM25 and fill the
seed's window greedily, best first, ties in order; the last is cut where the window ends, and its rest is a seed of
the next window. A window whose seed has no further neighbours goes to the next seed. Stretches of a window's length
of a long document are windows of their own.

The index's terms are the words, all of a document's. Document frequencies are counted over the whole table, in hash
classes of words: an array of fixed size. Shards are made by content, not by the input's partitions: classes are put in
one random order in which a class of weight idf comes first with a chance in proportion to it, and a document is dealt
by its first class and, within it, by its first one in a second such order. Two documents thus meet with the chance of
their idf-weighted Jaccard similarity at least, wherever they lie. Neighbours in another shard are not found: the price
of work in proportion to the input. First classes are dealt to shards of about SHARD ids in slots of consecutive places;
a slot that holds more is dealt by the second class in SUBS parts, and a part that still holds more than SHARD (a group
of copies, say) is spread evenly over shards. The tables for that have at most a row for each slot and part.

Every id is in exactly one piece. What is left of each shard, under a window, is put together from GROUP shards at a
time in a second step; only the last window of each such group can stay partly filled, and it is cut into sequences
whose lengths are powers of two, the lengths that need no padding.

A null text is empty and is one end id. Repeated rows are packed each. Rows with a null id are packed like others. An
empty table gives an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chat import default_ranks, ranks_encoding
from tessera.llm.common import materialise, pieces, process_cache, released, small_batches
from tessera.llm.words import alnum_bytes, mix, row_words, spans, text_buffer, word_hashes

WINDOW = 2048
#: The id after each document, as the contract sets it.
END_ID = 1
#: Ids of a shard, the parts of a frequent slot, the documents of one index, and the shards whose rests are put together.
SHARD, SUBS, RUN_DOCS, GROUP = 1 << 20, 16, 2048, 512
#: Bits of a word's hash, hash classes of words, and slots of places in the order of classes; texts without words have a
#: slot of their own.
HASH_BITS, CLASS_BITS, SLOT_BITS = 32, 20, 16
CLASSES, SLOTS = 1 << CLASS_BITS, (1 << SLOT_BITS) + 1
#: BM25's constants.
K1, B = 1.2, 0.75
SPECIAL = "<|endoftext|>"

TOKENS = "doc_id long, n long, crc long, lead int, second int, salt long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [column.split()[0] for column in PIECES.split(", ")]


def class_of(words: np.ndarray) -> np.ndarray:
    return words >> np.uint32(HASH_BITS - CLASS_BITS)


class Index:
    """The BM25 weights of a run of documents: `words` are their words' hashes, `bounds` each one's first word."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean: float):
        docs, lengths = len(bounds) - 1, np.diff(bounds)
        known, words = np.unique(words, return_inverse=True)
        shift = np.uint64(max(1, int(docs).bit_length()))
        keys, tf = np.unique((words.astype(np.uint64) << shift) | np.repeat(np.arange(docs, dtype=np.uint64), lengths), return_counts=True)
        # sorted by term, then by document
        term, doc = (keys >> shift).astype(np.int64), (keys & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        norm = K1 * (1 - B + B * lengths / mean)
        weight = (idf[class_of(known)][term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        df = np.bincount(term, minlength=len(known))
        # the terms of many documents are a matrix, whose products with itself are made at once; the others are lists
        common = np.flatnonzero(df > max(8, docs // 16))
        column = np.full(len(known), -1, np.int64)
        column[common] = np.arange(len(common))
        dense = column[term] >= 0
        matrix = np.zeros((docs, len(common)), np.float32)
        matrix[doc[dense], column[term[dense]]] = weight[dense]
        self.common = (matrix > 0).astype(np.float32) @ matrix.T
        rare = ~dense & (df[term] > 1) & (weight > 0)
        term, self.doc, self.weight = term[rare], doc[rare], weight[rare]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(known)))))
        order = np.argsort(self.doc, kind="stable")
        self.query = term[order]
        self.begin = np.searchsorted(self.doc[order], np.arange(docs + 1))
        self.docs = docs

    def scores(self, doc: int) -> np.ndarray:
        own = self.query[self.begin[doc] : self.begin[doc + 1]]
        first = self.start[own]
        sizes = self.start[own + 1] - first
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.common[doc] + np.bincount(self.doc[at], self.weight[at], self.docs)

    def neighbours(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the document, best first, ties in order."""
        scores = np.round(self.scores(doc), 3)
        hits = np.flatnonzero(unused & (scores > 0))
        low = np.partition(scores[hits], -64)[-64] if len(hits) > 64 else 0
        for part in (hits[scores[hits] >= low], hits[scores[hits] < low]):
            yield from part[np.argsort(-scores[part], kind="stable")].tolist()


def packed(sizes: list[int], index: Index, window: int = WINDOW) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows and the last one, each a list of pieces (document, start, length)."""
    full: list[list[tuple[int, int, int]]] = []
    rest = [n % window for n in sizes]
    taken = [n - r for n, r in zip(sizes, rest, strict=True)]
    for d, n in enumerate(taken):
        full.extend([(d, s, window)] for s in range(0, n, window))
    unused = np.array(rest) > 0
    current: list[tuple[int, int, int]] = []
    space, seed, cursor = window, None, 0
    while True:
        if seed is None:
            while cursor < len(sizes) and not unused[cursor]:
                cursor += 1
            if cursor == len(sizes):
                return full, current
            seed = cursor
        queue, at, following = None, seed, None
        while at is not None:
            n = min(rest[at], space)
            current.append((at, taken[at], n))
            taken[at] += n
            rest[at] -= n
            unused[at] = rest[at] > 0
            space -= n
            if not space:
                full.append(current)
                current, space = [], window
                following = at if rest[at] else None
                break
            queue = queue or index.neighbours(seed, unused)
            at = next((x for x in queue if unused[x]), None)
        seed = following


def by_powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A partly filled window cut into sequences whose lengths are powers of two, longest first."""
    left = sum(n for _, _, n in window)
    out, todo = [], list(window)
    while left:
        space = 1 << (left.bit_length() - 1)
        left -= space
        own = []
        while space:
            d, s, n = todo.pop(0)
            m = min(n, space)
            own.append((d, s, m))
            space -= m
            if n > m:
                todo.insert(0, (d, s + m, n - m))
        out.append(own)
    return out


def joined(rests: list[tuple[int, int, int]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Pieces put together in their order: full windows, and powers of two of what is left."""
    out: list[list] = []
    own: list = []
    space = window
    for d, start, n in rests:
        while n:
            m = min(n, space)
            own.append((d, start, m))
            start, n, space = start + m, n - m, space - m
            if not space:
                out.append(own)
                own, space = [], window
    return out + by_powers(own)


def encoder(ranks: tuple[str, str], json_path: str):
    """Texts to ids of the tokenizer of the JSON file. The rank file holds the same vocabulary and gives the same ids
    in a fraction of the time; texts with the special token's string go through the tokenizer itself."""
    fast = ranks_encoding(*ranks)

    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            ids = process_cache(("tokenizer", json_path), slow).encode(text, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(text)
        return np.array([*ids, END_ID], np.uint32)

    return encode


def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the rank file's pieces in the order of their ids, and where each begins (one more than ids)."""
    with open(path, "rb") as file:
        known = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, file)}
    table = [known.get(i, SPECIAL.encode()) for i in range(max(known) + 2)]
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in table])))


def decoded(ids: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts whose n ids (with the end id) stand one after another, and where each begins."""
    data, start = table
    sizes = np.diff(start)[ids]
    ends = np.cumsum(n)
    sizes[ends - 1] = 0
    to = np.cumsum(sizes)
    at = np.repeat(start[ids] - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0)
    return data[at], np.concatenate(([0], to[ends - 1]))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts and where each text's begin."""
    starts, ends = spans(data, offsets, alnum_bytes())
    return (word_hashes(data, starts, ends) >> np.uint64(64 - HASH_BITS)).astype(np.uint32), row_words(starts, offsets)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """In how many documents words of each class stand; the number of documents and of words."""

    def counts(batches):
        df, documents, total = np.zeros(CLASSES, np.int64), 0, 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, bounds = words_of(*text_buffer(piece["text"]))
                row = np.repeat(np.arange(piece.num_rows, dtype=np.uint64), np.diff(bounds))
                keys = np.unique((row << np.uint64(CLASS_BITS)) | class_of(words).astype(np.uint64))
                df += np.bincount((keys & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                documents, total = documents + piece.num_rows, total + len(words)
        at = np.flatnonzero(df)
        for s in range(0, len(at), 1 << 16):
            part = at[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(df[part])], ["class", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([documents, total])], ["class", "n"])

    table = docs.select("text").mapInArrow(released(counts), "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    at, n = table["class"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(CLASSES, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at == -1].sum()), int(n[at == -2].sum())


def class_orders(idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two random orders of the classes: each class's place. With exponential times of rate idf the first of some
    classes is each of them with a chance in proportion to its idf."""
    out = []
    for seed in (1, 2):
        u = (mix(np.arange(CLASSES, dtype=np.uint64) + np.uint64(seed << 32)) >> np.uint64(11)).astype(np.float64) / 2**53
        times = -np.log1p(-u) / np.maximum(idf, 1e-9)
        place = np.empty(CLASSES, np.int32)
        place[np.argsort(times, kind="stable")] = np.arange(CLASSES)
        out.append(place)
    return out[0], out[1]


def salts(doc_id: pa.Array) -> np.ndarray:
    """A number of each row by its id and, for repeated ids, by its turn in the batch."""
    ids = doc_id.fill_null(-1).to_numpy()
    order = np.argsort(ids, kind="stable")
    turn = np.empty(len(ids), np.int64)
    turn[order] = np.arange(len(ids)) - np.searchsorted(ids[order], ids[order], "left")
    return (mix(mix(ids.astype(np.uint64)) + turn.astype(np.uint64)) >> np.uint64(2)).astype(np.int64)


def encoded(docs: DataFrame, idf, json_path: str, ranks: tuple[str, str]) -> DataFrame:
    """Each document's ids in two bytes each, and the places of its first classes in the two orders."""

    name = uuid.uuid4().hex

    def rows(batches):
        encode = encoder(ranks, json_path)
        orders = process_cache("orders", dict)
        if name not in orders:
            orders.clear()
            orders[name] = class_orders(idf.value)
        orders = orders[name]
        for batch in batches:
            salt = salts(batch["doc_id"])
            done = 0
            for piece in pieces(batch, "text"):
                words, bounds = words_of(*text_buffer(piece["text"]))
                some = np.flatnonzero(np.diff(bounds))
                places = []
                for order in orders:
                    place = np.full(piece.num_rows, CLASSES, np.int32)
                    if len(some):
                        place[some] = np.minimum.reduceat(order[class_of(words)], bounds[:-1][some])
                    places.append(pa.array(place))
                ids = [encode(text.as_py() or "").astype("<u2") for text in piece["text"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), *places,
                        pa.array(salt[done : done + piece.num_rows]), pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    [column.split()[0] for column in TOKENS.split(", ")],
                )
                done += piece.num_rows

    return docs.mapInArrow(released(rows), TOKENS)


def dealt(tokens: DataFrame, shard: int) -> DataFrame:
    """tokens with a shard: slots of few ids share shards, in a row; a frequent slot's parts have shards of their own."""
    spark = tokens.sparkSession
    tokens = tokens.withColumn("slot", F.expr(f"cast(shiftright(lead, {CLASS_BITS - SLOT_BITS}) as long)")).withColumn("sub", F.expr(f"pmod(xxhash64(second), {SUBS})"))
    table = tokens.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS, np.int64)
    total[table["slot"].to_numpy()] = table["n"].to_numpy()
    hot = total > shard
    light = np.where(hot, 0, total)
    home = (np.cumsum(light) - light) // shard
    at = np.flatnonzero(light)
    homes = spark.createDataFrame(pa.table([pa.array(at), pa.array(home[at])], ["slot", "home"]), "slot long, home long")
    parts = pa.table([pa.array([], pa.int64())] * 3, ["slot", "sub", "n"])
    if hot.any():
        frequent = spark.createDataFrame(pa.table([pa.array(np.flatnonzero(hot))], ["slot"]))
        parts = tokens.join(F.broadcast(frequent), "slot").groupBy("slot", "sub").agg(F.sum("n").alias("n")).toArrow().sort_by([("slot", "ascending"), ("sub", "ascending")])
    number = -(-parts["n"].to_numpy() // shard)
    begin = int(home.max()) + 1 + np.cumsum(number) - number
    own = spark.createDataFrame(pa.table([parts["slot"], parts["sub"], pa.array(begin, pa.int64()), pa.array(number, pa.int64())], ["slot", "sub", "begin", "parts"]), "slot long, sub long, begin long, parts long")
    out = tokens.join(F.broadcast(homes), "slot", "left").join(F.broadcast(own), ["slot", "sub"], "left")
    return out.select(F.expr("coalesce(home, begin + salt % parts)").alias("shard"), "lead", "second", "crc", "doc_id", "ids")


def piece_batch(rows: list[tuple], rests: list | None = None) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(rests or [None] * len(rows), pa.binary())], [*NAMES, "ids"])


def filled(shards: DataFrame, idf, mean: float, path: str) -> DataFrame:
    """The pieces of each shard; those of its last windows carry their ids."""

    def run(names: list, ids: list[np.ndarray], first: int) -> tuple[int, list[pa.RecordBatch]]:
        table = process_cache(("vocabulary", path), lambda: vocabulary(path))
        words, bounds = [], [np.zeros(1, np.int64)]
        for s in range(0, len(ids), 256):
            part = ids[s : s + 256]
            own, at = words_of(*decoded(np.concatenate(part), np.array([len(x) for x in part]), table))
            words.append(own)
            bounds.append(at[1:] + bounds[-1][-1])
        index = Index(np.concatenate(words), np.concatenate(bounds), idf.value, mean)
        full, last = packed([len(x) for x in ids], index)
        wide = [memoryview(x.astype("<u4").tobytes()) for x in ids]
        rows, rests = [], []
        for i, window in enumerate([*full, last]):
            offset = 0
            for d, start, n in window:
                own = wide[d][4 * start : 4 * (start + n)]
                rows.append((names[d], start, n, zlib.crc32(own), len(ids[d]), first + i, offset))
                rests.append(bytes(own) if i == len(full) else None)
                offset += n
        return first + len(full) + 1, [piece_batch(rows[s : s + 8192], rests[s : s + 8192]) for s in range(0, len(rows), 8192)]

    def rows(batches):
        shard, names, ids, tokens, number = None, [], [], 0, 0
        for batch in batches:
            for own, name, x in zip(batch["shard"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                if ids and (own != shard or len(ids) >= RUN_DOCS or tokens >= 2 * SHARD):
                    number, out = run(names, ids, number)
                    yield from out
                    names, ids, tokens = [], [], 0
                if own != shard:
                    shard, number = own, own << 32
                names.append(name)
                ids.append(np.frombuffer(x.as_py(), "<u2"))
                tokens += len(ids[-1])
        if ids:
            yield from run(names, ids, number)[1]

    return shards.select("shard", "doc_id", "ids").mapInArrow(released(rows), f"{PIECES}, ids binary")


def put_together(table: pa.Table) -> pa.Table:
    """The rests of a group of shards as sequences."""
    table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    rows = table.select(NAMES).to_pylist()
    ids = [x.as_buffer() for x in table["ids"].combine_chunks()] if rows else []
    first = 1 << 62 | (rows[0]["sequence_id"] >> 32) // GROUP << 32
    out = []
    for i, window in enumerate(joined([(d, 0, r["length"]) for d, r in enumerate(rows)])):
        offset = 0
        for d, start, n in window:
            r = rows[d]
            out.append((r["doc_id"], r["start"] + start, n, zlib.crc32(memoryview(ids[d])[4 * start : 4 * (start + n)]), r["doc_tokens"], first + i, offset))
            offset += n
    return pa.Table.from_batches([piece_batch(out)]).select(NAMES)


def pack(docs: DataFrame, json_path: str | None = None, ranks: tuple[str, str] | None = None, shard: int = SHARD) -> DataFrame:
    """The pieces of all rows of (doc_id, text): doc_id, start (the document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (in its sequence)."""
    ranks = ranks or default_ranks()
    if json_path is None:
        import public_tokenizers

        json_path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df, number, words = frequencies(docs)
    if not number:
        return spark.createDataFrame([], PIECES)
    idf = spark.sparkContext.broadcast(np.log1p((number - df + 0.5) / (df + 0.5)).astype(np.float32))
    tokens = materialise(encoded(docs, idf, json_path, ranks), "tokens")
    total = tokens.agg(F.sum("n")).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * shard)))
    shards = dealt(tokens, shard).repartition(tasks, "shard").sortWithinPartitions("shard", "lead", "second", "doc_id", "crc")
    out = materialise(filled(shards, idf, max(1.0, words / number), ranks[0]), "pieces")
    rests = out.where("ids is not null").groupBy(F.expr(f"shiftright(sequence_id, 32) div {GROUP}")).applyInArrow(put_together, PIECES)
    return out.where("ids is null").select(NAMES).unionByName(rests)

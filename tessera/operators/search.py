"""Similarity search over signatures and vectors.

Every search is exact: cheap predicates that cannot lose a row come first. Ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fp, vectors
from tessera.functions.response import mexican_hat
from tessera.operators import blocks
from tessera.session import materialise


def top_k(df: DataFrame, distance: Column, key: str, k: int, name: str = "distance") -> DataFrame:
    """The k rows of the smallest distance: partial top-k lists of the partitions, merged."""
    return df.withColumn(name, distance).orderBy(name, key).limit(k)


def top_k_batch(
    rows: DataFrame, queries: DataFrame, distance: Column, key: str, query_key: str, k: int, name: str = "distance"
) -> DataFrame:
    """For each query row its k nearest; queries are broadcast only if small enough for the planner."""
    pairs = rows.crossJoin(queries).withColumn(name, distance)
    w = Window.partitionBy(query_key).orderBy(name, key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within(df: DataFrame, words: str, query: Column, most: int, pops: str | None = None) -> DataFrame:
    """Rows at a distance of at most `most`; with a column of popcounts their difference, a lower bound, comes first."""
    if pops:
        df = df.where(F.abs(F.col(pops) - fp.popcount(query)) <= most)
    return df.withColumn("distance", fp.hamming(F.col(words), query)).where(F.col("distance") <= most)


def bands(words: str, bits: int, count: int, word_bits: int = fp.WORD_BITS) -> list[Column]:
    """The signature cut into so many disjoint bit runs; runs of over 63 bits are runs of words, by their hashes."""
    size = bits // word_bits
    if bits > 63 * count:
        edges = [round(i * size / count) for i in range(count + 1)]
        return [F.xxhash64(F.slice(words, s + 1, e - s)) for s, e in zip(edges[:-1], edges[1:], strict=True)]
    edges = [round(i * bits / count) for i in range(count + 1)]
    out = []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        value = F.lit(0).cast("long")
        at = s
        while at < e:
            w, o = divmod(at, word_bits)
            n = min(e - at, word_bits - o)
            mask = (1 << n) - 1 if n < 64 else -1
            part = F.shiftrightunsigned(F.element_at(words, w + 1), o).bitwiseAND(F.lit(mask).cast("long"))
            value = value.bitwiseOR(F.shiftleft(part, at - s))
            at += n
        out.append(value)
    return out


def band_array(words: str, bits: int, count: int, word_bits: int = fp.WORD_BITS) -> Column:
    """The bands() as an array; runs of words are cut in a loop, as code for each of hundreds would be too long to compile."""
    if bits <= 63 * count:
        return F.array(*bands(words, bits, count, word_bits))
    edges = [round(i * (bits // word_bits) / count) for i in range(count + 1)]
    return F.transform(F.lit(edges[:-1]), lambda s, i: F.xxhash64(F.slice(words, s + 1, F.element_at(F.lit(edges[1:]), i + 1) - s)))


def band_bits(bits: int, count: int, word_bits: int = fp.WORD_BITS) -> list[list[tuple[int, int]]]:
    """Of each of the bands() its words, from 0, and which of their bits it holds."""
    size = bits // word_bits
    if bits > 63 * count:
        edges = [round(i * size / count) for i in range(count + 1)]
        return [[(w, (1 << 64) - 1) for w in range(s, e)] for s, e in zip(edges[:-1], edges[1:], strict=True)]
    edges = [round(i * bits / count) for i in range(count + 1)]
    out = []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        whole = (1 << e) - (1 << s)
        out.append([(w, whole >> w * word_bits & (1 << word_bits) - 1) for w in range(s // word_bits, (e - 1) // word_bits + 1)])
    return out


def similarity_join(df: DataFrame, key: str, words: str, most: int, bits: int = fp.WIDTH, word_bits: int = fp.WORD_BITS) -> DataFrame:
    """All pairs (a, b, distance) with a < b and a distance of at most `most`.

    Of most + 1 disjoint bands at least one is equal, so the join on bands loses no pair. A pair is made in its first
    equal band only, so no step has to remove duplicates. Where so short bands leave more than a hundredth of all pairs,
    all are compared, block by block. Ids of signatures of over 256 bits are unique."""
    if bits < 4 * (most + 1):
        raise ValueError("bands of under four bits hardly filter: use wider signatures")
    weak = (most + 1) * 100 > 2 ** (bits / (most + 1))
    if weak or bits > 256:
        size = bits // word_bits
        limit = blocks.block_rows(size)
        rows = df.select(F.col(key).alias("id"), F.col(words).alias("words")).where(F.col("id").isNotNull() & blocks.usable(F.col("words"), size))
        kind = rows.schema["id"].dataType.simpleString()
        if weak:
            runs, total = None, rows.count()
            rows, sent = rows.withColumn("own", F.lit(0).cast("long")).withColumn("n", F.lit(total)), total * -(-total // limit)
        else:
            runs = band_bits(bits, most + 1, word_bits)
            members = band_groups(rows, band_array("words", bits, most + 1, word_bits))
            sent = members.agg(F.sum(blocks.blocks_of(F.col("n"), limit))).head()[0] or 0
            rows = members.join(rows, "id")
        found = blocks.dealt(rows, sent, limit).mapInArrow(blocks.pairs_within(most, size, runs), f"x {kind}, y {kind}, distance long")
        return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    every = bands(words, bits, most + 1, word_bits)
    pops = fp.popcount(F.col(words))
    rows = df.select(
        F.col(key).alias("id"), F.col(words).alias("words"), pops.alias("pops"), F.array(*every).alias("all_bands"),
        F.posexplode(F.array(*every)).alias("band", "value"),
    )
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id")))
    pairs = pairs.where(F.abs(F.col("a.pops") - F.col("b.pops")) <= most)
    first = F.array_position(F.zip_with("a.all_bands", "b.all_bands", lambda x, y: x == y), True) - 1
    pairs = pairs.where(first == F.col("a.band"))
    distance = fp.hamming(F.col("a.words"), F.col("b.words"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.alias("distance")).where(F.col("distance") <= most)


def band_groups(rows: DataFrame, every: Column) -> DataFrame:
    """(id, own, n, band): the rows of each group `own` of n rows with an equal band. Of groups of the same rows only that
    of the first band is there: rows that share many bands meet once. That they are the same is told by their number and
    sums of two hashes of 64 bits."""
    runs = rows.select("id", F.posexplode(every).alias("band", "value"))
    hashes = [F.xxhash64("id", F.lit(seed)) for seed in (1, 2)]
    sums = [F.sum(part).alias(f"s{i}") for i, part in enumerate(p for h in hashes for p in (h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32)))]
    groups = runs.groupBy("band", "value").agg(F.count("*").alias("n"), *sums).where("n > 1")
    first = groups.groupBy("n", "s0", "s1", "s2", "s3").agg(F.min(F.struct("band", "value")).alias("first"))
    kept = materialise(first.select(F.monotonically_increasing_id().alias("own"), "n", "first.band", "first.value"), "groups")
    return materialise(runs.join(kept, ["band", "value"]).select("id", "own", "n", "band"), "members")


def nearest(df: DataFrame, key: str, words: str, k: int, bits: int = fp.WIDTH, word_bits: int = fp.WORD_BITS) -> DataFrame:
    """(a, b, distance, rank): each row's k nearest of other ids, all compared block by block; ties to the smaller id."""
    size = bits // word_bits
    rows = df.select(F.col(key).alias("id"), F.col(words).alias("words")).where(F.col("id").isNotNull() & blocks.usable(F.col("words"), size))
    kind = rows.schema["id"].dataType.simpleString()
    limit, total = blocks.block_rows(size), rows.count()
    rows = rows.withColumn("own", F.lit(0).cast("long")).withColumn("n", F.lit(total))
    found = blocks.dealt(rows, total * -(-total // limit), limit, both=True).mapInArrow(blocks.nearest_of(k, size), f"x {kind}, y {kind}, distance long")
    rank = F.row_number().over(Window.partitionBy("x").orderBy("distance", "y"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("x").alias("a"), F.col("y").alias("b"), "distance", "rank")


def hat_search(df: DataFrame, words: str, query: Column, key: str, k: int, excite: int, inhibit: int) -> DataFrame:
    """Rows with a positive response, strongest first."""
    response = mexican_hat(fp.hamming(F.col(words), query), excite, inhibit)
    return df.withColumn("response", response).where("response > 0").orderBy(F.desc("response"), key).limit(k)


def staged(df: DataFrame, words: str, query: Column, samples: list[tuple[int, int, int]], most: int) -> DataFrame:
    """A sampling cascade: (first word, words, limit) stages before the exact distance. Unlike all else here a stage
    can lose rows; the limits are the caller's."""
    for first, count, limit in samples:
        df = df.where(fp.masked_hamming(F.col(words), query, first, count) <= limit)
    return df.withColumn("distance", fp.hamming(F.col(words), query)).where(F.col("distance") <= most)


def near_join(
    left: DataFrame, left_id: str, left_words: str, right: DataFrame, right_id: str, right_words: str, most: int, bits: int = fp.WIDTH,
    word_bits: int = fp.WORD_BITS,
) -> DataFrame:
    """(left_id, right_id, distance) of all pairs of two tables at a distance of at most `most`. Of most + 1 disjoint bands
    one at least is equal, so the join on bands loses no pair; signatures are joined to the pairs afterwards. Ids are
    unique and differ in name."""

    def runs(df, key, words):
        return df.select(F.col(key), F.posexplode(F.array(*bands(words, bits, most + 1, word_bits))).alias("band", "value"))

    if bits < 4 * (most + 1):
        raise ValueError("bands of under four bits hardly filter: use wider signatures")
    pairs = runs(left, left_id, left_words).join(runs(right, right_id, right_words), ["band", "value"]).select(left_id, right_id).distinct()
    pairs = pairs.join(left.select(left_id, F.col(left_words).alias("near_a")), left_id).join(right.select(right_id, F.col(right_words).alias("near_b")), right_id)
    pairs = pairs.withColumn("distance", fp.hamming(F.col("near_a"), F.col("near_b"))).where(F.col("distance") <= most)
    return pairs.select(left_id, right_id, "distance")


def bound_retrieval(
    edges: DataFrame, key: str, known: str, verb: str, ends: DataFrame, end_key: str, end_words: str, most: int, bits: int = fp.WIDTH,
    word_bits: int = fp.WORD_BITS,
) -> DataFrame:
    """(key, end_key, distance): ends that an edge's signature `edge` gives when the known end and the verb are unbound."""
    unbound = fp.bind(fp.bind(F.col("edge"), F.col(known)), F.col(verb))
    return near_join(edges.withColumn("unbound", unbound), key, "unbound", ends, end_key, end_words, most, bits, word_bits)


def deep_field(df: DataFrame, words: str, query: Column, radius: int, width: int, least: int = 3) -> DataFrame:
    """The query moved by the majority of the differences of a ring of rows; empty with fewer rows than `least`."""
    ring = df.where(fp.hamming(F.col(words), query).between(radius - width, radius + width))
    moves = fp.bundle(ring.withColumn("words", fp.bind(F.col(words), query)), [], "words")
    return moves.where(F.col("n") >= least).select(fp.bind(F.col("words"), query).alias("words"), "n")


def cleanup(df: DataFrame, words: str, codebook: DataFrame, code_key: str, code_words: str, key: str, least: float = 0.5) -> DataFrame:
    """Each row's most similar entry of a codebook, if similar enough. A codebook is small by nature; the planner
    checks its size before broadcasting it."""
    best = F.struct(fp.similarity(F.col(words), F.col(code_words)).alias("similarity"), F.col(code_key))
    pairs = df.crossJoin(codebook.select(code_key, code_words)).withColumn("best", best)
    w = Window.partitionBy(key).orderBy(F.desc("best.similarity"), f"best.{code_key}")
    pairs = pairs.withColumn("r", F.row_number().over(w)).where((F.col("r") == 1) & (F.col("best.similarity") >= least))
    return pairs.select(key, F.col(f"best.{code_key}").alias(code_key), F.col("best.similarity").alias("similarity"))


def vector_top_k(df: DataFrame, vector: str, query: Column, key: str, k: int, metric: str = "cosine") -> DataFrame:
    return top_k(df, vectors.vector_distance(F.col(vector), query, metric), key, k)


def hybrid(
    df: DataFrame, score: Column, key: str, *, label: str | None = None, contains: str | None = None, between=None,
    offset: int = 0, limit: int = 10,
) -> DataFrame:
    """Rows by score with label substring, without case, and (column, low, high) filters, then a page."""
    if contains is not None:
        df = df.where(F.contains(F.lower(F.col(label)), F.lit(contains.lower())))
    if between:
        df = df.where(F.col(between[0]).between(*between[1:]))
    return df.withColumn("score", score).orderBy(F.desc("score"), key).offset(offset).limit(limit)


def light_meter(a: Column, b: Column, sampled) -> tuple[Column, Column]:
    """Mean and standard deviation of the differing bits of sampled words."""
    each = [F.bit_count(F.element_at(a, w + 1).bitwiseXOR(F.element_at(b, w + 1))).cast("double") for w in sampled]
    n = float(len(each))
    mean = sum(each[1:], each[0]) / n
    squares = [F.pow(x - mean, F.lit(2.0)) for x in each]
    return mean, F.sqrt(sum(squares[1:], squares[0]) / n)


def container_cascade(
    df: DataFrame, words: str, query: Column, key: str, sampled, size: int, *, estimate: float, differing: int, most: int,
    excite: int, inhibit: int, k: int, word_bits: int = 64,
) -> DataFrame:
    """An estimate from sampled words, the number of differing words, the exact distance and its response; the k nearest.
    The first stage can lose rows, as its limit is on an estimate."""
    mean, _ = light_meter(F.col(words), query, sampled)
    rows = df.where(mean * float(size * word_bits) / float(word_bits) <= estimate)
    differ = F.aggregate(F.zip_with(words, query, lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, x: t + x)
    rows = rows.where(differ <= differing).withColumn("distance", fp.hamming(F.col(words), query)).where(F.col("distance") <= most)
    return rows.withColumn("response", mexican_hat(F.col("distance"), excite, inhibit)).orderBy("distance", key).limit(k)


def scent_index(df: DataFrame, words: str) -> DataFrame:
    """df with scent, five bytes as a number, and chunk, its first byte: a table laid out by chunk is read in part."""
    def byte(i: int) -> Column:
        positions = F.sequence(F.lit(i), F.size(words) * 8 - 1, F.lit(5))
        return F.aggregate(
            positions, F.lit(0).cast("long"),
            lambda t, p: t.bitwiseXOR(F.call_function("shiftrightunsigned", F.element_at(words, F.floor(p / 8).cast("int") + 1), (p % 8 * 8).cast("int")).bitwiseAND(F.lit(255).cast("long"))),
        )

    parts = F.array(*(byte(i) for i in range(5)))
    out = df.withColumn("scent_bytes", parts)
    scent = F.aggregate(F.reverse("scent_bytes"), F.lit(0).cast("long"), lambda t, x: F.shiftleft(t, 8).bitwiseOR(x))
    return out.withColumn("scent", scent).withColumn("chunk", F.col("scent_bytes")[0]).drop("scent_bytes")


def scent_lookup(index: DataFrame, scent: int, chunk_most: int, most: int) -> DataFrame:
    """Rows of near chunks whose scents are within a distance: the list of chunks, of 256, is made in the program."""
    chunks = [c for c in range(256) if (c ^ (scent & 255)).bit_count() <= chunk_most]
    distance = F.bit_count(F.col("scent").bitwiseXOR(F.lit(scent))).cast("long")
    return index.where(F.col("chunk").isin(chunks)).withColumn("distance", distance).where(F.col("distance") <= most)


def styled(df: DataFrame, words: str, query: Column, key: str, k: int, width: int, turn: Column | None = None) -> DataFrame:
    """The k best by similarity; in the creative style a row's turn, modulo 7, adds up to 0.006."""
    rows = df.withColumn("distance", fp.hamming(F.col(words), query))
    score = 1.0 - F.col("distance") / float(width)
    if turn is not None:
        score = score + 0.1 * ((turn % 7) / 100.0)
    return rows.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def explore(df: DataFrame, words: str, query: Column, feature: Column, key: str, k: int, width: int) -> DataFrame:
    """0.6 of content similarity and 0.4 of a feature's closeness, over the 2 k nearest by content."""
    near = df.withColumn("distance", fp.hamming(F.col(words), query)).orderBy("distance", key).limit(2 * k)
    score = 0.6 * (1.0 - F.col("distance") / float(width)) + 0.4 * feature
    return near.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def synthesize(df: DataFrame, words: str, feature: str, positive: str, negative: str, word_bits: int = fp.WORD_BITS) -> DataFrame:
    """One row: the majority of the signatures, the mean feature, and the truth of all evidence together."""
    from tessera.functions import truth

    rows = df.withColumn("all", F.lit(0))
    rest = rows.groupBy("all").agg(F.avg(feature).alias("feature"), F.sum(positive).alias("p"), F.sum(negative).alias("n"))
    return fp.bundle(rows, ["all"], words, word_bits=word_bits).select("all", words).join(rest, "all").select(
        words, "feature", truth.from_evidence(F.col("p"), F.col("n")).alias("truth")
    )


def sampling_cascade(df: DataFrame, words: str, query: Column, most: int, size: int, word_bits: int = 64, stages=((16, 3.0), (4, 2.0))) -> DataFrame:
    """Stages of (a part of the words, standard deviations of margin), then the exact distance. A stage keeps a row whose
    estimate is within the margin that sampling makes likely; rows beyond it are lost with a small probability."""
    share = most / float(size * word_bits)
    for part, margin in stages:
        count = max(1, size // part)
        spread = part * (count * word_bits * share * (1 - share)) ** 0.5
        df = df.where(fp.masked_hamming(F.col(words), query, 0, count) * part <= most + margin * spread)
    return df.withColumn("distance", fp.hamming(F.col(words), query)).where(F.col("distance") <= most)


def capped_cascade(df: DataFrame, words: str, query: Column, key: str, differing: int, capped: int, most: int, k: int) -> DataFrame:
    """Number of differing words, sum of their bits with at most 15 each, exact distance; the k nearest."""
    each = F.zip_with(words, query, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(each, F.lit(0), lambda t, x: t + (x > 0).cast("int"))
    sums = F.aggregate(each, F.lit(0), lambda t, x: t + F.least(x, F.lit(15)))
    rows = df.where(differ <= differing).where(sums <= capped).withColumn("distance", fp.hamming(F.col(words), query))
    return rows.where(F.col("distance") <= most).orderBy("distance", key).limit(k)


def combined(df: DataFrame, words: str, query: Column, width: int, excite: int, inhibit: int) -> DataFrame:
    """df with distance, similarity and response."""
    rows = df.withColumn("distance", fp.hamming(F.col(words), query))
    return rows.withColumn("similarity", 1.0 - F.col("distance") / float(width)).withColumn("response", mexican_hat(F.col("distance"), excite, inhibit))


def intuit(df: DataFrame, qualia: str, query: Column, key: str, k: int, excite: float = 0.3, inhibit: float = 0.8) -> DataFrame:
    """The k strongest positive responses of qualia."""
    rows = df.withColumn("score", vectors.resonance(F.col(qualia), query, excite, inhibit)).where("score > 0")
    return rows.orderBy(F.desc("score"), key).limit(k)


def associate(df: DataFrame, qualia: str, query: Column, key: str, k: int) -> DataFrame:
    """The k most similar qualia."""
    return df.withColumn("score", vectors.cosine(F.col(qualia), query)).orderBy(F.desc("score"), key).limit(k)


def by_quale(df: DataFrame, qualia: str, name: str, low: float, high: float, key: str, k: int) -> DataFrame:
    """The first k by key whose quale of a name is in a range."""
    value = F.element_at(qualia, vectors.QUALIA.index(name) + 1)
    return df.where(value.between(low, high)).withColumn("score", value.cast("double")).orderBy(key).limit(k)


def contradicting(df: DataFrame, qualia: str, query: Column, f: Column, query_f: Column) -> DataFrame:
    """Rows of the opposite valence, or doubtful ones where the query is held true; score: unlikeness of qualia."""
    at = vectors.QUALIA.index("valence") + 1
    apart = F.abs(F.element_at(qualia, at) - F.element_at(query, at)) > 1.5
    rows = df.where(apart | ((query_f > 0.7) & (f < 0.3)))
    return rows.withColumn("score", 1.0 - vectors.cosine(F.col(qualia), query))


def extrapolated(sequence: list[Column]) -> Column:
    """The signature after a sequence: its last one and the sum of all steps."""
    out = sequence[-1]
    for a, b in zip(sequence[:-1], sequence[1:], strict=True):
        out = fp.bind(out, fp.bind(a, b))
    return out


def fan_out(store: DataFrame, axis: str, value: Column, radius: int, k: int) -> DataFrame:
    """The first k records, by id, of which an axis is near."""
    return store.withColumn("distance", fp.hamming(F.col(axis), value)).where(F.col("distance") <= radius).orderBy("id").limit(k)


def schema_filter(df: DataFrame, level: str, kind: str, bloom: str, least: int | None = None, wanted: int | None = None, holds: int | None = None) -> DataFrame:
    """Cheap predicates before any distance: level, kind, and a Bloom filter that may hold an id."""
    if least is not None:
        df = df.where(F.col(level) >= least)
    if wanted is not None:
        df = df.where(F.col(kind) == wanted)
    if holds is not None:
        bits = F.lit(bloom_bits(holds)).cast("long")
        df = df.where(F.col(bloom).bitwiseAND(bits) == bits)
    return df


def bloom_bits(id: int) -> int:
    """The two bits of an id among 60."""
    return 1 << (id * 7 % 60) | 1 << (id * 13 % 60)


def bloom_of(ids: Column) -> Column:
    """The filter of an array of ids."""
    one = lambda i, by: F.call_function("shiftleft", F.lit(1).cast("long"), (i * by % 60).cast("int"))
    return F.aggregate(ids, F.lit(0).cast("long"), lambda t, i: t.bitwiseOR(one(i, 7)).bitwiseOR(one(i, 13)))

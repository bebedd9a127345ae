"""Binary signatures as array<bigint> columns: every operation is a column expression.

A signature of n bits is n / word_bits words; word_bits is 32 by default, so that words are non-negative and mean the
same in other engines. With word_bits = 64 words use all bits of a bigint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64
WORD_BITS = 32


def _long(x) -> Column:
    return F.lit(x).cast("long")


def sign_words(vector: Column, bits: int = WIDTH, word_bits: int = WORD_BITS) -> Column:
    """Signature of the signs of a vector: bit i is set if component i is positive."""

    def word(first: int) -> Column:
        def put(acc, j):
            bit = F.call_function("shiftleft", _long(1), j)
            return F.when(F.element_at(vector, j + first + 1) > 0, acc.bitwiseOR(bit)).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.lit(word_bits - 1)), _long(0), put)

    return F.array(*(word(i) for i in range(0, bits, word_bits)))


def hash_words(text: Column, words: int = 2) -> Column:
    """Signature of a text's content: 32-bit words of md5 digests."""
    return F.array(
        *(F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{i}"))), 1, 8), 16, 10).cast("long") for i in range(words))
    )


def popcount(a: Column) -> Column:
    return F.aggregate(a, _long(0), lambda acc, x: acc + F.bit_count(x))


def bind(a: Column, b: Column) -> Column:
    """Exclusive or; its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def inverted(a: Column, word_bits: int = WORD_BITS) -> Column:
    mask = _long(-1 if word_bits == 64 else (1 << word_bits) - 1)
    return F.transform(a, lambda x: x.bitwiseXOR(mask))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ; null if either is null."""
    return popcount(bind(a, b))


def similarity(a: Column, b: Column, width: int = WIDTH) -> Column:
    return 1.0 - hamming(a, b) / float(width)


def density(a: Column, width: int = WIDTH) -> Column:
    return popcount(a) / float(width)


def masked_hamming(a: Column, b: Column, first_word: int, words: int) -> Column:
    """Distance over a run of words, from 0."""
    return hamming(F.slice(a, first_word + 1, words), F.slice(b, first_word + 1, words))


def permute(a: Column, n: int, words: int = 2, word_bits: int = WORD_BITS) -> Column:
    """Rotation of the whole bit string: bit i moves to (i + n) modulo the width; negative n rotates back."""
    n %= words * word_bits
    q, r = divmod(n, word_bits)

    def turned(k: int) -> Column:
        """Word i moves to word i + k."""
        k %= words
        return F.concat(F.slice(a, words - k + 1, k), F.slice(a, 1, words - k)) if k else a

    if not r:
        return turned(q)
    mask = _long(-1 if word_bits == 64 else (1 << word_bits) - 1)
    return F.zip_with(
        turned(q), turned(q + 1), lambda low, high: F.shiftleft(low, r).bitwiseOR(F.shiftrightunsigned(high, word_bits - r)).bitwiseAND(mask)
    )


def permute_by(a: Column, n: Column, words: int = 2, word_bits: int = WORD_BITS) -> Column:
    """permute() by a number of the row's own."""
    turn = F.pmod(n.cast("int"), F.lit(words * word_bits))
    q, r = F.floor(turn / word_bits).cast("int"), turn % word_bits
    mask = _long(-1 if word_bits == 64 else (1 << word_bits) - 1)

    def word(k):
        low, high = (F.element_at(a, F.pmod(k - q - d, F.lit(words)) + 1) for d in (0, 1))
        moved = F.call_function("shiftleft", low, r).bitwiseOR(F.call_function("shiftrightunsigned", high, word_bits - r))
        return F.when(r == 0, low).otherwise(moved.bitwiseAND(mask))

    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def sequence(df: DataFrame, keys: list[str], order: list[str], words: str, count: int = 2, word_bits: int = WORD_BITS) -> DataFrame:
    """One signature for each ordered group: item i turned by i, all bundled."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = df.select(*keys, words, turn.alias("turn")).withColumn(words, permute_by(F.col(words), F.col("turn"), count, word_bits))
    return bundle(rows, keys, words, word_bits=word_bits)


def fold(a: Column, words: int = 2) -> Column:
    """Half the width: exclusive or of the two halves."""
    half = words // 2
    return F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def extended(a: Column, words: int) -> Column:
    """Zero-extended to so many words, or cut to them."""
    return F.slice(F.concat(a, F.array_repeat(_long(0), words)), 1, words)


def scent(a: Column, words: int = 2, word_bits: int = WORD_BITS) -> Column:
    """Five bytes as a 40-bit number: byte i of the signature is xored into byte i modulo 5."""
    each = word_bits // 8
    out = _long(0)
    for i in range(words * each):
        byte = F.shiftrightunsigned(F.element_at(a, i // each + 1), 8 * (i % each)).bitwiseAND(_long(255))
        out = out.bitwiseXOR(F.shiftleft(byte, 8 * (i % 5)))
    return out


def scent_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def nibbles(a: Column, words: int = 2, word_bits: int = WORD_BITS) -> Column:
    """Histogram of the 16 values of the signature's 4-bit groups."""
    groups = [
        F.shiftrightunsigned(F.element_at(a, w + 1), 4 * g).bitwiseAND(_long(15))
        for w in range(words)
        for g in range(word_bits // 4)
    ]
    every = F.array(*groups)
    return F.transform(F.sequence(_long(0), _long(15)), lambda v: F.size(F.filter(every, lambda x: x == v)).cast("long"))


def histogram_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), _long(0), lambda acc, x: acc + x)


def bundle(
    df: DataFrame, keys: list[str], words: str, order: str | None = None, word_bits: int = WORD_BITS
) -> DataFrame:
    """Majority of the bits by group: a bit is set if it is in more than half of the signatures. On a tie it is that of
    the first signature by `order`, or 0 without an order. Counts are partial sums by group and word."""
    first = F.struct(order, words) if order else F.struct(words)
    rows = df.select(*keys, F.posexplode(words).alias("at", "word"), (first if order else F.lit(None)).alias("lead"))
    count = [
        F.sum(F.shiftrightunsigned("word", j).bitwiseAND(_long(1))).alias(f"b{j}") for j in range(word_bits)
    ]
    sums = rows.groupBy(*keys, "at").agg(F.count("*").alias("n"), F.min("lead").alias("lead"), *count)
    out = _long(0)
    for j in range(word_bits):
        bit = F.shiftleft(_long(1), j)
        on = F.col(f"b{j}") * 2 > F.col("n")
        if order:
            lead = F.shiftrightunsigned(F.element_at(f"lead.{words}", F.col("at") + 1), j).bitwiseAND(_long(1)) == 1
            on = on | ((F.col(f"b{j}") * 2 == F.col("n")) & lead)
        out = out.bitwiseOR(F.when(on, bit).otherwise(_long(0)))
    parts = sums.select(*keys, F.struct("at", out.alias("word")).alias("part"), "n")
    whole = F.transform(F.array_sort(F.collect_list("part")), lambda p: p.word)
    return parts.groupBy(*keys).agg(whole.alias(words), F.max("n").alias("n"))


def combined(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """Exclusive or of all signatures of a group, word by word: a store's hash, or a parity block."""
    rows = df.select(*keys, F.posexplode(words).alias("at", "word"))
    sums = rows.groupBy(*keys, "at").agg(F.bit_xor("word").alias("word"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda p: p.word)
    return sums.groupBy(*keys).agg(whole.alias(words))


def sparse(a: Column) -> Column:
    """Only the words that are not 0, by their place."""
    every = F.transform(a, lambda x, i: F.struct(i.alias("at"), x.alias("word")))
    return F.map_from_entries(F.filter(every, lambda e: e.word != 0))


def sparse_bind(a: Column, b: Column) -> Column:
    """Exclusive or of sparse signatures."""
    places = F.array_union(F.map_keys(a), F.map_keys(b))
    value = lambda m, i: F.coalesce(F.try_element_at(m, i), _long(0))
    every = F.transform(places, lambda i: F.struct(i.alias("at"), value(a, i).bitwiseXOR(value(b, i)).alias("word")))
    return F.map_from_entries(F.filter(every, lambda e: e.word != 0))


def sparse_hamming(a: Column, b: Column) -> Column:
    return popcount(F.map_values(sparse_bind(a, b)))


#: SQL names of the functions above and of the evidence rules, as expression-bodied functions.
SQL_FUNCTIONS = {
    "hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT": "aggregate(zip_with(a, b, (x, y) -> x ^ y), 0L, (t, x) -> t + bit_count(x))",
    "hamming_distance(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT": "aggregate(zip_with(a, b, (x, y) -> x ^ y), 0L, (t, x) -> t + bit_count(x))",
    "similarity(a ARRAY<BIGINT>, b ARRAY<BIGINT>, width INT) RETURNS DOUBLE": "1D - aggregate(zip_with(a, b, (x, y) -> x ^ y), 0L, (t, x) -> t + bit_count(x)) / width",
    "popcount(a ARRAY<BIGINT>) RETURNS BIGINT": "aggregate(a, 0L, (t, x) -> t + bit_count(x))",
    "xor_bind(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS ARRAY<BIGINT>": "zip_with(a, b, (x, y) -> x ^ y)",
    "scent_distance(a BIGINT, b BIGINT) RETURNS BIGINT": "CAST(bit_count(a ^ b) AS BIGINT)",
    "nars_deduction(f1 DOUBLE, c1 DOUBLE, f2 DOUBLE, c2 DOUBLE) RETURNS STRUCT<f DOUBLE, c DOUBLE>": "named_struct('f', f1 * f2, 'c', f1 * f2 * c1 * c2)",
    "nars_induction(f1 DOUBLE, c1 DOUBLE, f2 DOUBLE, c2 DOUBLE) RETURNS STRUCT<f DOUBLE, c DOUBLE>": "named_struct('f', f2, 'c', least(0.99D, f2))",
    "nars_abduction(f1 DOUBLE, c1 DOUBLE, f2 DOUBLE, c2 DOUBLE) RETURNS STRUCT<f DOUBLE, c DOUBLE>": "named_struct('f', f1, 'c', least(0.99D, f1))",
    "nars_revision(f1 DOUBLE, c1 DOUBLE, f2 DOUBLE, c2 DOUBLE) RETURNS STRUCT<f DOUBLE, c DOUBLE>": (
        "named_struct('f', (least(c1, 0.999D) / (1 - least(c1, 0.999D)) * f1 + least(c2, 0.999D) / (1 - least(c2, 0.999D)) * f2)"
        " / (least(c1, 0.999D) / (1 - least(c1, 0.999D)) + least(c2, 0.999D) / (1 - least(c2, 0.999D))),"
        " 'c', least(0.99D, (least(c1, 0.999D) / (1 - least(c1, 0.999D)) + least(c2, 0.999D) / (1 - least(c2, 0.999D)))"
        " / (least(c1, 0.999D) / (1 - least(c1, 0.999D)) + least(c2, 0.999D) / (1 - least(c2, 0.999D)) + 1)))"
    ),
}


def register(spark: SparkSession) -> None:
    """Names for SQL text: temporary functions with expression bodies, which the optimizer inlines."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

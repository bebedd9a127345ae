"""Shape features of signatures, distances of phases, and the encoding of two numbers and a text into a signature's regions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fp
from tessera.functions.operations import bound_once, literal, text_words, total

#: Runs of words over which the variance of set bits is taken. Fixed values.
BLOCKS = (1, 4, 16, 64)
#: Upper bounds of the shares of structure that make the levels 0 to 8. Fixed values.
RUNGS = (0.05, 0.10, 0.18, 0.28, 0.38, 0.50, 0.62, 0.75, 0.88)
#: First and last (exclusive) bits of the regions. Fixed values.
REGIONS = {"tau": (0, 3333), "sigma": (3334, 6667), "quality": (6667, 10000)}


def _variance(values: Column, n: int) -> Column:
    return bound_once(total(values) / float(n), lambda m: total(F.transform(values, lambda x: (x - m) * (x - m))) / float(n))


def features(a: Column, words: int) -> Column:
    """struct of eight numbers from 0 to 1 of a signature of 64-bit words."""
    width = words * 64

    def made(pops):
        every = total(pops)

        def entropy(n):
            shares = F.transform(pops, lambda x: F.when(x > 0, -(x / n) * F.log(x / n)).otherwise(0.0))
            return F.when(n > 0, total(shares) / F.log(F.lit(float(words)))).otherwise(0.0)

        def uneven(size, count):
            sums = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: total(F.slice(pops, b * size + 1, F.lit(size))))
            return F.sqrt(bound_once(sums, lambda s: _variance(s, count))) / float(64 * size)

        def depth():
            levels = [(level, size) for level, size in enumerate(BLOCKS, 1) if words // size >= 2]
            return sum((level * uneven(size, words // size) for level, size in levels), F.lit(0.0)) / float(sum(level for level, _ in levels))

        half = words // 2
        front, back = F.slice(pops, 1, half), F.slice(F.reverse(pops), 1, half)
        dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
        ends = F.sqrt(dot(front, front) * dot(back, back))
        return F.struct(
            bound_once(every, entropy).alias("entropy"), (every / float(width)).alias("density"), depth().alias("depth"),
            F.sqrt(dot(pops, pops) / float(words * 64 * 64)).alias("energy"), F.when(ends > 0, dot(front, back) / ends).otherwise(0.5).alias("symmetry"),
        )

    pops = F.transform(a, lambda x: F.bit_count(x).cast("double"))
    inner = total(F.transform(a, lambda x: F.bit_count(x.bitwiseXOR(F.shiftrightunsigned(x, 1))).cast("double")))
    pairs = F.zip_with(F.slice(a, 1, words - 1), F.slice(a, 2, words - 1), lambda x, y: F.shiftrightunsigned(x, 63).bitwiseXOR(y.bitwiseAND(F.lit(1).cast("long"))).cast("double"))
    turns = (inner + total(pairs)) / float(width - 1)
    return F.struct(bound_once(pops, made).alias("counts"), F.least(turns, F.lit(1.0)).alias("bridges"), clustering(a, words).alias("clustering"), turns.alias("complexity"))


def clustering(a: Column, words: int) -> Column:
    """Spread of the gaps between set bits against the mean gap that their number makes expect; at most 1."""
    bit = lambda p: F.call_function("shiftrightunsigned", F.element_at(a, F.floor(p / 64).cast("int") + 1), p % 64).bitwiseAND(F.lit(1).cast("long"))
    places = F.filter(F.sequence(F.lit(0), F.lit(words * 64 - 1)), lambda p: bit(p) == 1)

    def made(p):
        n = F.size(p)
        gaps = F.zip_with(F.slice(p, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: (x - y).cast("double"))

        def spread(g):
            count = F.size(g).cast("double")
            variance = bound_once(total(g) / count, lambda m: total(F.transform(g, lambda x: (x - m) * (x - m))) / count)
            expected = words * 64.0 / n
            return F.least(F.sqrt(variance / (expected * expected + 1.0)), F.lit(1.0))

        return F.when(n > 2, bound_once(gaps, spread)).otherwise(0.0)

    return bound_once(places, made)


def rung(depth: Column) -> Column:
    """Level 0 to 9 of a depth."""
    out = F.lit(9)
    for level in reversed(range(9)):
        out = F.when(depth < RUNGS[level], level).otherwise(out)
    return out


# ---- phases: arrays of numbers from 0 to 1
def wasserstein(a: Column, b: Column) -> Column:
    """Mean gap of the sorted values."""
    gaps = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x - y))
    return total(gaps) / F.size(a)


def circular(a: Column, b: Column) -> Column:
    """Mean of the way between two phases around the circle, 0 to 0.5."""
    gaps = F.zip_with(a, b, lambda x, y: F.least(F.abs(x - y), 1.0 - F.abs(x - y)))
    return total(gaps) / F.size(a)


def phase_histogram(a: Column, b: Column, bins: int = 16) -> Column:
    """Half the difference of the shares of equal bins, 0 to 1."""
    at = lambda v: F.transform(v, lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int"))
    share = lambda v: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(at(v), lambda x: x == i)) / F.size(v))
    return total(F.zip_with(share(a), share(b), lambda x, y: F.abs(x - y))) / 2.0


def carrier(a: Column, b: Column) -> Column:
    """How far the mean directions of two sets of phases are apart, as a part of half a turn."""
    two_pi = 6.283185307179586

    def direction(v):
        return F.atan2(total(F.transform(v, lambda x: F.sin(x * two_pi))), total(F.transform(v, lambda x: F.cos(x * two_pi))))

    gap = F.abs(direction(a) - direction(b))
    return F.least(gap, two_pi - gap) / (two_pi / 2)


# ---- two numbers and a text
def basis(name: str) -> list[float]:
    """Numbers from -1 to 1, the same in every program, one for each bit of a region."""
    first, last = REGIONS[name]
    return [int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:8], 16) / 2**31 - 1 for i in range(last - first)]


def signed_word(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def region_words(value: Column, name: str, words: int) -> Column:
    """A bit of the region is set if its basis number is below the value: near values give near signatures."""
    first, last = REGIONS[name]
    # each word's bits in the order in which a growing value sets them: their number tells which are set
    steps = {w: [] for w in range(first // 64, (last - 1) // 64 + 1)}
    for x, place in sorted((x, first + i) for i, x in enumerate(basis(name))):
        steps[place // 64].append((x, place % 64))
    table = [
        {"limits": [x for x, _ in own], "held": [signed_word(sum(1 << bit for _, bit in own[:n])) for n in range(len(own) + 1)]} for own in steps.values()
    ]
    each = F.from_json(F.lit(json.dumps(table)), "array<struct<limits: array<double>, held: array<bigint>>>")
    none = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    own = bound_once(value, lambda v: F.transform(each, lambda w: F.element_at(w.held, F.size(F.filter(w.limits, lambda x: x < v)) + 1)))
    return F.slice(F.concat(none(min(steps)), own, none(words)), 1, words)


def mask(name: str, words: int) -> list[int]:
    first, last = REGIONS[name]
    out = []
    for w in range(words):
        low, high = max(first - 64 * w, 0), min(last - 64 * w, 64)
        bits = (1 << high) - (1 << low) if high > low else 0
        out.append(signed_word(bits))
    return out


def encode(tau: Column, sigma: Column, text: Column, words: int = 157) -> Column:
    """tau from -1 to 1, sigma from 0 to 1, and a text, each in a region of its own."""
    said = fp.both(text_words(text, words), literal(mask("quality", words)))
    return fp.either(fp.either(region_words(tau, "tau", words), region_words(sigma * 2.0 - 1.0, "sigma", words)), said)


def decode(a: Column, words: int = 157) -> Column:
    """struct<tau, sigma> from the share of set bits of the regions; the text cannot be read back."""

    def share(name):
        first, last = REGIONS[name]
        return fp.popcount(fp.both(a, literal(mask(name, words)))) / float(last - first)

    return F.struct((share("tau") * 2.0 - 1.0).alias("tau"), share("sigma").alias("sigma"))

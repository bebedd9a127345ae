"""Operators on signatures as objects: apply, adjoint, composition, commutator, expectation and variance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fp


@dataclass(frozen=True)
class Op:
    """A function of signatures with its adjoint's; words and word_bits say how wide they are."""

    forward: Callable[[Column], Column]
    backward: Callable[[Column], Column]
    words: int = 2
    word_bits: int = fp.WORD_BITS

    @property
    def width(self) -> int:
        return self.words * self.word_bits

    def apply(self, a: Column) -> Column:
        return self.forward(a)

    def adjoint(self) -> Op:
        return Op(self.backward, self.forward, self.words, self.word_bits)

    def then(self, other: Op) -> Op:
        return Op(lambda a: other.forward(self.forward(a)), lambda a: self.backward(other.backward(a)), self.words, self.word_bits)

    def plus(self, other: Op) -> Op:
        """Exclusive or of two results."""
        return Op(lambda a: fp.bind(self.forward(a), other.forward(a)), lambda a: fp.bind(self.backward(a), other.backward(a)), self.words, self.word_bits)

    def tensor(self, other: Op) -> Op:
        """Each on its half of the words."""
        half = self.words // 2

        def both(f, g):
            return lambda a: F.concat(F.slice(f(a), 1, half), F.slice(g(a), half + 1, self.words - half))

        return Op(both(self.forward, other.forward), both(self.backward, other.backward), self.words, self.word_bits)

    def commutator(self, other: Op, a: Column) -> Column:
        return fp.bind(other.apply(self.apply(a)), self.apply(other.apply(a)))

    def commutes(self, other: Op, a: Column) -> Column:
        return fp.density(self.commutator(other, a), self.width) < 0.01

    def expectation(self, a: Column) -> Column:
        return fp.similarity(a, self.apply(a), self.width)

    def variance(self, a: Column) -> Column:
        once, twice = self.expectation(a), self.expectation(self.apply(a))
        return F.abs(twice - once * once)


def identity(words: int = 2, word_bits: int = fp.WORD_BITS) -> Op:
    return Op(lambda a: a, lambda a: a, words, word_bits)


def negate(words: int = 2, word_bits: int = fp.WORD_BITS) -> Op:
    f = lambda a: fp.inverted(a, word_bits)
    return Op(f, f, words, word_bits)


def bind(key: Column, words: int = 2, word_bits: int = fp.WORD_BITS) -> Op:
    f = lambda a: fp.bind(a, key)
    return Op(f, f, words, word_bits)


def permute(n: int, words: int = 2, word_bits: int = fp.WORD_BITS) -> Op:
    return Op(lambda a: fp.permute(a, n, words, word_bits), lambda a: fp.permute(a, -n, words, word_bits), words, word_bits)


def project(onto: Column, words: int = 2, word_bits: int = fp.WORD_BITS) -> Op:
    """Only the bits of a signature; its own adjoint, with no way back."""
    f = lambda a: fp.both(a, onto)
    return Op(f, f, words, word_bits)


def hadamard(words: int = 2, word_bits: int = fp.WORD_BITS) -> Op:
    """Every other bit flipped, so that any state is half way to itself; its own adjoint."""
    mask = int("55" * (word_bits // 8), 16)
    f = lambda a: F.transform(a, lambda x: x.bitwiseXOR(F.lit(mask).cast("long")))
    return Op(f, f, words, word_bits)


def measure(a: Column, states: Column, width: int) -> Column:
    """Of an array of structs with `words` the most similar to a signature, the first of equal ones."""
    best = F.array_max(F.transform(states, lambda s, i: F.struct(fp.similarity(a, s.words, width).alias("similarity"), (-i).alias("turn"))))
    return F.element_at(states, 1 - best.turn)

"""Evidence-based truth values: frequency f and confidence c as columns, results as struct<f, c>.

nars_* are the rules of the SQL functions, truth_* those of truth values, weak_* those through evidence weights; the
three families differ on purpose. Confidence is clamped under 1 where it becomes evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZON = 1.0
MOST = 0.99
#: Confidence above which no more evidence is counted: that of a thousand observations.
FULL = 1.0 - 1.0 / (HORIZON + 1000.0)
GATES = {"open": (0.0, 0.0), "strong": (0.7, 0.5), "certain": (0.9, 0.8)}


def truth(f: Column, c: Column) -> Column:
    return F.struct(f.cast("double").alias("f"), c.cast("double").alias("c"))


def evidence(t: Column) -> tuple[Column, Column]:
    """Positive and negative evidence."""
    c = F.least(t.c, F.lit(FULL))
    w = HORIZON * c / (1.0 - c)
    return w * t.f, w * (1.0 - t.f)


def from_evidence(positive: Column, negative: Column) -> Column:
    total = positive + negative
    some = total > 0
    return truth(
        F.when(some, positive / total).otherwise(0.5), F.when(some, total / (total + HORIZON)).otherwise(0.0)
    )


def expectation(t: Column) -> Column:
    return t.c * (t.f - 0.5) + 0.5


def truth_revision(a: Column, b: Column) -> Column:
    (p, n), (q, m) = evidence(a), evidence(b)
    return from_evidence(p + q, n + m)


def truth_negation(a: Column) -> Column:
    return truth(1.0 - a.f, a.c)


def truth_deduction(a: Column, b: Column) -> Column:
    return truth(a.f * b.f, a.c * b.c * a.f * b.f)


def truth_induction(a: Column, b: Column) -> Column:
    return truth(b.f, a.f * a.c * b.c)


def truth_abduction(a: Column, b: Column) -> Column:
    return truth(a.f, b.f * a.c * b.c)


def truth_analogy(a: Column, b: Column) -> Column:
    return truth(a.f * b.f, a.c * b.c * b.f)


def truth_comparison(a: Column, b: Column) -> Column:
    f = a.f * b.f / F.greatest(a.f + b.f - a.f * b.f, F.lit(2.0**-23))
    return truth(f, a.c * b.c * f)


def truth_intersection(a: Column, b: Column) -> Column:
    return truth(a.f * b.f, a.c * b.c)


def truth_union(a: Column, b: Column) -> Column:
    return truth(1.0 - (1.0 - a.f) * (1.0 - b.f), a.c * b.c)


def nars_deduction(a: Column, b: Column) -> Column:
    return truth(a.f * b.f, a.f * b.f * a.c * b.c)


def nars_induction(a: Column, b: Column) -> Column:
    return truth(b.f, F.least(F.lit(MOST), b.f))


def nars_abduction(a: Column, b: Column) -> Column:
    return truth(a.f, F.least(F.lit(MOST), a.f))


def nars_revision(a: Column, b: Column) -> Column:
    w, v = (F.least(t.c, F.lit(0.999)) / (1.0 - F.least(t.c, F.lit(0.999))) for t in (a, b))
    return truth((w * a.f + v * b.f) / (w + v), F.least(F.lit(MOST), (w + v) / (w + v + 1.0)))


def weak_induction(a: Column, b: Column) -> Column:
    w = b.f * a.c * b.c
    return truth(a.f, w / (w + HORIZON))


def weak_abduction(a: Column, b: Column) -> Column:
    w = a.f * a.c * b.c
    return truth(b.f, w / (w + HORIZON))


RULES = {
    "deduction": truth_deduction,
    "induction": truth_induction,
    "abduction": truth_abduction,
    "analogy": truth_analogy,
    "comparison": truth_comparison,
}


def by_rule(rule: Column, a: Column, b: Column) -> Column:
    """The rule that a column names; null for an unknown name."""
    out = F.lit(None)
    for name, made in RULES.items():
        out = F.when(rule == name, made(a, b)).otherwise(out)
    return out


def gate(t: Column, name: str = "open") -> Column:
    f, c = GATES[name]
    return (t.f >= f) & (t.c >= c)


def choice(a: Column, b: Column) -> Column:
    """That of higher expectation; the first on a tie."""
    return F.when(expectation(a) >= expectation(b), a).otherwise(b)


#: Share of confidence that a substitution leaves, and a doubt about what depends on a belief. Fixed values.
SUBSTITUTED, DOUBTED, COMFORTABLE = 0.7, 0.5, 0.3


def challenges(t: Column) -> Column:
    """array of struct<kind, f, c, survives, strength>: the opposite claim, a substitute, a doubt, pressure and comfort."""
    against = truth_negation(t)
    doubted = truth(t.f, t.c * DOUBTED)
    genuine, pressure = t.f * t.c, t.f * (1.0 - t.c)
    ambiguity = 1.0 - F.abs(2.0 * t.f - 1.0)

    def made(kind, f, c, survives, strength):
        return F.struct(F.lit(kind).alias("kind"), f.alias("f"), c.alias("c"), survives.alias("survives"), strength.alias("strength"))

    return F.array(
        made("negation", against.f, against.c, expectation(t) > expectation(against), expectation(against)),
        made("substitution", 1.0 - t.f, t.c * SUBSTITUTED, t.c > 0.5, 1.0 - t.c),
        made("dependency", doubted.f, doubted.c, expectation(doubted) > 0.5, F.abs(expectation(t) - expectation(doubted))),
        made("weather", genuine, t.c, genuine > pressure, pressure),
        made("comfort", t.f, t.c * (1.0 - ambiguity), ambiguity * t.c < COMFORTABLE, ambiguity * t.c),
    )


def robustness(t: Column) -> Column:
    """Share of the challenges' strength that a belief survives; 1 if there is none."""
    every = challenges(t)
    strength = F.aggregate(every, F.lit(0.0), lambda a, x: a + x.strength)
    survived = F.aggregate(every, F.lit(0.0), lambda a, x: a + F.when(x.survives, x.strength).otherwise(0.0))
    return F.when(strength > 0, survived / strength).otherwise(1.0)


def robust(t: Column) -> Column:
    """Whether a belief survives four challenges of the five."""
    return F.size(F.filter(challenges(t), lambda x: x.survives)) >= 4


def dispersion_gate(sd: Column) -> Column:
    return F.when(sd < 0.15, "flow").when(sd > 0.35, "block").otherwise("hold")


def capped_sum(c: Column, d: Column) -> Column:
    """A store's own revision of confidences."""
    return F.least(F.lit(MOST), c + d)

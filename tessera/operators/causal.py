"""Causal lookups on an edge table (state, action, outcome, weight, kind: see, do or imagine), and discrete models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(edges: DataFrame, state=None, action=None, kind: str = "do") -> DataFrame:
    """What follows from doing (or having done) an action in a state."""
    out = edges.where(F.col("kind") == kind)
    for name, value in (("state", state), ("action", action)):
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    return out


def causes(edges: DataFrame, outcome, state=None) -> DataFrame:
    out = edges.where((F.col("kind") == "do") & (F.col("outcome") == F.lit(outcome)))
    return out if state is None else out.where(F.col("state") == F.lit(state))


def confounders(edges: DataFrame, first, second) -> DataFrame:
    """States that lead to both outcomes."""
    a, b = (edges.where(F.col("outcome") == F.lit(o)).select("state") for o in (first, second))
    return a.join(b.distinct(), "state", "left_semi").distinct()


def treatment_effect(edges: DataFrame, keys: list[str], treated, control, weight: str = "weight") -> DataFrame:
    """Mean weight of the treated less that of the controls; null if either is missing."""
    mean = [F.avg(F.when(F.col("action") == F.lit(x), F.col(weight))) for x in (treated, control)]
    return edges.groupBy(*keys).agg((mean[0] - mean[1]).alias("effect"))


def adjusted_effect(df: DataFrame, strata: list[str], treated, outcome) -> DataFrame:
    """Backdoor adjustment: the difference of mean outcomes within strata, weighted by the strata's share. Strata
    without both kinds are left out."""
    rows = df.groupBy(*strata).agg(
        F.count("*").alias("n"), (F.avg(F.when(treated, outcome)) - F.avg(F.when(~treated, outcome))).alias("difference")
    ).where("difference is not null")
    return rows.agg((F.sum(F.col("n") * F.col("difference")) / F.sum("n")).alias("effect"), F.count("*").alias("strata"))


def regret(edges: DataFrame) -> DataFrame:
    """By state and action: weight given up against the best action of the state."""
    best = edges.groupBy("state").agg(F.max("weight").alias("best"))
    return edges.join(best, "state").select("state", "action", "outcome", (F.col("best") - F.col("weight")).alias("regret"))


def trace(edges: DataFrame, end, steps: int) -> list[DataFrame]:
    """Backwards from an outcome, the heaviest cause each time: one row for a step."""
    out, at = [], end
    for _ in range(steps):
        row = edges.where(F.col("outcome") == F.lit(at)).orderBy(F.desc("weight"), "state", "action").limit(1)
        found = row.head()
        if not found:
            break
        out.append(row)
        at = found["state"]
    return out


def joint(tables: list[tuple[str, list[str], DataFrame]]) -> DataFrame:
    """The joint distribution of a discrete model: conditional tables (variable, parents, rows of variable, parents and
    p) multiplied along their shared columns, in an order in which parents come first."""
    out = None
    for variable, parents, table in tables:
        table = table.select(variable, *parents, F.col("p").alias(f"p_{variable}"))
        out = table if out is None else (out.join(table, parents) if parents else out.crossJoin(table))
    product = F.lit(1.0)
    for variable, _, _ in tables:
        product = product * F.col(f"p_{variable}")
    return out.select(*[v for v, _, _ in tables], product.alias("p"))


def intervened(tables: list[tuple[str, list[str], DataFrame]], variable: str, value) -> list[tuple[str, list[str], DataFrame]]:
    """The model after do(variable = value): its table is replaced by the constant, which cuts its parents off."""
    out = []
    for name, parents, table in tables:
        if name == variable:
            table = table.sparkSession.range(1).select(F.lit(value).alias(name), F.lit(1.0).alias("p"))
            parents = []
        out.append((name, parents, table))
    return out


def marginal(distribution: DataFrame, variables: list[str]) -> DataFrame:
    return distribution.groupBy(*variables).agg(F.sum("p").alias("p"))


def conditional(distribution: DataFrame, variables: list[str], given: dict) -> DataFrame:
    for name, value in given.items():
        distribution = distribution.where(F.col(name) == F.lit(value))
    total = distribution.agg(F.sum("p").alias("total"))
    return marginal(distribution, variables).crossJoin(F.broadcast(total)).select(*variables, (F.col("p") / F.col("total")).alias("p"))


def separated(parents: dict[str, list[str]], a: str, b: str, given: set[str]) -> bool:
    """d-separation in a graph small enough for the program: in the moral graph of the ancestors, are all ways between
    a and b blocked?"""
    kept, todo = set(), [a, b, *given]
    while todo:
        x = todo.pop()
        if x not in kept:
            kept.add(x)
            todo += parents.get(x, [])
    near: dict[str, set[str]] = {x: set() for x in kept}
    for x in kept:
        own = parents.get(x, [])
        for p in own:
            near[x].add(p)
            near[p].add(x)
        for p in own:
            near[p] |= {q for q in own if q != p}
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        if x == b:
            return False
        if x not in seen:
            seen.add(x)
            todo += [y for y in near[x] if y not in given]
    return True


def necessity(edges: DataFrame, state, outcome, alternative) -> DataFrame:
    """One row: the weight of the heaviest imagined outcome of the alternative if any differs from the outcome, 0 if none
    does, null without an imagined one."""
    rows = edges.where((F.col("kind") == "imagine") & (F.col("state") == F.lit(state)) & (F.col("action") == F.lit(alternative)))
    return rows.agg(F.when(F.bool_or(F.col("outcome") != F.lit(outcome)), F.max("weight")).when(F.count("*") > 0, 0.0).alias("necessity"))


def sufficiency(edges: DataFrame, state, action, outcome) -> DataFrame:
    """One row: the weight of the heaviest outcome of the action if the outcome is among them, 0 if not, null without any."""
    rows = outcomes(edges, state, action)
    return rows.agg(F.when(F.bool_or(F.col("outcome") == F.lit(outcome)), F.max("weight")).when(F.count("*") > 0, 0.0).alias("sufficiency"))


def ancestors(links: DataFrame, node, depth: int = 20) -> DataFrame:
    """(node, hop): all that leads to a node over (source, target)."""
    from tessera.operators import graph

    starts = links.sparkSession.range(1).select(F.lit(node).alias("start"))
    out = graph.first_visit(links.select("source", F.lit("CAUSES").alias("verb"), "target"), starts, depth, direction="in")
    return out.select(F.col("target").alias("node"), "hop")


def correlated(edges: DataFrame, state, k: int) -> DataFrame:
    """What was seen with a state, heaviest first."""
    rows = edges.where((F.col("kind") == "see") & (F.col("state") == F.lit(state)))
    return rows.orderBy(F.desc("weight"), "action", "outcome").limit(k)


def near_confounders(edges: DataFrame, states: DataFrame, first, second, most: int, bits: int) -> DataFrame:
    """(a, b, distance): states that lead to the first outcome beside near ones that lead to the second. states: state,
    words."""
    from tessera.operators.search import near_join

    sides = []
    for name, outcome in (("a", first), ("b", second)):
        own = edges.where(F.col("outcome") == F.lit(outcome)).select("state").distinct().join(states, "state")
        sides.append(own.select(F.col("state").alias(name), "words"))
    return near_join(sides[0], "a", "words", sides[1], "b", "words", most, bits)


def counterfactual(tables: list[tuple[str, list[str], DataFrame]], evidence: dict, variable: str, value, wanted: list[str]) -> DataFrame:
    """What `wanted` would have been under variable = value, given what was seen: the roots take their distribution given
    the evidence, the variable is set, and the rest follows."""
    roots = [name for name, parents, _ in tables if not parents and name != variable]
    posterior = conditional(joint(tables), roots, evidence)
    rest = [t for t in intervened(tables, variable, value) if t[0] not in roots]
    out = posterior.withColumnRenamed("p", "p_roots")
    for name, parents, table in rest:
        table = table.select(name, *parents, F.col("p").alias(f"p_{name}"))
        out = out.join(table, parents) if parents else out.crossJoin(table)
    product = F.col("p_roots")
    for name, _, _ in rest:
        product = product * F.col(f"p_{name}")
    return marginal(out.withColumn("p", product), wanted)


def replaced(world: Column, old: Column, new: Column) -> Column:
    """A world, a binding of its parts, with one part in place of another."""
    from tessera.functions import fp

    return fp.bind(fp.bind(world, old), new)

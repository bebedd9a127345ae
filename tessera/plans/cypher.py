"""Cypher to DataFrames: text -> tokens -> syntax tree -> checks against a graph mapping -> joins.

Supported: MATCH with several patterns, hops in either or both directions, several types, variable length (min..max,
no repeated node), inline properties of nodes and edges, OPTIONAL-free WHERE with AND before OR, NOT, IN, LIKE, ILIKE,
CONTAINS, STARTS WITH, ENDS WITH, IS [NOT] NULL, EXISTS(x.p), comparisons, arithmetic, $parameters, toLower/toUpper,
vector_distance/vector_similarity; WITH, UNWIND, RETURN [DISTINCT] with aliases and count, sum, avg, min, max,
collect; ORDER BY, SKIP and LIMIT in either order. Trailing text is an error. Names of labels, types and properties
are case-insensitive. A variable's columns are `variable__property`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.session import materialise


class CypherError(ValueError):
    pass


# ---------------------------------------------------------------- mapping


class Graph:
    """Which table a label or relationship type is, and its key columns."""

    def __init__(self):
        self.nodes: dict[str, tuple[DataFrame, str]] = {}
        self.edges: dict[str, tuple[DataFrame, str, str, str, str]] = {}

    def node(self, label: str, df: DataFrame, key: str) -> Graph:
        if key.lower() not in [c.lower() for c in df.columns]:
            raise CypherError(f"{label} has no column {key}")
        self.nodes[label.lower()] = (df, key)
        return self

    def relationship(self, kind: str, df: DataFrame, source: str, target: str, source_label: str, target_label: str) -> Graph:
        for label in (source_label, target_label):
            if label.lower() not in self.nodes:
                raise CypherError(f"{kind} needs label {label}")
        for c in (source, target):
            if c.lower() not in [x.lower() for x in df.columns]:
                raise CypherError(f"{kind} has no column {c}")
        self.edges[kind.lower()] = (df, source, target, source_label.lower(), target_label.lower())
        return self


# ---------------------------------------------------------------- tokens and tree

TOKEN = re.compile(
    r"\s+|//[^\n]*|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?!\.\d))|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<param>\$\w+)|(?P<op><>|<=|>=|<-|->|\.\.|[-+*/%=<>()\[\]{}:,.|])"
)
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
SCALARS = {"tolower", "lower", "toupper", "upper", "vector_distance", "vector_similarity", "exists", "coalesce", "abs", "round", "size"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise CypherError(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
    return out


@dataclass
class Node:
    variable: str
    label: str | None
    properties: dict[str, tuple]


@dataclass
class Edge:
    variable: str
    kinds: list[str]
    direction: str
    least: int
    most: int
    properties: dict[str, tuple]


@dataclass
class Clause:
    kind: str
    patterns: list[list] = field(default_factory=list)
    where: tuple | None = None
    items: list[tuple[tuple, str]] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None
    variable: str = ""


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.made = tokens(text), 0, 0

    def peek(self, *words: str, ahead: int = 0) -> bool:
        if self.at + ahead >= len(self.tokens):
            return False
        kind, text = self.tokens[self.at + ahead]
        return kind in ("name", "op") and text.upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise CypherError(f"expected {word}, found {found}")

    def next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise CypherError(f"expected a {kind}, found {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1].strip("`")

    def fresh(self) -> str:
        self.made += 1
        return f"anon{self.made}"

    def query(self) -> list[Clause]:
        out = []
        while self.at < len(self.tokens):
            if self.take("MATCH"):
                clause = Clause("match", patterns=[self.pattern()])
                while self.take(","):
                    clause.patterns.append(self.pattern())
                if self.take("WHERE"):
                    clause.where = self.condition()
            elif self.take("UNWIND"):
                clause = Clause("unwind", items=[(self.expression(), "")])
                self.need("AS")
                clause.variable = self.next("name")
            elif self.peek("WITH", "RETURN"):
                clause = Clause("with" if self.take("WITH") else "return")
                if clause.kind == "return":
                    self.need("RETURN")
                self.projection(clause)
                if clause.kind == "with" and self.take("WHERE"):
                    clause.where = self.condition()
            else:
                raise CypherError(f"cannot go on at {self.tokens[self.at][1]}")
            if out and out[-1].kind == "return":
                raise CypherError("nothing may follow RETURN")
            out.append(clause)
        if not out or out[-1].kind != "return":
            raise CypherError("a query ends with RETURN")
        return out

    def projection(self, clause: Clause) -> None:
        clause.distinct = self.take("DISTINCT")
        while True:
            start = self.at
            expr = self.expression()
            name = self.next("name") if self.take("AS") else "".join(t for _, t in self.tokens[start : self.at])
            clause.items.append((expr, name))
            if not self.take(","):
                break
        if self.take("ORDER"):
            self.need("BY")
            while True:
                expr = self.expression()
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                clause.order.append((expr, down))
                if not self.take(","):
                    break
        while self.peek("SKIP", "OFFSET", "LIMIT"):
            skip = self.take("SKIP", "OFFSET") or not self.take("LIMIT")
            setattr(clause, "skip" if skip else "limit", int(self.next("number")))

    def pattern(self) -> list:
        out = [self.node()]
        while self.peek("-", "<-"):
            out += [self.edge(), self.node()]
        return out

    def properties(self) -> dict[str, tuple]:
        out = {}
        if self.take("{"):
            while True:
                name = self.next("name")
                self.need(":")
                out[name.lower()] = self.sum()
                if not self.take(","):
                    break
            self.need("}")
        return out

    def node(self) -> Node:
        self.need("(")
        variable = self.next("name") if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else self.fresh()
        label = self.next("name") if self.take(":") else None
        out = Node(variable, label, self.properties())
        self.need(")")
        return out

    def edge(self) -> Edge:
        left = self.take("<-")
        if not left:
            self.need("-")
        variable, kinds, least, most, properties = "", [], 1, 1, {}
        if self.take("["):
            if self.tokens[self.at][0] == "name":
                variable = self.next("name")
            if self.take(":"):
                kinds.append(self.next("name"))
                while self.take("|"):
                    self.take(":")
                    kinds.append(self.next("name"))
            if self.take("*"):
                least, most = 1, 10
                if self.tokens[self.at][0] == "number":
                    least = most = int(self.next("number"))
                if self.take(".."):
                    most = int(self.next("number")) if self.tokens[self.at][0] == "number" else 10
            properties = self.properties()
            self.need("]")
        right = self.take("->")
        if not right:
            self.need("-")
        if left and right:
            raise CypherError("an edge has one direction")
        if least > most or least < 1:
            raise CypherError(f"bad hop bounds {least}..{most}")
        return Edge(variable or self.fresh(), kinds, "in" if left else "out" if right else "both", least, most, properties)

    # conditions and expressions: tuples (kind, ...)
    def condition(self) -> tuple:
        out = self.conjunction()
        while self.take("OR"):
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self) -> tuple:
        out = self.negation()
        while self.take("AND"):
            out = ("and", out, self.negation())
        return out

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        for op in ("<>", "<=", ">=", "=", "<", ">"):
            if self.take(op):
                return ("compare", op, left, self.sum())
        if self.take("CONTAINS"):
            return ("contains", left, self.sum())
        for word in ("STARTS", "ENDS"):
            if self.take(word):
                self.need("WITH")
                return (word.lower(), left, self.sum())
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return ("notnull" if negated else "null", left)
        if self.take("IN"):
            return ("in", left, self.sum())
        for word in ("LIKE", "ILIKE"):
            if self.take(word):
                return (word.lower(), left, self.sum())
        return left

    def expression(self) -> tuple:
        return self.condition()

    def sum(self) -> tuple:
        out = self.product()
        while self.peek("+", "-"):
            op = "+" if self.take("+") else "-"
            if op == "-":
                self.need("-")
            out = ("math", op, out, self.product())
        return out

    def product(self) -> tuple:
        out = self.atom()
        while self.peek("*", "/", "%"):
            op = self.tokens[self.at][1]
            self.at += 1
            out = ("math", op, out, self.atom())
        return out

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise CypherError("the query ends too soon")
        kind, text = self.tokens[self.at]
        if self.take("-"):
            return ("math", "-", ("value", 0), self.atom())
        if self.take("("):
            out = self.condition()
            self.need(")")
            return out
        if self.take("["):
            items = []
            while not self.peek("]"):
                items.append(self.sum())
                self.take(",")
            self.need("]")
            return ("list", items)
        if self.take("*"):
            return ("star",)
        self.at += 1
        if kind == "number":
            return ("value", float(text) if "." in text else int(text))
        if kind == "string":
            return ("value", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "param":
            return ("param", text[1:])
        if kind == "name":
            if text.upper() in ("TRUE", "FALSE", "NULL"):
                return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()])
            if self.take("("):
                name, args = text.lower(), []
                if name not in AGGREGATES | SCALARS:
                    raise CypherError(f"unknown function {text}")
                distinct = self.take("DISTINCT")
                while not self.peek(")"):
                    args.append(self.condition())
                    self.take(",")
                self.need(")")
                if distinct and (name != "count" or args == [("star",)]):
                    raise CypherError("DISTINCT is for count(x)")
                return ("call", name, args, distinct)
            if self.take("."):
                return ("property", text.strip("`"), self.next("name"))
            return ("variable", text.strip("`"))
        raise CypherError(f"cannot read {text}")


def parse(text: str) -> list[Clause]:
    return Parser(text).query()


# ---------------------------------------------------------------- compiler


def aggregates(expr) -> bool:
    return isinstance(expr, tuple) and (
        (expr[0] == "call" and expr[1] in AGGREGATES) or any(aggregates(x) or (isinstance(x, list) and any(map(aggregates, x))) for x in expr)
    )


class Compiler:
    def __init__(self, graph: Graph, params: dict | None = None):
        self.graph, self.params = graph, params or {}
        #: Variables in scope: a node's or edge's columns by property, or one column of its own.
        self.scope: dict[str, dict[str, str] | str] = {}
        #: Of nodes: label and the column of the key.
        self.keys: dict[str, tuple[str, str]] = {}

    def run(self, clauses: list[Clause]) -> DataFrame:
        df = None
        for clause in clauses:
            if clause.kind == "match":
                for pattern in clause.patterns:
                    df = self.match(df, pattern)
                if clause.where:
                    df = df.where(self.column(clause.where))
            elif clause.kind == "unwind":
                if df is None:
                    some = next(iter(self.graph.nodes.values()))[0].sparkSession
                    df = some.range(1).select()
                df = df.withColumn(clause.variable, F.explode(self.column(clause.items[0][0])))
                self.scope[clause.variable] = clause.variable
            else:
                if df is None:
                    raise CypherError("nothing to return")
                df = self.project(df, clause)
        return df

    def table(self, label: str, variable: str) -> tuple[DataFrame, dict[str, str], str]:
        if label.lower() not in self.graph.nodes:
            raise CypherError(f"unknown label {label}")
        df, key = self.graph.nodes[label.lower()]
        names = {c.lower(): f"{variable}__{c.lower()}" for c in df.columns}
        df = df.select(*(F.col(c).alias(names[c.lower()]) for c in df.columns))
        return df, names, names[key.lower()]

    def filters(self, df: DataFrame, names: dict[str, str], properties: dict[str, tuple], what: str) -> DataFrame:
        for name, value in properties.items():
            if name not in names:
                raise CypherError(f"{what} has no property {name}")
            df = df.where(F.col(names[name]) == self.column(value))
        return df

    def node(self, node: Node, label: str) -> DataFrame:
        df, names, key = self.table(label, node.variable)
        self.scope[node.variable], self.keys[node.variable] = names, (label.lower(), key)
        return self.filters(df, names, node.properties, node.variable)

    def kinds(self, edge: Edge) -> list[str]:
        out = [k.lower() for k in edge.kinds] or list(self.graph.edges)
        for k in out:
            if k not in self.graph.edges:
                raise CypherError(f"unknown relationship {k}")
        return out

    def match(self, df: DataFrame | None, pattern: list) -> DataFrame:
        labels = self.labels(pattern)
        first = pattern[0]
        if first.variable not in self.keys:
            one = self.node(first, labels[0])
            df = one if df is None else df.crossJoin(one)
        elif first.properties:
            df = self.filters(df, self.scope[first.variable], first.properties, first.variable)
        for i in range(1, len(pattern), 2):
            df = self.hop(df, pattern[i - 1], pattern[i], pattern[i + 1], labels[(i + 1) // 2])
        return df

    def labels(self, pattern: list) -> list[str]:
        """Labels of the pattern's nodes: given, known, or what the relationships next to them imply."""
        nodes = pattern[0::2]
        out = [n.label or (self.keys[n.variable][0] if n.variable in self.keys else None) for n in nodes]
        for i, edge in enumerate(pattern[1::2]):
            for side, at in ((0, i), (1, i + 1)):
                if out[at] is None:
                    ends = {self.graph.edges[k][3 + (side if edge.direction != "in" else 1 - side)] for k in self.kinds(edge)}
                    if len(ends) == 1 and edge.direction != "both":
                        out[at] = ends.pop()
        for n, label in zip(nodes, out, strict=True):
            if label is None:
                raise CypherError(f"the label of {n.variable} is not clear")
        return out

    def steps(self, edge: Edge, a: str, b: str) -> DataFrame:
        """Edges from nodes of label a to nodes of label b: from_key, to_key and the properties of the variable."""
        out, names = None, None
        for kind in self.kinds(edge):
            df, source, target, la, lb = self.graph.edges[kind]
            for turned in (False, True):
                if edge.direction == ("in" if not turned else "out"):
                    continue
                s, t, x, y = (source, target, la, lb) if not turned else (target, source, lb, la)
                if (x, y) != (a.lower(), b.lower()):
                    continue
                own = {c.lower(): f"{edge.variable}__{c.lower()}" for c in df.columns}
                part = df.select(
                    F.col(s).alias("from_key"), F.col(t).alias("to_key"), F.lit(kind).alias(f"{edge.variable}__type"),
                    *(F.col(c).alias(own[c.lower()]) for c in df.columns),
                )
                part = self.filters(part, own, edge.properties, edge.variable)
                names = own if names is None else {k: v for k, v in names.items() if k in own}
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise CypherError(f"no relationship leads from {a} to {b}")
        self.scope[edge.variable] = names | {"type": f"{edge.variable}__type"}
        return out

    def hop(self, df: DataFrame, left: Node, edge: Edge, right: Node, label: str) -> DataFrame:
        a, a_key = self.keys[left.variable]
        if edge.most > 1:
            return self.walk(df, left, edge, right, label)
        steps = self.steps(edge, a, label)
        df = df.join(steps, F.col(a_key) == F.col("from_key")).drop("from_key")
        if right.variable in self.keys:
            df = df.where(F.col("to_key") == F.col(self.keys[right.variable][1]))
            if right.properties:
                df = self.filters(df, self.scope[right.variable], right.properties, right.variable)
        else:
            other = self.node(right, label)
            df = df.join(other, F.col("to_key") == F.col(self.keys[right.variable][1]))
        return df.drop("to_key")

    def walk(self, df: DataFrame, left: Node, edge: Edge, right: Node, label: str) -> DataFrame:
        """Paths of least to most hops without a repeated node, within one label or, of one hop kind, between labels."""
        a, a_key = self.keys[left.variable]
        # paths grow from the nodes that are bound on the left, level by level; each level is written
        starts = df.select(F.col(a_key).alias("from_key")).distinct()
        if a != label.lower() and edge.most > 1:
            ways = self.mixed(edge, a, label.lower(), starts)
        else:
            steps = self.steps(edge, a, label).select("from_key", "to_key")
            at = steps.join(starts, "from_key", "left_semi").where("from_key <> to_key")
            at = materialise(at.select("from_key", "to_key", F.array("from_key", "to_key").alias("path")), "ways")
            levels = [at]
            for _ in range(1, edge.most):
                more = steps.withColumnsRenamed({"from_key": "mid", "to_key": "end"})
                at = at.join(more, at["to_key"] == more["mid"]).where(~F.array_contains("path", F.col("end")))
                at = materialise(at.select("from_key", F.col("end").alias("to_key"), F.concat("path", F.array("end")).alias("path")), "ways")
                levels.append(at)
                if at.isEmpty():
                    break
            ways = None
            for depth, level in enumerate(levels, 1):
                if depth >= edge.least:
                    part = level.select("from_key", "to_key", F.lit(depth).alias(f"{edge.variable}__hops"))
                    ways = part if ways is None else ways.union(part)
        self.scope[edge.variable] = {"hops": f"{edge.variable}__hops"}
        df = df.join(ways, F.col(a_key) == F.col("from_key")).drop("from_key")
        if right.variable in self.keys:
            return df.where(F.col("to_key") == F.col(self.keys[right.variable][1])).drop("to_key")
        other = self.node(right, label)
        return df.join(other, F.col("to_key") == F.col(self.keys[right.variable][1])).drop("to_key")

    def mixed(self, edge: Edge, a: str, b: str, starts: DataFrame) -> DataFrame:
        """Ways from some nodes of label a through nodes of any labels; a node is its label and key."""
        steps = None
        for kind in self.kinds(edge):
            df, source, target, la, lb = self.graph.edges[kind]
            for turned in (False, True):
                if edge.direction == ("in" if not turned else "out"):
                    continue
                s, t, x, y = (source, target, la, lb) if not turned else (target, source, lb, la)
                part = df.select(
                    F.lit(x).alias("from_label"), F.col(s).cast("string").alias("from_key"), F.lit(y).alias("to_label"),
                    F.col(t).cast("string").alias("to_key"),
                )
                steps = part if steps is None else steps.union(part)
        name = lambda p: F.concat_ws(":", f"{p}_label", f"{p}_key")
        steps = steps.select(name("from").alias("f"), name("to").alias("t"))
        first = starts.select(F.concat(F.lit(a + ":"), F.col("from_key").cast("string")).alias("f"))
        at = materialise(steps.join(first, "f", "left_semi").where("f <> t").select("f", "t", F.array("f", "t").alias("path")), "ways")
        ways, levels = None, [at]
        for _ in range(1, edge.most):
            more = steps.withColumnsRenamed({"f": "mid", "t": "end"})
            at = at.join(more, at["t"] == more["mid"]).where(~F.array_contains("path", F.col("end")))
            at = materialise(at.select("f", F.col("end").alias("t"), F.concat("path", F.array("end")).alias("path")), "ways")
            levels.append(at)
            if at.isEmpty():
                break
        key = lambda c, label: F.expr(f"substring({c}, {len(label) + 2})")
        for depth, level in enumerate(levels, 1):
            if depth >= edge.least:
                part = level.where(F.startswith("t", F.lit(b + ":"))).select(
                    key("f", a).alias("from_key"), key("t", b).alias("to_key"), F.lit(depth).alias(f"{edge.variable}__hops")
                )
                ways = part if ways is None else ways.union(part)
        return ways

    def project(self, df: DataFrame, clause: Clause) -> DataFrame:
        items, whole = [], {}
        for expr, name in clause.items:
            if expr[0] == "variable" and isinstance(self.scope.get(expr[1]), dict):
                names = self.scope[expr[1]]
                whole[name] = (expr[1], {p: f"{name}__{p}" for p in names})
                items += [(F.col(c).alias(f"{name}__{p}"), False, None) for p, c in names.items()]
            else:
                items.append((self.column(expr).alias(name), aggregates(expr), name))
        order = []
        names = {n for _, _, n in items if n}
        grouped = any(agg for _, agg, _ in items)
        if grouped:
            keys = [c for c, agg, _ in items if not agg]
            out = df.groupBy(*keys).agg(*[c for c, agg, _ in items if agg])
            out = out.select(*[F.col(f"`{n}`") if n else c for c, _, n in items]) if all(n for _, _, n in items) else out
        else:
            out = None
        returned = {json_key(e): n for e, n in clause.items}
        for expr, down in clause.order:
            if expr[0] == "variable" and expr[1] in names:
                c = F.col(f"`{expr[1]}`")
            elif json_key(expr) in returned:
                c = F.col(f"`{returned[json_key(expr)]}`")
            elif grouped or clause.distinct:
                raise CypherError("ORDER BY must name a returned item here")
            else:
                c = self.column(expr)
            order.append(c.desc() if down else c.asc())
        if grouped:
            if clause.distinct:
                out = out.distinct()
        elif clause.distinct:
            out = df.select(*[c for c, _, _ in items]).distinct()
        else:
            # order may also use columns that are not returned
            kept = [c for c in df.columns if c not in names]
            out = df.select(*kept, *[c for c, _, n in items if n])
            if order:
                out = out.orderBy(*order)
            out = self.paged(out, clause)
            out = out.select(*[F.col(f"`{n}`") if n else c for c, _, n in items])
            order = []
        if order:
            out = out.orderBy(*order)
        if grouped or clause.distinct:
            out = self.paged(out, clause)
        keys = {}
        self.scope, old = {n: n for n in names}, self.scope
        for name, (variable, columns) in whole.items():
            self.scope[name] = columns
            if variable in self.keys:
                label, key = self.keys[variable]
                own = next(p for p, c in old[variable].items() if c == key)
                keys[name] = (label, columns[own])
        self.keys = keys
        if clause.where:
            out = out.where(self.column(clause.where))
        return out

    @staticmethod
    def paged(df: DataFrame, clause: Clause) -> DataFrame:
        if clause.skip:
            df = df.offset(clause.skip)
        return df if clause.limit is None else df.limit(clause.limit)

    def column(self, expr: tuple) -> Column:
        kind = expr[0]
        if kind == "value":
            return F.lit(expr[1])
        if kind == "param":
            if expr[1] not in self.params:
                raise CypherError(f"no value for ${expr[1]}")
            value = self.params[expr[1]]
            return F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)
        if kind == "list":
            return F.array(*map(self.column, expr[1]))
        if kind == "variable":
            at = self.scope.get(expr[1])
            if at is None:
                raise CypherError(f"unknown variable {expr[1]}")
            if isinstance(at, dict):
                return F.col(self.keys[expr[1]][1]) if expr[1] in self.keys else F.col(next(iter(at.values())))
            return F.col(f"`{at}`")
        if kind == "property":
            at = self.scope.get(expr[1])
            if not isinstance(at, dict):
                raise CypherError(f"unknown variable {expr[1]}")
            if expr[2].lower() not in at:
                raise CypherError(f"{expr[1]} has no property {expr[2]}")
            return F.col(at[expr[2].lower()])
        if kind == "and":
            return self.column(expr[1]) & self.column(expr[2])
        if kind == "or":
            return self.column(expr[1]) | self.column(expr[2])
        if kind == "not":
            return ~self.column(expr[1])
        if kind == "null":
            return self.column(expr[1]).isNull()
        if kind == "notnull":
            return self.column(expr[1]).isNotNull()
        if kind == "compare":
            a, b = self.column(expr[2]), self.column(expr[3])
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[expr[1]]
        if kind == "math":
            a, b = self.column(expr[2]), self.column(expr[3])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[expr[1]]()
        if kind in ("contains", "starts", "ends", "like", "ilike"):
            a = self.column(expr[1])
            if kind in ("like", "ilike"):
                if expr[2][0] != "value":
                    raise CypherError("LIKE needs a literal")
                return getattr(a, kind)(expr[2][1])
            return {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[kind](a, self.column(expr[2]))
        if kind == "in":
            if expr[2][0] == "list" and all(x[0] == "value" for x in expr[2][1]):
                return self.column(expr[1]).isin([x[1] for x in expr[2][1]])
            return F.array_contains(self.column(expr[2]), self.column(expr[1]))
        if kind == "call":
            return self.call(expr[1], expr[2], expr[3])
        raise CypherError(f"{kind} is no value")

    def call(self, name: str, args: list[tuple], distinct: bool) -> Column:
        if name == "count":
            if args == [("star",)]:
                return F.count("*")
            return (F.count_distinct if distinct else F.count)(self.column(args[0]))
        if name in AGGREGATES and len(args) != 1:
            raise CypherError(f"{name} takes one argument")
        if name in ("sum", "avg", "min", "max") and args[0][0] == "variable" and isinstance(self.scope.get(args[0][1]), dict):
            raise CypherError(f"{name} needs a property")
        cols = [self.column(a) for a in args if a[0] != "value" or name not in ("vector_distance", "vector_similarity")]
        if name in ("vector_distance", "vector_similarity"):
            metric = args[2][1].lower() if len(args) > 2 else "cosine"
            return getattr(vectors, name)(*[self.column(a) for a in args[:2]], metric)
        made = {
            "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list, "tolower": F.lower,
            "lower": F.lower, "toupper": F.upper, "upper": F.upper, "exists": F.isnotnull, "coalesce": F.coalesce,
            "abs": F.abs, "round": F.round, "size": F.size,
        }
        return made[name](*cols)


def json_key(expr) -> str:
    return repr(expr)


def cypher(graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    return Compiler(graph, params).run(parse(text))


# ---------------------------------------------------------------- writes

WRITE = re.compile(
    r"^\s*(?P<verb>CREATE|MERGE)\s*\(\s*(?P<var>\w*)\s*(?::\s*(?P<label>\w+))?\s*(?P<props>\{.*\})?\s*\)"
    r"(?:\s*SET\s+(?P<set>.+?))?\s*;?\s*$",
    re.S | re.I,
)


RELATION = re.compile(
    r"^\s*MATCH\s*\(\s*(?P<a>\w+)\s*(?P<la>(?::\s*\w+\s*)*)(?P<pa>\{.*?\})?\s*\)\s*,\s*\(\s*(?P<b>\w+)\s*(?P<lb>(?::\s*\w+\s*)*)(?P<pb>\{.*?\})?\s*\)"
    r"(?:\s*WHERE\s+(?P<where>.+?))?\s*(?P<verb>CREATE|MERGE)\s*\(\s*(?P=a)\s*\)\s*-\s*\[\s*\w*\s*:\s*(?P<kind>\w+)\s*(?P<props>\{.*\})?\s*\]\s*->\s*\(\s*(?P=b)\s*\)\s*;?\s*$",
    re.S | re.I,
)
UNRELATE = re.compile(
    r"^\s*MATCH\s*\(\s*(?P<a>\w*)\s*(?P<la>(?::\s*\w+\s*)*)(?P<pa>\{.*?\})?\s*\)\s*-\s*\[\s*(?P<r>\w+)\s*:\s*(?P<kind>\w+)\s*\]\s*->\s*\(\s*(?P<b>\w*)\s*(?P<lb>(?::\s*\w+\s*)*)(?P<pb>\{.*?\})?\s*\)\s*DELETE\s+(?P=r)\s*;?\s*$",
    re.S | re.I,
)


def write_graph(nodes: DataFrame, edges: DataFrame, text: str, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables after a write: edges are (source, verb, target, properties: map). CREATE and MERGE of a relationship
    between matched nodes, DELETE of matched relationships, DETACH DELETE of nodes with their relationships; a DELETE of nodes
    that still have relationships is an error. All else is as in write()."""
    after = changed_graph(nodes, edges, text, params)
    # written, or plans would grow with every write
    return tuple(rows if rows is old else materialise(rows, "graph") for rows, old in zip(after, (nodes, edges), strict=True))


def changed_graph(nodes: DataFrame, edges: DataFrame, text: str, params: dict | None) -> tuple[DataFrame, DataFrame]:
    def ends(m, side):
        labels = re.findall(r"\w+", m["l" + side] or "")
        given = {k: literal(v, params) for k, v in Parser(m["p" + side] or "").properties().items()}
        found = nodes
        for label in labels or [None]:
            found = matched(found, label, given)
        return found

    if m := RELATION.match(text):
        sides = {side: ends(m, side) for side in "ab"}
        for side, condition in conditions(m["where"], params):
            name = {m["a"].lower(): "a", m["b"].lower(): "b"}[side]
            sides[name] = sides[name].where(condition)
        made = sides["a"].select(F.col("id").alias("source")).crossJoin(sides["b"].select(F.col("id").alias("target")))  # as MATCH says
        given = {k: str(literal(v, params)) for k, v in Parser(m["props"] or "").properties().items()}
        held = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(v))]) if given else F.expr("cast(map() as map<string,string>)")
        made = made.select("source", F.lit(m["kind"]).alias("verb"), "target", held.alias("properties"))
        if m["verb"].upper() == "MERGE":
            made = made.join(edges.select("source", "verb", "target"), ["source", "verb", "target"], "left_anti")
        return nodes, edges.unionByName(made)
    if m := UNRELATE.match(text):
        gone = edges.where(F.col("verb") == m["kind"])
        for side, end in (("a", "source"), ("b", "target")):
            gone = gone.join(ends(m, side).select(F.col("id").alias(end)), end, "left_semi")
        return nodes, edges.join(gone.select("source", "verb", "target"), ["source", "verb", "target"], "left_anti").select(*edges.columns)
    after = write(nodes, text, params)
    if re.search(r"\bDELETE\b", text, re.I):
        lost = nodes.select("id").join(after.select("id"), "id", "left_anti")
        tied = edges.select("source").union(edges.select("target")).toDF("id").join(lost, "id", "left_semi")
        if re.search(r"\bDETACH\s+DELETE\b", text, re.I):
            for end in ("source", "target"):
                edges = edges.join(lost.select(F.col("id").alias(end)), end, "left_anti")
            edges = edges.select("source", "verb", "target", "properties")
        elif not tied.isEmpty():
            raise CypherError("the node has relationships: DETACH DELETE")
    return after, edges


def conditions(text: str | None, params: dict | None) -> list[tuple[str, Column]]:
    """(variable, condition) of comparisons of properties with literals, joined by AND."""
    out = []
    for part in re.split(r"\s+AND\s+", text or "", flags=re.I):
        if not part.strip():
            continue
        m = re.fullmatch(r"\s*(\w+)\.(\w+)\s*(=|<>|<=|>=|<|>)\s*(.+?)\s*", part, re.S)
        if not m:
            raise CypherError(f"not a comparison of a property: {part.strip()}")
        value = literal(Parser(m[4]).atom(), params)
        name = m[2].lower()
        held = F.col("id") if name == "id" else F.col("label") if name == "label" else F.col("properties")[name]
        if not isinstance(value, str):
            held, value = held.cast("double"), float(value)
        compared = {"=": held == value, "<>": held != value, "<": held < value, ">": held > value, "<=": held <= value, ">=": held >= value}
        out.append((m[1].lower(), compared[m[3]]))
    return out


def write(nodes: DataFrame, text: str, params: dict | None = None) -> DataFrame:
    """The node table (id, label, properties: map) after CREATE or MERGE of a node, with SET, or MATCH .. SET/DELETE.
    MERGE finds a node by label and the given properties; an id property names the node."""
    spark = nodes.sparkSession
    if m := WRITE.match(text):
        parser = Parser(m["props"] or "")
        given = {k: literal(v, params) for k, v in parser.properties().items()}
        label = m["label"] or "Node"
        found = matched(nodes, label, given)
        if m["verb"].upper() == "MERGE" and not found.isEmpty():
            return updated(nodes, found, m["set"], params) if m["set"] else nodes
        id = str(given.pop("id")) if "id" in given else None
        if m["set"]:
            given |= assigned(m["set"], params)
        made = spark.createDataFrame([(id, label, {k: str(v) for k, v in given.items()})], "id string, label string, properties map<string,string>")
        made = made.withColumn("id", F.coalesce("id", F.expr("uuid()")))
        return nodes.unionByName(made)
    if m := re.match(r"^\s*MATCH\s*\(\s*(\w+)\s*(?::\s*(\w+))?\s*(\{.*?\})?\s*\)\s*(?:WHERE\s+(.+?)\s+)?(SET|DETACH\s+DELETE|DELETE)\s+(.+?)\s*;?\s*$", text, re.S | re.I):
        given = {k: literal(v, params) for k, v in Parser(m[3] or "").properties().items()}
        found = matched(nodes, m[2], given)
        for variable, condition in conditions(m[4], params):
            if variable != m[1].lower():
                raise CypherError(f"unknown variable {variable}")
            found = found.where(condition)
        if m[5].upper() == "SET":
            return updated(nodes, found, m[6], params)
        return nodes.join(found.select("id"), "id", "left_anti").select(*nodes.columns)
    raise CypherError("not a CREATE, MERGE, MATCH .. SET or MATCH .. DELETE of a node")


def literal(expr: tuple, params: dict | None):
    if expr[0] == "param":
        return (params or {})[expr[1]]
    if expr[0] != "value":
        raise CypherError("a written property is a literal or parameter")
    return expr[1]


def matched(nodes: DataFrame, label: str | None, given: dict) -> DataFrame:
    out = nodes.where(F.col("label") == label) if label else nodes
    for k, v in given.items():
        out = out.where((F.col("id") if k == "id" else F.col("properties")[k]) == str(v))
    return out


def assigned(text: str, params: dict | None) -> dict:
    out = {}
    parser = Parser(text)
    while parser.at < len(parser.tokens):
        parser.next("name")
        parser.need(".")
        name = parser.next("name")
        parser.need("=")
        out[name.lower()] = literal(parser.atom(), params)
        if not parser.take(","):
            break
    return out


def updated(nodes: DataFrame, found: DataFrame, text: str, params: dict | None) -> DataFrame:
    new = F.create_map(*[x for k, v in assigned(text, params).items() for x in (F.lit(k), F.lit(str(v)))])
    keep = F.map_filter("properties", lambda k, _: ~F.array_contains(F.map_keys(new), k))
    changed = found.withColumn("properties", F.map_concat(keep, new))
    return nodes.join(found.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(changed)

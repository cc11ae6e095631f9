"""Graph pattern queries (a subset of openCypher) compiled to DataFrame joins.

    MATCH path (, path)* [WHERE expr] RETURN [DISTINCT] item (, item)*
    [ORDER BY key (, key)*] [SKIP n] [LIMIT n]

Text -> tokens -> syntax tree -> a lazy tree of equi-joins that Catalyst plans:
labels and relationship types are filters below the joins, so they reach the
scans; a repeated variable is an equality, not a second scan; links without a
target note drop out (inner joins). Relationship uniqueness is not enforced.
Joins begin at the node that an equality holds fast (an id before another property)
and a fixed id filters the links at its node too. A hop from nodes that may repeat is
joined with its restricted end first (at most a row a link), so that a hub's rows are
multiplied only by links that fit.
Labels and types compare ASCII-case-insensitively; label ``Note``, or none, is every
note. ``*a..b`` repeats a hop (unrolled joins, bounded, of one type set).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.errors import CypherError
from quillmesh.functions.text import equals_ignoring_ascii_case

NODE_PROPERTIES = ("id", "path", "type", "title")
EDGE_PROPERTIES = ("to_raw", "resolved", "position")
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
_MAX_HOPS = 16
_TOKEN = re.compile(
    r"""\s+|//[^\n]*|(?P<num>\d+\.\d+(?:[eE][-+]?\d+)?|\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<quoted>`(?:[^`]|``)*`)"""
    r"""|(?P<param>\$\w+)|(?P<name>[^\W\d]\w*)|(?P<op><>|<=|>=|\.\.|[-()\[\]{}:,.|*=<>+/%])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


# ---- syntax tree -----------------------------------------------------------


@dataclass
class Node:
    var: str
    labels: list[str]
    where: dict[str, Any]


@dataclass
class Rel:
    var: str
    types: list[str]
    where: dict[str, Any]
    direction: int  # 1: left to right, -1: right to left
    hops: tuple[int, int] = (1, 1)


@dataclass
class Expr:
    """op and arguments; ``text`` is the source, which names unnamed columns."""

    op: str
    args: tuple = ()
    text: str = ""

    def has_aggregate(self) -> bool:
        return self.op == "agg" or any(a.has_aggregate() for a in self.args if isinstance(a, Expr))


@dataclass
class Query:
    paths: list[list] = field(default_factory=list)
    where: Expr | None = None
    distinct: bool = False
    items: list[tuple[Expr, str | None]] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None


# ---- parser ----------------------------------------------------------------


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.fresh = text, 0, count()
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], m.start(), m.end()))
            at = m.end()
        self.tokens.append(("end", "", at, at))

    def peek(self, *values: str) -> bool:
        kind, value, *_ = self.tokens[self.at]
        return kind != "str" and kind != "quoted" and (value in values or (kind == "name" and value.upper() in values))

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise CypherError(f"expected {value} before {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}")

    def name(self) -> str:
        kind, value, *_ = self.tokens[self.at]
        if kind not in ("name", "quoted"):
            raise CypherError(f"expected a name before {value!r} at {self.tokens[self.at][2]}")
        self.at += 1
        return value[1:-1].replace("``", "`") if kind == "quoted" else value

    def source(self, start: int) -> str:
        return self.text[self.tokens[start][2] : self.tokens[self.at - 1][3]]

    def query(self) -> Query:
        q = Query()
        self.need("MATCH")
        while True:
            q.paths.append(self.path())
            if not self.take(",") and not self.take("MATCH"):
                break
        if self.take("WHERE"):
            q.where = self.expr()
        self.need("RETURN")
        q.distinct = self.take("DISTINCT")
        while True:
            e = self.expr()
            q.items.append((e, self.name() if self.take("AS") else None))
            if not self.take(","):
                break
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                down = self.take("DESC", "DESCENDING") or not (self.take("ASC", "ASCENDING") or True)
                q.order.append((e, down))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            q.skip = self.primary()
        if self.take("LIMIT"):
            q.limit = self.primary()
        if self.tokens[self.at][0] != "end":
            raise CypherError(f"unexpected {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}")
        return q

    def path(self) -> list:
        parts: list = [self.node()]
        while self.peek("-", "<"):
            parts += [self.rel(), self.node()]
        return parts

    def props(self) -> dict[str, Any]:
        found = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                found[key] = self.primary()
                if not self.peek("}"):
                    self.need(",")
        return found

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.tokens[self.at][0] in ("name", "quoted") else f" n{next(self.fresh)}"
        labels = []
        while self.take(":"):
            labels.append(self.name())
        node = Node(var, labels, self.props())
        self.need(")")
        return node

    def rel(self) -> Rel:
        left = self.take("<")
        self.need("-")
        var, types, where, hops = f" r{next(self.fresh)}", [], {}, (1, 1)
        if self.take("["):
            if self.tokens[self.at][0] in ("name", "quoted"):
                var = self.name()
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            if self.take("*"):
                hops = self.hops()
            where = self.props()
            self.need("]")
        self.need("-")
        right = self.take(">")
        if left == right:
            raise CypherError("a relationship needs one direction: -[..]-> or <-[..]-")
        return Rel(var, types, where, 1 if right else -1, hops)

    def hops(self) -> tuple[int, int]:
        def number() -> int | None:
            kind, value, *_ = self.tokens[self.at]
            if kind == "num":
                self.at += 1
                return int(value)
            return None

        low = number()
        if self.take(".."):
            high = number()
            return (1 if low is None else low), (_MAX_HOPS if high is None else high)
        return (1, _MAX_HOPS) if low is None else (low, low)

    def expr(self) -> Expr:
        start = self.at
        e = self.disjunction()
        e.text = self.source(start)
        return e

    def disjunction(self) -> Expr:
        e = self.conjunction()
        while self.take("OR"):
            e = Expr("or", (e, self.conjunction()))
        return e

    def conjunction(self) -> Expr:
        e = self.negation()
        while self.take("AND"):
            e = Expr("and", (e, self.negation()))
        return e

    def negation(self) -> Expr:
        return Expr("not", (self.negation(),)) if self.take("NOT") else self.comparison()

    def comparison(self) -> Expr:
        e = self.sum()
        while True:
            for op in ("=", "<>", "<=", ">=", "<", ">"):
                if self.take(op):
                    e = Expr(op, (e, self.sum()))
                    break
            else:
                if self.take("IN"):
                    e = Expr("in", (e, self.sum()))
                elif self.take("STARTS"):
                    self.need("WITH")
                    e = Expr("starts", (e, self.sum()))
                elif self.take("ENDS"):
                    self.need("WITH")
                    e = Expr("ends", (e, self.sum()))
                elif self.take("CONTAINS"):
                    e = Expr("contains", (e, self.sum()))
                elif self.take("IS"):
                    negated = self.take("NOT")
                    self.need("NULL")
                    e = Expr("not", (Expr("null", (e,)),)) if negated else Expr("null", (e,))
                else:
                    return e

    def sum(self) -> Expr:
        e = self.product()
        while self.peek("+", "-"):
            op = "+" if self.take("+") else self.take("-") and "-"
            e = Expr(op, (e, self.product()))
        return e

    def product(self) -> Expr:
        e = self.primary()
        while self.peek("*", "/", "%"):
            op = next(o for o in "*/%" if self.take(o))
            e = Expr(op, (e, self.primary()))
        return e

    def primary(self) -> Expr:
        start = self.at
        kind, value, at, _ = self.tokens[self.at]
        if self.take("("):
            e = self.expr()
            self.need(")")
        elif self.take("-"):
            e = Expr("neg", (self.primary(),))
        elif self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expr())
                if not self.peek("]"):
                    self.need(",")
            e = Expr("list", tuple(items))
        elif kind == "num":
            self.at += 1
            e = Expr("lit", (float(value) if re.search(r"[.eE]", value) else int(value),))
        elif kind == "str":
            self.at += 1
            e = Expr("lit", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S),))
        elif kind == "param":
            self.at += 1
            e = Expr("param", (value[1:],))
        elif self.take("TRUE", "FALSE", "NULL"):
            e = Expr("lit", ({"TRUE": True, "FALSE": False, "NULL": None}[value.upper()],))
        elif kind in ("name", "quoted"):
            name = self.name()
            if kind == "name" and self.take("("):
                e = self.call(name)
            elif self.take("."):
                e = Expr("prop", (name, self.name()))
            else:
                e = Expr("var", (name,))
        else:
            raise CypherError(f"unexpected {value!r} at {at}")
        e.text = self.source(start)
        return e

    def call(self, name: str) -> Expr:
        low = name.lower()
        if low in _AGGREGATES:
            distinct = self.take("DISTINCT")
            arg = Expr("star") if low == "count" and self.take("*") else self.expr()
            self.need(")")
            return Expr("agg", (low, distinct, arg))
        arg = self.expr()
        self.need(")")
        if low not in ("type", "tolower", "toupper", "size", "id"):
            raise CypherError(f"unknown function {name}")
        return Expr("call", (low, arg))


def parse(text: str) -> Query:
    return _Parser(text).query()


# ---- compiler --------------------------------------------------------------


class PropertyGraph:
    """A node and an edge table to query.

    nodes: id, ``label_col`` and the node properties; edges: from_id, to_id,
    edge_type and the relationship properties. Other tables than notes serve as well.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, node_properties=NODE_PROPERTIES, edge_properties=EDGE_PROPERTIES, label_col: str = "type"):
        self.nodes, self.edges, self.label_col = nodes, edges, label_col
        self.node_properties, self.edge_properties = tuple(node_properties), tuple(edge_properties)

    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The result of a query as a lazy DataFrame."""
        return _Compiler(self, parse(text), params or {}).run()


class _Compiler:
    def __init__(self, graph: PropertyGraph, query: Query, params: dict[str, Any]):
        self.graph, self.q, self.params = graph, query, params
        self.kinds: dict[str, str] = {}
        self.alias: dict[str, str] = {}
        self.fixed: dict[str, dict[str, Expr]] = {}  # by variable: properties that must equal a constant
        self.restricted: set[str] = set()  # variables with a label or a condition of their own

    # columns of the joined table are <alias>__<property>
    def column(self, var: str, prop: str) -> Column:
        kind = self.kinds.get(var)
        if kind is None:
            raise CypherError(f"unknown variable {var}")
        allowed = self.graph.node_properties if kind == "node" else self.graph.edge_properties if kind == "rel" else ()
        if prop not in allowed:
            raise CypherError(f"unknown property {var}.{prop}; known: {', '.join(allowed)}")
        return F.col(f"{self.alias[var]}__{prop}")

    def used(self) -> dict[str, set[str]]:
        """Properties that the query reads, by variable."""
        out: dict[str, set[str]] = {}

        def walk(e) -> None:
            if isinstance(e, Expr):
                if e.op == "prop":
                    out.setdefault(e.args[0], set()).add(e.args[1])
                elif e.op == "var":
                    out.setdefault(e.args[0], set()).add("*")
                for a in e.args:
                    walk(a)

        for e in [self.q.where, *(i for i, _ in self.q.items), *(o for o, _ in self.q.order)]:
            walk(e)
        return out

    def find_restrictions(self) -> None:
        """Fill ``fixed`` and ``restricted`` from the node patterns and WHERE's conjuncts."""

        def variables(e) -> set[str]:
            if not isinstance(e, Expr):
                return set()
            return {e.args[0]} if e.op in ("prop", "var") else set().union(*map(variables, e.args))

        def visit(e: Expr) -> None:
            if e.op == "and":
                for a in e.args:
                    visit(a)
                return
            if len(only := variables(e)) == 1:
                self.restricted |= only
            if e.op == "=":
                for x, y in (e.args, e.args[::-1]):
                    if x.op in ("prop", "var") and y.op in ("lit", "param"):
                        self.fixed.setdefault(x.args[0], {})[x.args[1] if x.op == "prop" else "id"] = y

        for node in (n for path in self.q.paths for n in path[::2]):
            self.fixed.setdefault(node.var, {}).update({p: v for p, v in node.where.items() if v.op in ("lit", "param")})
            if node.where or any(label.lower() != "note" for label in node.labels):
                self.restricted.add(node.var)
        if self.q.where is not None:
            visit(self.q.where)

    def held(self, var: str) -> int:
        """How fast equalities hold a node: 2 by its id, 1 by another property but the label."""
        props = self.fixed.get(var, {}).keys() & set(self.graph.node_properties)
        return 2 if "id" in props else 1 if props - {self.graph.label_col} else 0

    def scan_node(self, node: Node, used: set[str]) -> DataFrame:
        alias = self.alias[node.var]
        df = self.graph.nodes
        for label in node.labels:
            if label.lower() != "note":
                df = df.where(equals_ignoring_ascii_case(F.col(self.graph.label_col), label))
        for prop, value in node.where.items():
            if prop not in self.graph.node_properties:
                raise CypherError(f"unknown property {prop}; known: {', '.join(self.graph.node_properties)}")
            df = df.where(F.col(prop) == self.value(value))
        props = self.graph.node_properties if "*" in used else [p for p in self.graph.node_properties if p in used or p == "id"]
        return df.select(*(F.col(p).alias(f"{alias}__{p}") for p in props))

    def scan_edges(self, rel: Rel) -> DataFrame:
        df = self.graph.edges
        if rel.types:
            df = df.where(reduce(Column.__or__, (equals_ignoring_ascii_case(F.col("edge_type"), t) for t in rel.types)))
        for prop, value in rel.where.items():
            if prop not in self.graph.edge_properties:
                raise CypherError(f"unknown property {prop}; known: {', '.join(self.graph.edge_properties)}")
            df = df.where(F.col(prop) == self.value(value))
        return df

    def scan_rel(self, rel: Rel, used: set[str], left: Node, right: Node) -> DataFrame:
        """Links as <alias>__a (at ``left``), <alias>__b (at ``right``) and what is used."""
        df = self.scan_links(rel, used)
        for node, end in ((left, "a"), (right, "b")):
            at = self.fixed.get(node.var, {}).get("id")
            if at is not None and isinstance(at.args[0] if at.op == "lit" else self.params.get(at.args[0]), str):
                df = df.where(F.col(f"{self.alias[rel.var]}__{end}") == self.value(at))
        return df

    def scan_links(self, rel: Rel, used: set[str]) -> DataFrame:
        alias = self.alias[rel.var]
        df = self.scan_edges(rel)
        ends = ("from_id", "to_id") if rel.direction == 1 else ("to_id", "from_id")
        if rel.hops == (1, 1):
            own = self.graph.edge_properties if "*" in used else [p for p in self.graph.edge_properties if p in used]
            return df.select(F.col(ends[0]).alias(f"{alias}__a"), F.col(ends[1]).alias(f"{alias}__b"), F.col("edge_type").alias(f"{alias}__type"), *(F.col(p).alias(f"{alias}__{p}") for p in own))
        low, high = rel.hops
        if not 0 <= low <= high or high > _MAX_HOPS:
            raise CypherError(f"hops must be within 0 and {_MAX_HOPS}")
        step = df.select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b"))
        reach = self.graph.nodes.select(F.col("id").alias("a"), F.col("id").alias("b")) if low == 0 else None
        walk = None
        for hop in range(1, high + 1):
            walk = step if walk is None else walk.withColumnRenamed("b", "m").join(step.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
            if hop >= low:
                reach = walk if reach is None else reach.union(walk)
        return reach.select(F.col("a").alias(f"{alias}__a"), F.col("b").alias(f"{alias}__b"))

    def run(self) -> DataFrame:
        used, q = self.used(), self.q
        for path in q.paths:
            for part in path:
                kind = "node" if isinstance(part, Node) else "rel" if part.hops == (1, 1) else "path"
                if self.kinds.setdefault(part.var, kind) != kind or (kind != "node" and part.var in self.alias):
                    raise CypherError(f"variable {part.var} is used twice")
                self.alias.setdefault(part.var, f"v{len(self.alias)}")
        self.find_restrictions()
        joined: DataFrame | None = None
        bound: set[str] = set()
        once: str | None = None

        def bind(node: Node, df: DataFrame | None, on: Column | None) -> DataFrame:
            if node.var in bound:  # a repeated variable: only filters and equality
                if node.labels or node.where:
                    again = self.scan_node(node, set()).withColumnRenamed(f"{self.alias[node.var]}__id", "_again")
                    df = df.join(again, F.col(f"{self.alias[node.var]}__id") == F.col("_again"), "left_semi")
                return df.where(on) if on is not None else df
            bound.add(node.var)
            scan = self.scan_node(node, used.get(node.var, set()))
            if df is None:
                return scan
            return df.join(scan, on) if on is not None else df.crossJoin(scan)

        # start where an equality holds a node, then take paths that share variables, so
        # that products stay the exception
        rest = list(q.paths)
        while rest:
            path = next((p for p in rest if any(x.var in bound for x in p[::2])), None)
            shares = path is not None
            if not shares:
                path = max(rest, key=lambda p: max(self.held(x.var) for x in p[::2]))
            rest.remove(path)
            start = max(range(0, len(path), 2), key=lambda i: path[i].var in bound if shares else self.held(path[i].var))
            # the node whose ids don't repeat in ``joined``: the very first one and, if that
            # is a single node, its neighbour
            once = once if shares else path[start].var if joined is None else None
            alone = joined is None and self.held(once) == 2
            joined = bind(path[start], joined, None)
            order = [(i, i + 1, i + 2) for i in range(start, len(path) - 1, 2)]
            order += [(i, i - 1, i - 2) for i in range(start, 1, -2)]
            for here, via, there in order:
                rel, near_node, far_node = path[via], path[here], path[there]
                scan = self.scan_rel(rel, used.get(rel.var, set()), path[via - 1], path[via + 1])
                near, far = ("a", "b") if there > here else ("b", "a")
                alias = self.alias[rel.var]
                hop = F.col(f"{self.alias[near_node.var]}__id") == F.col(f"{alias}__{near}")
                end = F.col(f"{alias}__{far}") == F.col(f"{self.alias[far_node.var]}__id")
                if near_node.var != once and far_node.var in self.restricted and far_node.var not in bound:
                    joined = joined.join(bind(far_node, scan, end), hop)
                else:
                    joined = bind(far_node, joined.join(scan, hop), end)
                once, alone = (far_node.var if alone and rel.hops == (1, 1) else None), False
        if q.where is not None:
            joined = joined.where(self.expr(q.where))
        return self.project(joined)

    def value(self, e: Expr) -> Column:
        return self.expr(e)

    def expr(self, e: Expr) -> Column:
        op, a = e.op, e.args
        if op == "lit":
            return F.lit(a[0])
        if op == "param":
            if a[0] not in self.params:
                raise CypherError(f"no value for ${a[0]}")
            v = self.params[a[0]]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if op == "prop":
            return self.column(*a)
        if op == "var":
            if self.kinds.get(a[0]) == "node":
                return self.column(a[0], "id")
            if self.kinds.get(a[0]) == "rel":
                return F.col(f"{self.alias[a[0]]}__type")
            raise CypherError(f"unknown variable {a[0]}")
        if op == "call":
            if a[0] == "type":
                if a[1].op != "var" or self.kinds.get(a[1].args[0]) != "rel":
                    raise CypherError("type() takes a relationship")
                return F.col(f"{self.alias[a[1].args[0]]}__type")
            inner = self.expr(a[1])
            return {"tolower": F.lower, "toupper": F.upper, "size": F.size if a[1].op == "list" else F.length, "id": lambda c: c}[a[0]](inner)
        if op == "in":
            if a[1].op == "list":
                return self.expr(a[0]).isin(*(self.expr(x) for x in a[1].args)) if a[1].args else F.lit(False)
            if a[1].op == "param" and isinstance(self.params.get(a[1].args[0]), (list, tuple)):
                return self.expr(a[0]).isin(*self.params[a[1].args[0]])
            return F.array_contains(self.expr(a[1]), self.expr(a[0]))
        if op == "list":
            return F.array(*(self.expr(x) for x in a))
        if op == "agg":
            raise CypherError("an aggregate can only stand in RETURN or ORDER BY")
        if op == "star":
            return F.lit(1)
        x = [self.expr(v) for v in a]
        if op in ("and", "or"):
            return x[0] & x[1] if op == "and" else x[0] | x[1]
        return {
            "not": lambda: ~x[0], "null": lambda: x[0].isNull(), "neg": lambda: -x[0], "=": lambda: x[0] == x[1],
            "<>": lambda: x[0] != x[1], "<": lambda: x[0] < x[1], "<=": lambda: x[0] <= x[1], ">": lambda: x[0] > x[1],
            ">=": lambda: x[0] >= x[1], "starts": lambda: F.startswith(x[0], x[1]), "ends": lambda: F.endswith(x[0], x[1]),
            "contains": lambda: F.contains(x[0], x[1]), "+": lambda: x[0] + x[1], "-": lambda: x[0] - x[1],
            "*": lambda: x[0] * x[1], "/": lambda: x[0] / x[1], "%": lambda: x[0] % x[1],
        }[op]()

    def aggregate(self, e: Expr) -> Column:
        """An item with aggregates in it, over columns of the joined table."""
        if e.op == "agg":
            name, distinct, arg = e.args
            c = self.expr(arg)
            if name == "count":
                return F.countDistinct(c) if distinct else F.count(c)
            if name == "collect":
                return F.collect_set(c) if distinct else F.collect_list(c)
            plain = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name]
            return F.sumDistinct(c) if name == "sum" and distinct else plain(c)
        if not e.has_aggregate():
            return self.expr(e)
        x = [self.aggregate(v) for v in e.args]
        binary = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__, "/": Column.__truediv__, "%": Column.__mod__}
        if e.op not in binary:
            raise CypherError(f"{e.op} can't combine aggregates")
        return binary[e.op](*x)

    def project(self, joined: DataFrame) -> DataFrame:
        q = self.q
        items: list[tuple[str, Expr]] = []
        for e, name in q.items:
            if e.op == "var" and self.kinds.get(e.args[0]) in ("node", "rel"):
                props = self.graph.node_properties if self.kinds[e.args[0]] == "node" else ("type", *self.graph.edge_properties)
                for p in props:
                    one = Expr("call", ("type", e)) if p == "type" and self.kinds[e.args[0]] == "rel" else Expr("prop", (e.args[0], p))
                    items.append((f"{name or e.args[0]}.{p}", one))
            else:
                items.append((name or e.text, e))
        names = [n for n, _ in items]
        if len(set(names)) < len(names):
            raise CypherError("two columns have the same name")
        grouped = any(e.has_aggregate() for _, e in items)
        extra: list[tuple[str, Expr]] = []
        keys: list[Column] = []
        for number, (e, down) in enumerate(q.order):
            known = next((n for n, x in items if e.text == n or (e.op, e.args) == (x.op, x.args) and e.op != "agg"), None)
            if known is None:
                if q.distinct:
                    raise CypherError("ORDER BY must use returned items with DISTINCT")
                known = f"__order{number}"
                extra.append((known, e))
            c = F.col(f"`{known}`")
            keys.append(c.desc_nulls_first() if down else c.asc_nulls_last())
        every = items + extra
        if grouped:
            plain = [(n, e) for n, e in every if not e.has_aggregate()]
            sums = [self.aggregate(e).alias(n) for n, e in every if e.has_aggregate()]
            out = joined.groupBy(*(self.expr(e).alias(n) for n, e in plain)).agg(*sums)
        else:
            out = joined.select(*(self.expr(e).alias(n) for n, e in every))
        if q.distinct:
            out = out.distinct()
        if keys:
            out = out.orderBy(*keys)
        if q.skip is not None:
            out = out.offset(self.number(q.skip, "SKIP"))
        if q.limit is not None:
            out = out.limit(self.number(q.limit, "LIMIT"))
        return out.select(*(F.col(f"`{n}`") for n in names))

    def number(self, e: Expr, what: str) -> int:
        v = e.args[0] if e.op == "lit" else self.params.get(e.args[0]) if e.op == "param" else None
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise CypherError(f"{what} takes a whole number")
        return v

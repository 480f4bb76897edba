"""Plans Cypher statements: patterns become joins, updates become new snapshots.

Rows hold each variable's columns under ``variable.column``.  A node of a
pattern that is neither named nor narrowed joins no table: the schema
guarantees that an edge's ends exist.

Where the language's common meaning and a narrower one differ, the common one
holds; ``compat=True`` asks for the narrower: a pattern without an arrow follows
outgoing edges only, DISTINCT comes after SKIP and LIMIT, and =~ is false.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidCommand, TypeMismatch, ValidationError
from tessera.functions.predicates import matches, valid_pattern
from tessera.functions.values import BOOL, NUMBER, OTHER, TEXT, TIME, kind_of, property_of
from tessera.graph import DST, EDGE_COLUMNS, ID, LABEL, LABELS, NODE_COLUMNS, SRC, PropertyGraph, q
from tessera.operators import mutations
from tessera.operators.iteration import settled
from tessera.plans.cypher_parser import EdgePattern, Expr, NodePattern, Path, Return, Statement, Update, parse

#: Functions of one value: the kind they take (any for None), else the result is null.
FUNCTIONS = {
    "tolower": (TEXT, F.lower),
    "toupper": (TEXT, F.upper),
    "trim": (TEXT, F.trim),
    "size": (TEXT, lambda c: F.char_length(c).cast("long")),
    "abs": (NUMBER, F.abs),
    "tostring": (None, lambda c: c.cast("string")),
    "tointeger": (None, lambda c: c.try_cast("double").try_cast("long")),
    "tofloat": (None, lambda c: c.try_cast("double")),
}
#: Functions of all rows of a group, which the other returned values make.
GROUPED = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "avg": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "collect": lambda c: F.collect_list(c),
}

ARITHMETIC = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


@dataclass
class CypherResult:
    """kind: rows (frame), created (nodes, edges), updated or deleted (count), empty."""

    kind: str
    frame: DataFrame | None = None  # of rows
    nodes: int = 0
    edges: int = 0
    count: int = 0

    def value(self) -> Any:
        import json

        if self.kind == "rows":
            return [] if self.frame is None else [json.loads(r) for r in self.frame.toJSON().collect()]
        if self.kind == "created":
            return {"created": {"nodes": self.nodes, "edges": self.edges}}
        return {self.kind: self.count} if self.kind in ("updated", "deleted") else {}


@dataclass
class Bound:
    """A variable: what it is and the tables its rows may come from."""

    nodes: bool
    tables: list[str]
    optional: bool = False


class Rows:
    """A frame with the columns of some variables."""

    def __init__(self, graph: PropertyGraph, frame: DataFrame, bound: dict[str, Bound]):
        self.graph, self.frame, self.bound = graph, frame, bound

    def column(self, variable: str, name: str) -> Column:
        return q(f"{variable}.{name}")

    def has(self, variable: str, name: str) -> bool:
        return f"{variable}.{name}" in self.frame.columns

    def json(self, variable: str, name: str) -> bool:
        b = self.bound[variable]
        return self.graph.json_field(b.tables, name, edges=not b.nodes)

    def type(self, c: Column) -> T.DataType:
        return self.frame.select(c.alias("x")).schema[0].dataType

    # -- expressions --

    def value(self, e: Expr) -> Column:
        """The value of an expression; null also stands for none."""
        k = e.kind
        if k == "literal":
            return F.lit(e.value)
        if k == "list":
            return F.array(*[self.value(p) for p in e.parts])
        if k == "map":
            return F.struct(*[self.value(p).alias(n) for n, p in zip(e.value, e.parts, strict=True)])
        if k == "variable":
            return self.whole(e.value)
        if k == "property":
            return self.property(e)
        if k == "arithmetic":
            return self.arithmetic(e)
        if k == "negate":
            return F.negate(self.number(e.parts[0]))
        if k == "plus":
            return self.number(e.parts[0])
        if k == "column":  # a column of the plan's own
            return q(e.value)
        if k == "case":
            return self.case(e)
        if k == "call":
            return self.call(e)
        return self.truth(e)

    def case(self, e: Expr) -> Column:
        """parts: condition, value, ..., and a last value for the rest."""
        tests = [self.test(p) for p in e.parts[:-1:2]]
        values = [self.value(p) for p in e.parts[1:-1:2]] + [self.value(e.parts[-1])]
        kinds = {kind_of(t) for t in map(self.type, values) if not isinstance(t, T.NullType)}
        if len(kinds) > 1:
            raise InvalidCommand("the values of CASE must be of one kind")
        out = values[-1]
        for test, value in zip(reversed(tests), reversed(values[:-1]), strict=True):
            out = F.when(test, value).otherwise(out)
        return out

    def call(self, e: Expr) -> Column:
        name, parts = e.value, e.parts
        if name in GROUPED:
            raise InvalidCommand(f"{name} stands only by itself in RETURN")
        if name in ("id", "type", "labels") and len(parts) == 1 and parts[0].kind == "variable" and parts[0].value in self.bound:
            variable = parts[0].value
            if (name == "type") == self.bound[variable].nodes and name != "id":
                raise InvalidCommand(f"{name} takes {'an edge' if name == 'type' else 'a node'}")
            return self.column(variable, {"id": ID, "type": LABEL, "labels": LABELS}[name])
        if name == "coalesce" and parts:
            return F.coalesce(*map(self.value, parts))
        if name not in FUNCTIONS or len(parts) != 1:
            raise InvalidCommand(f"function {name} is not supported")
        kind, f = FUNCTIONS[name]
        c = self.value(parts[0])
        have = kind_of(self.type(c))
        if name == "size" and have == OTHER:
            return F.size(c).cast("long")
        return f(c) if kind in (None, have) else F.lit(None).cast("string" if kind == TEXT else "double")

    def number(self, e: Expr) -> Column:
        c = self.value(e)
        return c if kind_of(self.type(c)) == NUMBER else F.lit(None).cast("double")

    def path_of(self, e: Expr) -> list[str]:
        return [*self.path_of(e.parts[0]), e.value] if e.kind == "property" else [e.value] if e.kind == "variable" else []

    def property(self, e: Expr) -> Column:
        path = self.path_of(e)
        if len(path) < 2:
            raise InvalidCommand("a property needs a variable")
        variable, names = path[0], path[1:]
        if variable not in self.bound:
            raise InvalidCommand(f"unknown variable '{variable}'")
        found = property_of(self.frame, [f"{variable}.{names[0]}", *names[1:]], lambda c: self.json(variable, names[0]))
        return F.lit(None).cast("string") if found is None else found.plain()

    def whole(self, variable: str) -> Column:
        if variable not in self.bound:
            raise InvalidCommand(f"unknown variable '{variable}'")
        b, c = self.bound[variable], functools.partial(self.column, variable)
        names = self.graph.properties(b.tables, edges=not b.nodes)
        properties = F.struct(*[c(n).alias(n) for n in names]) if names else F.create_map().cast("map<string,string>")
        if b.nodes:
            found = F.struct(c(ID).alias("id"), c(LABELS).alias("labels"), properties.alias("properties"))
        else:
            found = F.struct(c(ID).alias("id"), c(LABEL).alias("type"), c(SRC).alias("source"), c(DST).alias("target"), properties.alias("properties"))
        return F.when(c(ID).isNotNull(), found) if b.optional else found

    def arithmetic(self, e: Expr) -> Column:
        a, b = (self.value(p) for p in e.parts)
        kinds = [self.type(c) for c in (a, b)]
        if not all(isinstance(t, T.NumericType) for t in kinds):
            if any(isinstance(t, T.NullType) for t in kinds):
                return F.lit(None).cast("double")
            raise InvalidCommand(f"operator {e.value} needs numbers")
        whole = all(isinstance(t, T.IntegralType) for t in kinds)
        if e.value == "/":
            if whole:  # cuts towards zero; null for a zero divisor and for the one quotient that has no long
                odd = (b == 0) | ((b == -1) & (a.cast("long") == -(2**63)))
                return F.when(~odd, F.call_function("div", a.cast("long"), F.when(~odd, b.cast("long"))))
            return F.try_divide(a.cast("double"), b.cast("double"))
        kind = "long" if whole else "double"
        return ARITHMETIC[e.value](a.cast(kind), b.cast(kind))

    def truth(self, e: Expr) -> Column:
        """Never null: null and none are false, any other value than a boolean is true."""
        return F.coalesce(self.test(e), F.lit(False))

    def test(self, e: Expr) -> Column:
        """The same, but null may stand for false: what a filter takes, and scans and joins can use."""
        k = e.kind
        if k in ("and", "or"):
            a, b = (self.test(p) for p in e.parts)
            return a & b if k == "and" else a | b
        if k == "xor":
            a, b = (self.truth(p) for p in e.parts)
            return a != b
        if k == "not":
            return ~self.truth(e.parts[0])
        if k in ("is_null", "is_not_null"):
            inner = e.parts[0]
            c = self.column(inner.value, ID) if inner.kind == "variable" and inner.value in self.bound else self.value(inner)
            return c.isNull() if k == "is_null" else c.isNotNull()
        if k == "compare":
            tests = [self.compare(op, a, b) for op, a, b in zip(e.value, e.parts, e.parts[1:], strict=False)]
            return functools.reduce(lambda x, y: x & y, tests)
        if k == "in":
            return self.member(*e.parts)
        c = self.value(e)
        kind = self.type(c)
        if isinstance(kind, T.NullType):
            return F.lit(False)
        return c if isinstance(kind, T.BooleanType) else c.isNotNull()

    def member(self, left: Expr, right: Expr) -> Column:
        """Whether a value equals an element of a list."""
        if right.kind == "list":
            tests = [self.compare("=", left, p) for p in right.parts]
            return functools.reduce(lambda x, y: x | y, tests, F.lit(False))
        c, whole = self.value(left), self.value(right)
        kind = self.type(whole)
        if not isinstance(kind, T.ArrayType) or kind_of(kind.elementType) != kind_of(self.type(c)):
            return F.lit(False)
        return F.array_contains(whole, c)

    def same(self, a: Column, b: Column) -> Column:
        """Equality of two values of the frame; false for other kinds."""
        ta, tb = self.type(a), self.type(b)
        return a == b if kind_of(ta) == kind_of(tb) and (kind_of(ta) != OTHER or ta == tb) else F.lit(False)

    def compare(self, operator: str, left: Expr, right: Expr) -> Column:
        no = F.lit(False)
        if left.kind == right.kind == "variable":  # the same node or edge
            a, b = self.column(left.value, ID), self.column(right.value, ID)
            self.whole(left.value), self.whole(right.value)
        else:
            a, b = self.value(left), self.value(right)
        ta, tb = self.type(a), self.type(b)
        ka, kb = kind_of(ta), kind_of(tb)
        if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
            return no
        if {ka, kb} == {TIME, TEXT}:
            a, b = (c if k == TIME else F.try_to_timestamp(c) for c, k in ((a, ka), (b, kb)))
            ka = kb = TIME
        same = ka == kb and (ka != OTHER or ta == tb)
        if operator in ("=", "<>"):
            if not same:
                return a.isNotNull() & b.isNotNull() if operator == "<>" else no
            return a == b if operator == "=" else a != b
        if operator == "=~":
            if self.graph_compat or ka != TEXT or kb != TEXT:
                return no
            if right.kind == "literal":
                return a.rlike(f"^(?:{right.value})$") if valid_pattern(self.frame, right.value) else no
            return matches(a, b, whole=True)
        if operator in ("contains", "starts", "ends"):
            test = {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[operator]
            return test(a, b) if ka == kb == TEXT else no
        if not same or ka == OTHER:
            raise InvalidCommand(f"values of kinds {ka} and {kb} have no order")
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[operator]

    graph_compat = False


def renamed(frame: DataFrame, variable: str) -> DataFrame:
    return frame.select(*[q(c).alias(f"{variable}.{c}") for c in frame.columns])


def grouped(e: Expr) -> bool:
    return e.kind == "call" and e.value in GROUPED


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return [x for p in e.parts for x in conjuncts(p)] if e.kind == "and" else [e]


class Planner:
    def __init__(self, graph: PropertyGraph, compat: bool = False):
        self.graph, self.compat = graph, compat

    def rows(self, frame: DataFrame, bound: dict[str, Bound]) -> Rows:
        out = Rows(self.graph, frame, bound)
        out.graph_compat = self.compat
        return out

    def run(self, text: str) -> CypherResult:
        result = CypherResult("empty")
        for statement in parse(text):
            result = self.statement(statement)
        return result

    # -- one statement --

    def statement(self, s: Statement) -> CypherResult:
        self.preflight(s)
        rows = self.match(s) if s.match is not None else None
        if not s.updates:
            if s.result is None:
                return CypherResult("empty")
            if rows is None:  # columns, but no rows to return them for
                rows = self.rows(self.one_row().frame.where(F.lit(False)), {})
            return CypherResult("rows", self.project(s.result, rows))
        out = CypherResult("empty")
        if rows is not None:  # what is matched is fixed before anything changes
            rows = self.rows(settled(rows.frame), rows.bound)
        for u in s.updates:
            if u.kind == "create":
                rows, n, e = self.create(u.items, rows)
                out = CypherResult("created", nodes=out.nodes + n, edges=out.edges + e)
            elif u.kind == "merge":
                rows, n = self.merge(u.items[0], rows)
                out = CypherResult("created", nodes=out.nodes + n, edges=out.edges)
            elif u.kind in ("set", "remove"):
                out = CypherResult("updated", count=out.count + self.change(u, rows))
                rows = self.again(rows)
            else:
                out = CypherResult("deleted", count=out.count + self.delete(u.items, rows))
        return CypherResult("rows", self.project(s.result, rows)) if s.result is not None else out

    @staticmethod
    def preflight(s: Statement) -> None:
        """All that can be refused is refused before anything changes."""
        kinds = {u.kind for u in s.updates}
        if kinds & {"set", "remove", "delete"}:
            if s.match is None:
                raise InvalidCommand("SET, REMOVE and DELETE need a MATCH")
            if kinds & {"create", "merge"}:
                raise InvalidCommand("CREATE and MERGE can't stand with SET, REMOVE or DELETE")
            names = {p.variable for path in s.match for p in (*path.nodes, *path.edges) if p.variable}
            for u in s.updates:
                for item in u.items:
                    target = item if isinstance(item, str) else item[0]
                    if target not in names:
                        raise InvalidCommand(f"variable '{target}' is not bound by MATCH")
        for u in s.updates:
            if u.kind == "merge" and u.items[0].edges:
                raise InvalidCommand("MERGE of relationships is not supported")

    # -- MATCH --

    def match(self, s: Statement) -> Rows:
        rows = self.pattern(s.match, s.where)
        for paths, condition in s.optional:
            rows = self.optional(rows, paths, condition)
        return rows

    def pattern(self, paths: list[Path], condition: Expr | None) -> Rows:
        """The joined paths.  An equality of AND between two parts joins them; Catalyst takes the other conditions to their scans."""
        parts = [self.path(p) for p in paths]
        whole = self.rows(*parts[0])
        rest, tests = parts[1:], conjuncts(condition)
        while rest:
            # first what shares a variable or an equality with the rows so far: a cross join only if nothing does
            order = [bool(set(own) & set(whole.bound)) or bool(self.keys(whole, self.rows(part, own), tests)) for part, own in rest]
            part, own = rest.pop(order.index(True) if True in order else 0)
            whole = self.joined(whole, self.rows(part, own), tests)
        return self.rows(whole.frame.where(whole.test(condition)), whole.bound) if condition is not None else whole

    def keys(self, a: Rows, b: Rows, tests: list[Expr]) -> list[Column]:
        """Equalities between a value of ``a`` alone and one of ``b`` alone."""
        out = []
        for e in tests:
            if e.kind != "compare" or e.value != ["="]:
                continue
            for x, y in (e.parts, e.parts[::-1]):
                vx, vy = x.variables(), y.variables()
                if vx and vy and vx <= set(a.bound) and vy <= set(b.bound) and not vx & set(b.bound) and not vy & set(a.bound):
                    # typed by both sides together, resolved by the join
                    whole = self.rows(a.frame.limit(0).crossJoin(b.frame.limit(0)), a.bound | b.bound)
                    out.append(whole.compare("=", x, y))
        return out

    def joined(self, a: Rows, b: Rows, tests: list[Expr], how: str = "inner") -> Rows:
        shared = [v for v in b.bound if v in a.bound]
        for v in shared:
            if b.bound[v].nodes != a.bound[v].nodes:
                raise InvalidCommand(f"'{v}' is a node and an edge")
        part, gone = b.frame, []
        if shared:
            renames = {c: f"{c}\t2" for v in shared for c in part.columns if c.startswith(f"{v}.")}
            part, gone = part.select(*[q(c).alias(renames.get(c, c)) for c in part.columns]), list(renames.values())
        on = [q(f"{v}.{ID}") == q(f"{v}.{ID}\t2") for v in shared] + self.keys(a, b, tests)
        frame = a.frame.join(part, on, how) if on else a.frame.crossJoin(part) if how == "inner" else a.frame.join(part, F.lit(True), how)
        return self.rows(frame.drop(*gone), a.bound | {v: x for v, x in b.bound.items() if v not in a.bound})

    def optional(self, rows: Rows, paths: list[Path], condition: Expr | None) -> Rows:
        """Each row with every match of the paths, or once with nulls for their variables."""
        numbered = self.rows(settled(rows.frame.withColumn("\trow", F.monotonically_increasing_id())), rows.bound)
        found = self.joined(numbered, self.pattern(paths, None), conjuncts(condition))
        if condition is not None:
            found = self.rows(found.frame.where(found.test(condition)), found.bound)
        new = [c for c in found.frame.columns if c not in numbered.frame.columns]
        matches_ = found.frame.select(q("\trow").alias("\trow2"), *map(q, new))
        frame = numbered.frame.join(matches_, q("\trow") == q("\trow2"), "left").drop("\trow", "\trow2")
        return self.rows(frame, {v: b if v in rows.bound else Bound(b.nodes, b.tables, True) for v, b in found.bound.items()})

    def node_frame(self, p: NodePattern, variable: str) -> tuple[DataFrame, Bound]:
        label = p.labels[0] if p.labels else None
        frame = self.graph.all_nodes(label)
        for more in p.labels[1:]:
            frame = frame.where(F.array_contains(LABELS, more))
        b = Bound(True, self.graph.node_tables(label))
        return self.narrowed(renamed(frame, variable), variable, b, p.properties), b

    def narrowed(self, frame: DataFrame, variable: str, b: Bound, properties: dict[str, Expr]) -> DataFrame:
        if not properties:
            return frame
        rows = self.rows(frame, {variable: b})
        tests = [rows.compare("=", Expr("property", n, [Expr("variable", variable)]), e) for n, e in properties.items()]
        return frame.where(functools.reduce(lambda x, y: x & y, tests))

    def edge_frame(self, p: EdgePattern, variable: str, at: set[str]) -> tuple[DataFrame, Bound]:
        """Edges of the types (their own) that may touch nodes of the tables, with __from and __to."""
        for t in p.types:
            if t not in self.graph.edge_labels():
                raise InvalidCommand(f"unknown edge type '{t}'")
        ways = {"right": (SRC,), "left": (DST,), "both": (SRC,) if self.compat else (SRC, DST)}[p.direction]
        tables = [t for t in self.graph.edges if (not p.types or t in p.types) and any(self.graph.ends(t, w) & at for w in ways)]
        b = Bound(False, tables)
        frame = self.narrowed(renamed(self.graph.edge_frame(tables), variable), variable, b, p.properties)
        out: DataFrame | None = None
        for way in ways:
            other = DST if way == SRC else SRC
            part = frame.withColumns({"__from": q(f"{variable}.{way}"), "__to": q(f"{variable}.{other}")})
            out = part if out is None else out.unionAll(part)
        return out, b

    def path(self, path: Path) -> tuple[DataFrame, dict[str, Bound]]:
        name = lambda p, k, what: p.variable or f"\t{what}{k}"
        first = name(path.nodes[0], 0, "n")
        frame, b = self.node_frame(path.nodes[0], first)
        bound = {first: b}
        here, tables = f"{first}.{ID}", set(b.tables)
        for k, (e, n) in enumerate(zip(path.edges, path.nodes[1:], strict=True), 1):
            variable = name(e, k, "e")
            edges, eb = self.edge_frame(e, variable, tables)
            if variable in bound:
                raise InvalidCommand(f"'{variable}' is bound twice")
            frame = frame.join(edges, q(here) == q("__from")).drop("__from")
            bound[variable] = eb
            to = name(n, k, "n")
            sides = {"right": (DST,), "left": (SRC,), "both": (DST,) if self.compat else (DST, SRC)}[e.direction]
            tables = set().union(*(self.graph.ends(t, s) for t in eb.tables for s in sides), set())
            step = f"\tat{k}"
            frame = frame.withColumnRenamed("__to", step)
            if to in bound:  # back at a node met before
                if not bound[to].nodes:
                    raise InvalidCommand(f"'{to}' is a node and an edge")
                frame = frame.where(q(step) == q(f"{to}.{ID}"))
                again, _ = self.node_frame(n, "\tagain")
                if n.labels or n.properties:
                    frame = frame.join(again.select(q(f"\tagain.{ID}")), q(step) == q(f"\tagain.{ID}"), "left_semi")
            elif n.variable or n.labels or n.properties:
                nodes, nb = self.node_frame(n, to)
                frame = frame.join(nodes, q(step) == q(f"{to}.{ID}"))
                bound[to] = nb
                tables &= set(nb.tables)
            here = step
        steps = [c for c in frame.columns if c.startswith("\tat")]
        hidden = [v for v in bound if v.startswith("\t")]
        gone = [c for c in frame.columns if any(c.startswith(f"{v}.") for v in hidden)]
        return frame.drop(*steps, *gone), {v: b for v, b in bound.items() if v not in hidden}

    # -- RETURN --

    def project(self, ret: Return, rows: Rows) -> DataFrame:
        items = [(Expr("variable", v), None) for v in rows.bound] if ret.everything else ret.items
        if any(grouped(e) for e, _ in items):
            return self.aggregate(ret, items, rows)
        named: dict[str, Column] = {}
        for e, alias in items:
            named[alias or e.text()] = rows.value(e)
        keys: list[tuple[Column, bool]] = []
        for e, up in ret.order:
            if e.text() in named and (e.kind in ("variable", "property")):
                keys.append((named[e.text()], up))
            elif ret.distinct:
                raise InvalidCommand("with DISTINCT, ORDER BY takes returned values only")
            else:
                keys.append((rows.value(e), up))
        select = [c.alias(n) for n, c in named.items()]
        sort = [c.alias(f"__s{k}") for k, (c, _) in enumerate(keys)]
        frame = rows.frame.select(*select, *sort)
        return self.cut(ret, frame, list(named), [up for _, up in keys])

    def cut(self, ret: Return, frame: DataFrame, names: list[str], ups: list[bool]) -> DataFrame:
        """DISTINCT, ORDER BY (by __s0, __s1, ...), SKIP and LIMIT."""
        by = [q(f"__s{k}").asc_nulls_first() if up else q(f"__s{k}").desc_nulls_last() for k, up in enumerate(ups)]
        if ret.distinct and not self.compat:
            frame = frame.dropDuplicates(names)
        if by:
            frame = frame.orderBy(*by)
        if ret.skip:
            frame = frame.offset(ret.skip)
        if ret.limit is not None:
            frame = frame.limit(ret.limit)
        frame = frame.select(*[q(n) for n in names])
        return frame.dropDuplicates() if ret.distinct and self.compat else frame

    def aggregate(self, ret: Return, items: list[tuple[Expr, str | None]], rows: Rows) -> DataFrame:
        """One row a group of equal plain values; one row in all without plain values."""
        names = [alias or e.text() for e, alias in items]
        keys = [rows.value(e).alias(n) for (e, _), n in zip(items, names, strict=True) if not grouped(e)]
        found = []
        for (e, _), n in zip(items, names, strict=True):
            if grouped(e):
                inner = F.lit(1) if not e.parts else rows.column(e.parts[0].value, ID) if e.value == "count" and e.parts[0].kind == "variable" and e.parts[0].value in rows.bound else None
                if inner is None:
                    inner = rows.number(e.parts[0]) if e.value in ("sum", "avg") else rows.value(e.parts[0])
                if e.distinct:
                    found.append((F.count_distinct(inner) if e.value == "count" else F.sum_distinct(inner) if e.value == "sum" else F.collect_set(inner) if e.value == "collect" else GROUPED[e.value](inner)).alias(n))
                else:
                    found.append(GROUPED[e.value](inner).alias(n))
        frame = (rows.frame.groupBy(*keys) if keys else rows.frame.groupBy()).agg(*found).select(*map(q, names))
        texts = {e.text() if not grouped(e) else n: n for (e, _), n in zip(items, names, strict=True)} | {n: n for n in names}
        for e, _ in ret.order:
            if e.text() not in texts:
                raise InvalidCommand("with a grouped value, ORDER BY takes returned values only")
        sort = [q(texts[e.text()]).alias(f"__s{k}") for k, (e, _) in enumerate(ret.order)]
        return self.cut(ret, frame.select(*map(q, names), *sort), names, [up for _, up in ret.order])

    # -- updates --

    def one_row(self) -> Rows:
        return self.rows(self.graph.spark.range(1).toDF("__row"), {})

    def ids(self, frame: DataFrame, name: str) -> DataFrame:
        """A new id for each row, fixed by settling the frame."""
        out = settled(frame.withColumn(name, F.lit(self.graph.next_id) + F.monotonically_increasing_id()))
        top = out.agg(F.max(q(name))).first()[0]
        self.graph.next_id = self.graph.next_id if top is None else top + 1
        return out

    def typed(self, rows: Rows, properties: dict[str, Expr], kind) -> dict[str, Column]:
        """Values for a type's fields; unknown fields and wrong kinds are refused."""
        out = {}
        for name, e in properties.items():
            if name not in kind.columns:
                raise ValidationError(f"'{kind.name}' has no field '{name}'")
            out[name] = self.fitting(rows, e, kind.columns[name])
        return out

    @staticmethod
    def fitting(rows: Rows, e: Expr, f) -> Column:
        c, want = rows.value(e), f.type.spark()
        have = rows.type(c)
        if isinstance(have, T.NullType) or have == want:
            return c.cast(want)
        if f.type.json:
            return F.to_json(c) if kind_of(have) == OTHER else F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
        a, b = kind_of(have), kind_of(want)
        fits = (a == b == NUMBER and (isinstance(want, T.DoubleType) or isinstance(have, T.IntegralType))) or (a == b == OTHER)
        if a == b and a in (TEXT, BOOL, TIME) or fits:
            return c.cast(want)
        if (a, b) == (TEXT, TIME):
            return F.to_timestamp(c)
        raise TypeMismatch(f"a value of kind {a} is no {f.type.name} (field '{f.name}')")

    def create(self, paths: list[Path], rows: Rows | None) -> tuple[Rows, int, int]:
        """Once for each matched row (once without MATCH): new nodes, then edges between what is bound."""
        rows = rows or self.one_row()
        count = rows.frame.count()
        bound = dict(rows.bound)
        n_nodes = n_edges = 0
        pending: list[tuple[str, EdgePattern, str, str]] = []
        unnamed = 0
        for path in paths:
            names = []
            for p in path.nodes:
                variable = p.variable or f"\tnew{(unnamed := unnamed + 1)}"
                names.append(variable)
                if variable in bound:
                    if p.labels or p.properties:
                        raise InvalidCommand(f"'{variable}' is bound already")
                    continue
                if not p.labels:
                    raise InvalidCommand("a new node needs a label")
                rows = self.new_node(p, variable, rows)
                bound = rows.bound
                n_nodes += count
            for k, e in enumerate(path.edges):
                if len(e.types) != 1:
                    raise InvalidCommand("a new edge needs one type")
                a, b = (names[k], names[k + 1]) if e.direction != "left" else (names[k + 1], names[k])
                pending.append((e.variable or f"\tnew{(unnamed := unnamed + 1)}", e, a, b))
        for variable, e, a, b in pending:
            rows = self.new_edge(e, variable, a, b, rows)
            n_edges += count
        return rows, n_nodes, n_edges

    def new_node(self, p: NodePattern, variable: str, rows: Rows) -> Rows:
        graph, table = self.graph, p.labels[0]
        kind = graph.schema.nodes.get(table)
        if kind is None:
            raise ValidationError(f"unknown node type '{table}'")
        values = self.typed(rows, p.properties, kind)
        labels = list(dict.fromkeys([table, *p.labels[1:]]))
        for label in labels:
            if label not in graph.node_labels():
                raise ValidationError(f"unknown node label '{label}'")
        columns = {f"{variable}.{LABEL}": F.lit(table), f"{variable}.{LABELS}": F.array(*map(F.lit, labels))}
        columns |= {f"{variable}.{f.name}": values.get(f.name, F.lit(None)).cast(f.type.spark()) for f in kind.fields}
        frame = self.ids(rows.frame.withColumns(columns), f"{variable}.{ID}")
        added = frame.select(*[q(f"{variable}.{c}").alias(c) for c in (*NODE_COLUMNS, *kind.columns)])
        mutations.append_frame(graph, table, added)
        if labels[1:]:
            graph.more_node_labels.setdefault(table, set()).update(labels[1:])
        return self.rows(frame, {**rows.bound, variable: Bound(True, [table])})

    def new_edge(self, p: EdgePattern, variable: str, a: str, b: str, rows: Rows) -> Rows:
        graph, table = self.graph, p.types[0]
        kind = graph.schema.edges.get(table)
        if kind is None:
            raise ValidationError(f"unknown edge type '{table}'")
        values = self.typed(rows, p.properties, kind)
        columns = {
            f"{variable}.{SRC}": q(f"{a}.{ID}"),
            f"{variable}.{DST}": q(f"{b}.{ID}"),
            f"{variable}.{LABEL}": F.lit(table),
            f"{variable}.{LABELS}": F.array(F.lit(table)),
        }
        columns |= {f"{variable}.{f.name}": values.get(f.name, F.lit(None)).cast(f.type.spark()) for f in kind.fields}
        frame = self.ids(rows.frame.withColumns(columns), f"{variable}.{ID}")
        added = frame.select(*[q(f"{variable}.{c}").alias(c) for c in (*EDGE_COLUMNS, *kind.columns)])
        mutations.append_frame(graph, table, added, edges=True)
        return self.rows(frame, {**rows.bound, variable: Bound(False, [table])})

    def merge(self, path: Path, rows: Rows | None) -> tuple[Rows, int]:
        """The first node with the label and properties, or a new one; after MATCH, for each of its rows.

        Rows that ask for the same absent node get one new node.
        """
        p = path.nodes[0]
        if not p.labels:
            raise InvalidCommand("MERGE needs a label")
        variable = p.variable or "\tmerged"
        if rows is None:
            found, b = self.node_frame(p, variable)
            first = settled(found.orderBy(q(f"{variable}.{ID}")).limit(1))
            if not first.isEmpty():
                return self.rows(first, {variable: b}), 0
            return self.new_node(p, variable, self.one_row()), 1
        if variable in rows.bound:
            raise InvalidCommand(f"'{variable}' is bound already")
        plain = NodePattern(variable, p.labels, {})
        names = list(p.properties)
        wanted = settled(rows.frame.withColumns({f"\tkey{k}": rows.value(p.properties[n]) for k, n in enumerate(names)}))
        keys = wanted.select(*[q(f"\tkey{k}") for k in range(len(names))]).distinct() if names else self.one_row().frame
        keyed = self.rows(keys.withColumnsRenamed({f"\tkey{k}": f"\tw.{n}" for k, n in enumerate(names)}), {})

        def of(frame: DataFrame) -> DataFrame:
            """The least node of each key."""
            nodes, b = self.node_frame(plain, variable)
            both = self.rows(keyed.frame.crossJoin(nodes.limit(0)), {variable: b})
            same = [both.same(q(f"\tw.{n}"), both.property(Expr("property", n, [Expr("variable", variable)]))) for n in names]
            hits = frame.join(nodes, same) if same else frame.crossJoin(nodes)
            best = F.min_by(F.struct(*[q(c) for c in nodes.columns]), q(f"{variable}.{ID}")).alias("\tbest")
            group = [q(c) for c in frame.columns]
            return hits.groupBy(*group).agg(best).select(*group, *[F.col("`\tbest`").getField(c).alias(c) for c in nodes.columns])

        have = settled(of(keyed.frame))
        on = [q(f"\tw.{n}").eqNullSafe(q(f"\th.{n}")) for n in names]
        seen = have.select(*[q(f"\tw.{n}").alias(f"\th.{n}") for n in names]) if names else have
        # a null is never found and never equal, so each statement makes it anew, once a key
        absent = settled(keyed.frame.join(seen, on, "left_anti") if names else keyed.frame.limit(0 if not have.isEmpty() else 1))
        count = absent.count()
        if count:
            made = NodePattern(variable, p.labels, {n: Expr("column", f"\tw.{n}") for n in names})
            made_rows = self.new_node(made, variable, self.rows(absent, {}))
            have = have.unionByName(made_rows.frame.select(*[q(c) for c in made_rows.frame.columns if c in have.columns]), allowMissingColumns=True)
        back = [q(f"\tkey{k}").eqNullSafe(q(f"\tw.{n}")) for k, n in enumerate(names)]
        joined = wanted.join(have, back) if names else wanted.crossJoin(have.drop("__row"))
        joined = joined.drop(*[f"\tkey{k}" for k in range(len(names))], *[f"\tw.{n}" for n in names])
        return self.rows(joined, {**rows.bound, variable: Bound(True, self.graph.node_tables(p.labels[0]))}), count

    def change(self, u: Update, rows: Rows) -> int:
        """SET and REMOVE: of rows that give one item different values the greatest decides (rows have no order); each row and item counts."""
        count = rows.frame.count() * len(u.items)
        for item in u.items:
            variable, key = item[:2]
            b = rows.bound[variable]
            kinds = self.graph.schema.nodes if b.nodes else self.graph.schema.edges
            for table in b.tables:
                kind = kinds[table]
                mine = rows.frame.where(q(f"{variable}.{LABEL}") == table)
                if key not in kind.columns:
                    if u.kind == "set" and not mine.isEmpty():
                        raise ValidationError(f"'{table}' has no field '{key}'")
                    continue
                want = kind.columns[key].type.spark()
                value = F.lit(None).cast(want) if u.kind == "remove" else self.fitting(rows, item[2], kind.columns[key])
                changes = mine.select(q(f"{variable}.{ID}").alias(ID), value.alias(key))
                if self.several(changes):
                    rank = F.row_number().over(Window.partitionBy(ID).orderBy(q(key).desc_nulls_last()))
                    changes = changes.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
                mutations.apply_changes(self.graph, table, settled(changes), [key], edges=not b.nodes)
        return count

    @staticmethod
    def several(changes: DataFrame) -> bool:
        return not changes.groupBy(ID).count().where("count > 1").isEmpty()

    def again(self, rows: Rows) -> Rows:
        """The matched rows with the values that their nodes and edges now have."""
        frame = rows.frame.select(*[q(f"{v}.{ID}").alias(f"{v}\tid") for v in rows.bound])
        for v, b in rows.bound.items():
            now = renamed((self.graph.node_frame if b.nodes else self.graph.edge_frame)(b.tables), v)
            frame = frame.join(now, q(f"{v}\tid") == q(f"{v}.{ID}")).drop(f"{v}\tid")
        return self.rows(frame, rows.bound)

    def delete(self, variables: list[str], rows: Rows) -> int:
        """Each node (with its edges) and edge once; edges that go with a node do not count."""
        count = 0
        for v in dict.fromkeys(variables):
            ids = rows.frame.select(q(f"{v}.{ID}").alias(ID)).distinct()
            count += ids.count()
            (mutations.delete_nodes if rows.bound[v].nodes else mutations.delete_edges)(self.graph, ids, rows.bound[v].tables)
        return count


def execute(graph: PropertyGraph, text: str, compat: bool = False) -> CypherResult:
    """Runs statements in order; the last one's result.  Updates replace the graph's tables."""
    return Planner(graph, compat).run(text)


__all__ = ["CypherResult", "execute"]

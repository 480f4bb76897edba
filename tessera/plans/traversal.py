"""The traversal language: a JSON command to a lazily built DataFrame.

Only a keyed start and the levels of a deep ``Repeat`` run a job while the
plan is built.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidCommand, NodeNotFound
from tessera.functions import aggregates
from tessera.functions.predicates import UNBOUND, Predicates, bound
from tessera.functions.values import property_of
from tessera.graph import DST, ID, LABEL, LABELS, SRC, PropertyGraph, q
from tessera.local import local_rows
from tessera.operators.cursor import AT, Cursor, Order
from tessera.operators.iteration import settled

MOVES = {
    "OutEdges": (True, (SRC,)),
    "InEdges": (True, (DST,)),
    "BothEdges": (True, (SRC, DST)),
    "OutNodes": (False, (DST,)),
    "InNodes": (False, (SRC,)),
    "BothNodes": (False, (DST, SRC)),
}
ACTIONS = {*MOVES, "Filter", "HasLabel", "Dedup", "Limit", "Skip", "OrderBy", "Repeat"}
COLLECTORS = {"Nodes", "Edges", "Count", "Exists", "Path", "Aggregate", "GroupBy"}
#: Steps that look at one item at a time, so that an item met before leads to nothing new.
POINTWISE = {*MOVES, "Filter", "HasLabel", "Dedup"}
#: Levels of Repeat that stay in one lazy plan; deeper ones are settled level by level.
LAZY_LEVELS = 3

#: A registered filter: from the rows to a condition, or to the rows that pass (which must keep all columns).
CustomFilter = Callable[[DataFrame], Column | DataFrame]


@dataclass
class Result:
    """What a collector gives: its name and a DataFrame."""

    kind: str
    frame: DataFrame

    def value(self) -> Any:
        """The envelope: a count, a truth, or a list of rows without absent properties."""
        if self.kind == "Count":
            return {"count": self.frame.first()[0]}
        if self.kind == "Exists":
            return {"exists": self.frame.first()[0]}
        rows = [json.loads(r) for r in self.frame.toJSON().collect()]
        return rows[0] if self.kind == "Aggregate" else rows


def ordering_needed(steps: list[dict]) -> bool:
    return any(s["action"] in ("Limit", "Skip", "OrderBy") or ordering_needed(s.get("repeat_steps") or []) for s in steps)


class Traversal:
    def __init__(self, graph: PropertyGraph, filters: dict[str, CustomFilter] | None = None):
        self.graph, self.filters = graph, filters or {}
        self.bindings: dict[str, Any] = {}

    # -- entry --

    def run(self, command: dict | str) -> Result:
        command = json.loads(command) if isinstance(command, str) else command
        for key in ("start", "collect"):
            if key not in command:
                raise InvalidCommand(f"a command needs '{key}'")
        self.bindings = command.get("bindings") or {}
        steps = command.get("steps") or []
        self.check(steps)
        cursor = self.start(command["start"], ordering_needed(steps))
        for step in steps:
            cursor = self.step(cursor, step)
        return self.collect(cursor, command["collect"])

    def check(self, steps: list[dict]) -> None:
        for s in steps:
            if s.get("action") not in ACTIONS:
                raise InvalidCommand(f"unknown action '{s.get('action')}'")
            self.check(s.get("repeat_steps") or [])

    # -- start --

    def start(self, spec: dict, tracked: bool) -> Cursor:
        kind, label, graph = spec.get("type"), spec.get("label") or None, self.graph
        if kind == "AllEdges":
            cursor = Cursor(graph, False, graph.all_edges(label), tuple(graph.edge_tables(label)), tracked=tracked, bag=False)
        elif kind == "AllNodes":
            cursor = Cursor(graph, True, graph.all_nodes(label), tuple(graph.node_tables(label)), tracked=tracked, bag=False)
        else:
            cursor = self.lookup(label, spec.get("key"), bound(spec.get("value"), self.bindings), tracked)
        if not tracked:
            return cursor
        return replace(cursor, frame=cursor.frame.withColumn("__o0", q(ID)), order=(Order("__o0", True),))

    def lookup(self, label: str | None, key: str | None, value: Any, tracked: bool) -> Cursor:
        """The one node (the least id) of a type with a property's value."""
        if not label or label not in self.graph.nodes or key is None:
            raise InvalidCommand("a start node needs a node type and a key")
        rows = self.graph.node_frame([label])
        found = None
        if value is not UNBOUND and value is not None:
            wanted = Predicates(rows, lambda c: self.graph.json_field([label], c), self.bindings)
            hit = rows.where(wanted.leaf({"property": key, "operator": "Equals", "value": value}))
            found = hit.select(ID).orderBy(ID).first()
        if found is None:
            raise NodeNotFound(f"no {label} with {key} = {value!r}")
        # the id is a constant of the plan from here on, which scans and joins can use
        return Cursor(self.graph, True, rows.where(q(ID) == found[0]), (label,), tracked=tracked, bag=False)

    # -- steps --

    def step(self, cursor: Cursor, step: dict) -> Cursor:
        action, label = step["action"], step.get("label") or None
        if action in MOVES:
            edges, sides = MOVES[action]
            cursor = (cursor.to_edges if edges else cursor.to_nodes)(sides, label, action)
        elif action == "HasLabel":
            cursor = cursor.having(step.get("labels") or [])
        elif action == "Dedup":
            cursor = cursor.distinct()
        elif action == "Limit":
            cursor = cursor if step.get("count") is None else cursor.first(int(step["count"]))
        elif action == "Skip":
            cursor = cursor.after(int(step.get("skip") or 0))
        elif action == "OrderBy":
            cursor = self.order_by(cursor, step)
        elif action == "Repeat":
            cursor = self.repeat(cursor, step)
        return self.narrow(cursor, step)

    def order_by(self, cursor: Cursor, step: dict) -> Cursor:
        spec = step.get("order_by")
        if not spec:
            raise InvalidCommand("OrderBy needs order_by")
        cursor = cursor.filled()
        found = property_of(cursor.frame, spec["key"], cursor.is_json)
        if found is None:
            key: Column = F.lit(None).cast("string")
        elif found.type is None:  # JSON: numbers before texts
            key = F.when(found.present(), F.struct(found.as_kind("number").alias("n"), found.as_kind("text").alias("t")))
        else:
            key = found.column
        return cursor.ordered_by(key, spec.get("direction", "Asc") == "Asc")

    def narrow(self, cursor: Cursor, step: dict) -> Cursor:
        """The filters of a step, in their order, after its movement."""
        if not any(step.get(k) for k in ("filter", "compound_filter", "custom_filter", "any_key_contains")):
            return cursor
        cursor = cursor.filled()
        tests = Predicates(cursor.frame, cursor.is_json, self.bindings)
        if step.get("filter"):
            cursor = cursor.where(tests.leaf(step["filter"]))
        if step.get("compound_filter"):
            cursor = cursor.where(tests.compound(step["compound_filter"]))
        if step.get("custom_filter"):
            cursor.need(True, "custom_filter")
            found = self.filters.get(step["custom_filter"]["callback_id"])
            if found is not None:
                passed = found(cursor.frame)
                cursor = replace(cursor, frame=passed) if isinstance(passed, DataFrame) else cursor.where(F.coalesce(passed, F.lit(False)))
        if step.get("any_key_contains"):
            cursor = cursor.where(tests.any_key_contains(step["any_key_contains"], cursor.properties()))
        return cursor

    def repeat(self, cursor: Cursor, step: dict) -> Cursor:
        """The start and everything that up to max_depth rounds of the inner steps reach, each node once.

        Where the inner steps look at one item at a time, a round starts only
        from nodes not met before; otherwise from the whole bag of the last one.
        """
        cursor.need(True, "Repeat")
        inner, depth = step.get("repeat_steps") or [], int(step.get("max_depth") or 1)
        if self.moves_to_edges(inner):
            return cursor.distinct()
        pointwise = all(s["action"] in POINTWISE for s in inner)
        graph = self.graph

        def bare(c: Cursor, level: int) -> DataFrame:
            keys = [F.lit(level).cast("long").alias("__level")]
            if c.order and all(isinstance(c.frame.schema[o.column].dataType, (T.LongType, T.IntegerType)) for o in c.order):
                signed = [q(o.column) if o.ascending else -q(o.column) for o in c.order]
                keys.append(F.array(*[s.cast("long") for s in signed]).alias("__trace"))
            else:
                keys.append(F.array(q(ID)).alias("__trace"))
            return c.frame.select(q(ID), *keys)

        tables = set(cursor.tables)
        seen = bare(cursor, 0)
        if cursor.bag:
            seen = first_met(seen)
        if depth > LAZY_LEVELS:
            seen = settled(seen)
        frontier = replace(cursor, frame=seen.select(ID), full=False, order=(), bag=False) if pointwise else cursor
        for level in range(1, depth + 1):
            start = frontier
            if pointwise and cursor.tracked:
                start = replace(start, frame=start.frame.withColumn("__o0", q(ID)), order=(Order("__o0", True),))
            moved = start
            for s in inner:
                moved = self.step(moved, s)
            tables |= set(moved.tables)
            rows = bare(moved, level)
            if pointwise:
                rows = first_met(rows).join(seen.select(q(ID).alias(AT)), q(ID) == q(AT), "left_anti")
            if depth > LAZY_LEVELS:
                rows = settled(rows)
                if rows.isEmpty():
                    break
            seen = seen.unionAll(rows)
            frontier = replace(moved, frame=rows.select(ID), full=False, order=(), bag=False) if pointwise else moved
        if not pointwise:
            seen = first_met(seen)
        order = (Order("__o0", True), Order("__o1", True), Order("__o2", True)) if cursor.tracked else ()
        frame = seen.select(q(ID), q("__level").alias("__o0"), q("__trace").alias("__o1"), q(ID).alias("__o2")) if order else seen.select(ID)
        known = tuple(t for t in graph.nodes if t in tables)
        return Cursor(graph, True, frame, known, full=False, order=order, tracked=cursor.tracked, bag=False)

    @staticmethod
    def moves_to_edges(steps: list[dict]) -> bool:
        moves = [MOVES[s["action"]][0] for s in steps if s["action"] in MOVES]
        return bool(moves) and moves[-1]

    # -- collectors --

    def collect(self, cursor: Cursor, spec: dict) -> Result:
        kind = spec.get("type")
        if kind not in COLLECTORS:
            raise InvalidCommand(f"unknown collector '{kind}'")
        if kind == "Count":
            return Result(kind, cursor.frame.agg(F.count(F.lit(1)).alias("count")))
        if kind == "Exists":
            return Result(kind, cursor.frame.limit(1).agg((F.count(F.lit(1)) > 0).alias("exists")))
        if kind == "Nodes":
            return Result(kind, self.nodes(cursor, spec))
        if kind == "Edges":
            return Result(kind, self.edges(cursor, spec))
        if kind == "Path":
            return Result(kind, self.path(cursor, spec))
        cursor = cursor.filled() if cursor.nodes or spec.get("key", {}).get("source") == "Edge" else cursor.to_nodes((DST,), None, kind).filled()
        find = lambda path: property_of(cursor.frame, path, cursor.is_json)
        functions = [aggregates.aggregate(f, find) for f in spec.get("functions") or []]
        if kind == "Aggregate":
            if not functions:
                raise InvalidCommand("Aggregate needs functions")
            return Result(kind, cursor.frame.agg(*functions))
        key = find(spec["key"]["property"])
        group = F.lit("null") if key is None else F.coalesce(key.text(), F.lit("null"))
        grouped = cursor.frame.groupBy(group.alias("_group"))
        rows = grouped.agg(*functions) if functions else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        return Result(kind, rows.orderBy("_group"))

    @staticmethod
    def picked(cursor: Cursor, names: list[str] | None, prefix: str = "") -> list[Column]:
        columns = cursor.properties()
        wanted = [n for n in (names or columns) if n in columns]
        show = lambda n: property_of(cursor.frame, n, cursor.is_json).plain()
        return [show(n).alias(prefix + n) for n in wanted]

    def nodes(self, cursor: Cursor, spec: dict) -> DataFrame:
        if cursor.nodes:
            cursor = cursor.filled()
            return cursor.arranged().select(*self.picked(cursor, spec.get("properties")))
        extra = spec.get("with_edges")
        ends = cursor.frame
        carried: list[Column] = []
        if extra is not None:
            match = q(LABEL) == extra["label"] if extra.get("label") else F.lit(True)
            columns = self.picked(cursor, extra.get("properties"), "edge_")
            for k, c in enumerate(columns):
                ends = ends.withColumn(f"__e{k}", F.when(match, c))
                carried.append(q(f"__e{k}").alias("edge_" + [n for n in (extra.get("properties") or cursor.properties()) if n in cursor.properties()][k]))
        tables = [t for t in self.graph.nodes if any(t in self.graph.ends(e, DST) for e in cursor.tables)]
        target = Cursor(self.graph, True, ends, tuple(tables))
        keep = [f"__e{k}" for k in range(len(carried))]
        left = ends.select(q(DST).alias(AT), *map(q, cursor.order_names), *map(q, keep))
        joined = left.join(self.graph.node_frame(tables), q(AT) == q(ID))
        target = replace(target, frame=joined, order=cursor.order, sorted=cursor.sorted)
        return target.arranged().select(*self.picked(target, spec.get("properties")), *carried)

    def edges(self, cursor: Cursor, spec: dict) -> DataFrame:
        if cursor.nodes:  # no edges: no rows
            columns = [n for n in spec.get("properties") or [] if n]
            schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
            return local_rows(self.graph.spark, [], schema)
        return cursor.arranged().select(*self.picked(cursor, spec.get("properties")))

    def path(self, cursor: Cursor, spec: dict) -> DataFrame:
        """One path of one node for each item: its label and the properties that its label's spec names (all without one)."""
        cursor = (cursor if cursor.nodes else cursor.to_nodes((DST,), None, "Path")).filled()
        specs = {s["label"]: s.get("properties") or [] for s in spec.get("node_specs") or []}
        columns = cursor.properties()
        fields = []
        for name in columns:
            hidden = [label for label, names in specs.items() if names and name not in names]
            value = property_of(cursor.frame, name, cursor.is_json).plain()
            fields.append((F.when(~q(LABEL).isin(hidden), value) if hidden else value).alias(name))
        node = F.struct(q(LABEL).alias("label"), (F.struct(*fields) if fields else F.lit(None)).alias("properties"))
        return cursor.arranged().select(F.array(node).alias("path"))


def first_met(rows: DataFrame) -> DataFrame:
    """Each id with its least level and, of these, its least trace."""
    best = F.min(F.struct("__level", "__trace")).alias("__best")
    return rows.groupBy(ID).agg(best).select(q(ID), F.col("__best.__level").alias("__level"), F.col("__best.__trace").alias("__trace"))


def traverse(graph: PropertyGraph, command: dict | str, filters: dict[str, CustomFilter] | None = None) -> Result:
    return Traversal(graph, filters).run(command)


__all__ = ["LABELS", "Result", "Traversal", "traverse"]

"""Cursors: a bag of nodes or edges as a DataFrame, and how steps move it.

A node cursor is *bare* (ids alone) until a step needs properties or labels;
then its rows are joined once, with the tables that the schema allows.  A
bare cursor lets a multi-hop walk join edges with edges and skip the node
tables between.  Order columns exist only where a later step needs an order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidCommand
from tessera.graph import DST, ID, LABELS, SRC, PropertyGraph, q

AT = "__at"


@dataclass(frozen=True)
class Order:
    column: str
    ascending: bool

    def key(self) -> Column:
        return q(self.column).asc_nulls_first() if self.ascending else q(self.column).desc_nulls_last()


@dataclass(frozen=True)
class Cursor:
    graph: PropertyGraph
    nodes: bool
    frame: DataFrame
    tables: tuple[str, ...]
    full: bool = True
    order: tuple[Order, ...] = ()
    tracked: bool = False
    sorted: bool = False  # an OrderBy step set the order
    #: the same bag of nodes may hold an id more than once
    bag: bool = True

    # -- helpers --

    def need(self, nodes: bool, what: str) -> None:
        if self.nodes != nodes:
            raise InvalidCommand(f"{what} needs a cursor of {'nodes' if nodes else 'edges'}")

    @property
    def order_names(self) -> list[str]:
        return [o.column for o in self.order]

    def with_order(self, frame: DataFrame, value: Column, ascending: bool) -> tuple[DataFrame, tuple[Order, ...]]:
        name = f"__o{len(self.order)}"
        return frame.withColumn(name, value), (*self.order, Order(name, ascending))

    def filled(self) -> Cursor:
        """With all columns of its rows."""
        if self.full:
            return self
        rows = self.graph.node_frame(self.tables)
        ids = self.frame.select(q(ID).alias(AT), *map(q, self.order_names))
        return replace(self, frame=ids.join(rows, q(AT) == q(ID)).drop(AT), full=True)

    def properties(self) -> list[str]:
        return self.graph.properties(self.tables, edges=not self.nodes)

    def is_json(self, name: str) -> bool:
        return self.graph.json_field(self.tables, name, edges=not self.nodes)

    def where(self, condition: Column) -> Cursor:
        return replace(self, frame=self.frame.where(condition))

    # -- movement --

    def to_edges(self, sides: tuple[str, ...], label: str | None, what: str) -> Cursor:
        """Edges that leave (SRC) or enter (DST) the nodes, one row for each node of the bag and edge."""
        self.need(True, what)
        graph, own = self.graph, set(self.tables)
        tables = [t for t in graph.edge_tables(label) if any(graph.ends(t, s) & own for s in sides)]
        columns = graph.properties(tables, edges=True)
        ids = self.frame.select(q(ID).alias(AT), *map(q, self.order_names))
        out: DataFrame | None = None
        order = self.order
        for branch, side in enumerate(sides):
            touching = [t for t in tables if graph.ends(t, side) & own]
            edges = graph.edge_frame(touching, columns)
            if label and any(t != label for t in touching):
                edges = edges.where(F.array_contains(LABELS, label))
            part = ids.join(edges, q(AT) == q(side)).drop(AT)
            if self.tracked:
                order = self.order
                if len(sides) > 1:
                    part, order = self.with_order(part, F.lit(branch), True)
                part, order = replace(self, order=order).with_order(part, q(ID), False)
            out = part if out is None else out.unionByName(part)
        return replace(self, nodes=False, frame=out, tables=tuple(tables), full=True, order=order, bag=True, sorted=False)

    def to_nodes(self, sides: tuple[str, ...], label: str | None, what: str) -> Cursor:
        """Nodes at one end of the edges; a label must be the node's own type."""
        self.need(False, what)
        graph = self.graph
        if label and label not in graph.node_labels():
            raise InvalidCommand(f"unknown node label '{label}'")
        ends = [set().union(*(graph.ends(t, s) for t in self.tables)) if self.tables else set() for s in sides]
        found = set().union(*ends)
        out: DataFrame | None = None
        order = self.order
        for branch, side in enumerate(sides):
            part = self.frame.select(q(side).alias(ID), *map(q, self.order_names))
            if self.tracked and len(sides) > 1:
                part, order = self.with_order(part, F.lit(branch), True)
            out = part if out is None else out.unionAll(part)
        tables = [t for t in graph.nodes if t in found and (not label or t == label)]
        moved = replace(self, nodes=True, frame=out, tables=tuple(tables), full=False, order=order, bag=True, sorted=False)
        return moved if set(tables) == found else moved.filled()

    # -- narrowing --

    def having(self, labels: list[str]) -> Cursor:
        self.need(True, "HasLabel")
        kept = self.filled()
        if not labels:
            return kept.where(F.lit(False))
        return kept.where(F.arrays_overlap(q(LABELS), F.array(*map(F.lit, labels))))

    def distinct(self) -> Cursor:
        if not self.bag:
            return self
        if not self.order:
            return replace(self, frame=self.frame.dropDuplicates([ID]), bag=False)
        # the first of each id: the least by the order keys
        return replace(self, frame=self.first_of_each(), bag=False)

    def first_of_each(self) -> DataFrame:
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy(ID).orderBy(*[o.key() for o in self.order]))
        return self.frame.withColumn("__rank", rank).where("__rank = 1").drop("__rank")

    def ordered_by(self, key: Column, ascending: bool) -> Cursor:
        """Stable: the order so far breaks ties."""
        name = f"__k{len(self.order)}"
        order = (Order(name, ascending), *self.order)
        return replace(self, frame=self.frame.withColumn(name, key), order=order, sorted=True)

    def first(self, count: int) -> Cursor:
        frame = self.frame.orderBy(*[o.key() for o in self.order]) if self.order else self.frame
        return replace(self, frame=frame.limit(count))

    def after(self, count: int) -> Cursor:
        """Without the first ``count``: these are found by a top-k and left out by their order keys, so no task gets all rows."""
        if not count:
            return self
        gone = self.frame.select(*[q(o.column).alias(f"{o.column}_") for o in self.order]).orderBy(
            *[Order(f"{o.column}_", o.ascending).key() for o in self.order]
        ).limit(count)
        same = [q(o.column).eqNullSafe(q(f"{o.column}_")) for o in self.order]
        return replace(self, frame=self.frame.join(gone, same, "left_anti"))

    def arranged(self) -> DataFrame:
        """The rows, in order where a step asked for one."""
        return self.frame.orderBy(*[o.key() for o in self.order]) if self.sorted and self.order else self.frame


__all__ = ["DST", "SRC", "Cursor", "Order"]

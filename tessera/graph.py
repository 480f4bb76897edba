"""A property graph as DataFrames: one table for each node type and each edge type.

Tables hold real columns, so that Catalyst prunes columns and pushes filters
into Parquet.  A graph is a value: changes give new DataFrames, and an older
``PropertyGraph`` still reads what it read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import DST, EDGE_COLUMNS, ID, LABEL, LABELS, NODE_COLUMNS, SRC, EdgeType, NodeType, Schema, TypeIds, struct_of
from tessera.errors import InvalidCommand
from tessera.local import local_rows


def q(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def common_type(kinds: Iterable[T.DataType]) -> T.DataType:
    """One type for a property that several tables have: wider numbers, else text."""
    kinds = list(dict.fromkeys(kinds))
    if len(kinds) == 1:
        return kinds[0]
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.LongType() if all(isinstance(k, T.IntegralType) for k in kinds) else T.DoubleType()
    return T.StringType()


def stacked(frames: list[DataFrame], keep: tuple[str, ...], columns: list[str]) -> DataFrame:
    """One bag of rows of tables with different columns; a column that a table lacks is null."""
    kinds: dict[str, T.DataType] = {}
    for c in columns:
        found = [f.schema[c].dataType for f in frames if c in f.columns]
        kinds[c] = common_type(found) if found else T.StringType()
    out: DataFrame | None = None
    for f in frames:
        wanted = [q(c) for c in keep]
        for c in columns:
            if c not in f.columns:
                wanted.append(F.lit(None).cast(kinds[c]).alias(c))
            elif f.schema[c].dataType == kinds[c]:
                wanted.append(q(c))
            elif isinstance(f.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
                wanted.append(F.to_json(q(c)).alias(c))
            else:
                wanted.append(q(c).cast(kinds[c]).alias(c))
        part = f.select(*wanted)
        out = part if out is None else out.unionAll(part)
    assert out is not None
    return out


@dataclass(frozen=True)
class Stored:
    """A table as a store holds it: the frame that reads it, its folders and its schema as JSON."""

    frame: DataFrame
    parts: list[str]
    schema: str


@dataclass(frozen=True)
class Grown:
    """A table's frame that is another one, and nothing but rows added to it."""

    frame: DataFrame
    base: DataFrame
    added: DataFrame


@dataclass
class PropertyGraph:
    """``more`` names the labels that rows of a type may carry beside its own; a label that is no type is dynamic."""

    spark: SparkSession
    schema: Schema
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    more_node_labels: dict[str, set[str]] = field(default_factory=dict)
    more_edge_labels: dict[str, set[str]] = field(default_factory=dict)
    dynamic_nodes: set[str] = field(default_factory=set)
    dynamic_edges: set[str] = field(default_factory=set)
    ids: TypeIds = field(default_factory=TypeIds)
    next_id: int = 0
    #: The version that the graph was read from, its tables there, and those that rows were appended to since.
    version: str | None = None
    stored: dict[str, Stored] = field(default_factory=dict)
    grown: dict[str, Grown] = field(default_factory=dict)

    def __post_init__(self):
        for name, kind in self.schema.nodes.items():
            self.ids.of(name)
            self.nodes.setdefault(name, local_rows(self.spark, [], struct_of(kind)))
        for name, kind in self.schema.edges.items():
            self.ids.of(name)
            self.edges.setdefault(name, local_rows(self.spark, [], struct_of(kind)))

    def append(self, table: str, rows: DataFrame, edges: bool = False) -> None:
        """Adds rows to a table; a column that they lack is null."""
        tables, key = (self.edges, f"edge:{table}") if edges else (self.nodes, f"node:{table}")
        old = tables[table]
        rows = old.limit(0).unionByName(rows, allowMissingColumns=True)
        tables[table] = old.unionByName(rows)
        grown = self.grown.get(key)
        if grown and grown.frame is old:
            self.grown[key] = Grown(tables[table], grown.base, grown.added.unionByName(rows))
        else:
            self.grown[key] = Grown(tables[table], old, rows)

    # -- which tables can hold what --

    def node_labels(self) -> set[str]:
        return set(self.nodes) | self.dynamic_nodes | set().union(*self.more_node_labels.values(), set())

    def edge_labels(self) -> set[str]:
        return set(self.edges) | self.dynamic_edges | set().union(*self.more_edge_labels.values(), set())

    def node_tables(self, label: str | None) -> list[str]:
        """Types whose rows may carry the label (all for None or an empty label)."""
        if not label:
            return list(self.nodes)
        if label not in self.node_labels():
            raise InvalidCommand(f"unknown node label '{label}'")
        return [t for t in self.nodes if t == label or label in self.more_node_labels.get(t, ())]

    def edge_tables(self, label: str | None) -> list[str]:
        if not label:
            return list(self.edges)
        if label not in self.edge_labels():
            raise InvalidCommand(f"unknown edge label '{label}'")
        return [t for t in self.edges if t == label or label in self.more_edge_labels.get(t, ())]

    def properties(self, tables: Iterable[str], edges: bool = False) -> list[str]:
        """Names of the properties of some types, each once."""
        source, own = (self.edges, EDGE_COLUMNS) if edges else (self.nodes, NODE_COLUMNS)
        return list(dict.fromkeys(c for t in tables for c in source[t].columns if c not in own))

    # -- tables --

    def node_frame(self, tables: Iterable[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        tables = list(self.nodes if tables is None else tables)
        columns = self.properties(tables) if columns is None else columns
        if not tables:
            kinds = ", ".join(f"`{c}` string" for c in columns)
            return local_rows(self.spark, [], f"{ID} long, {LABEL} string, {LABELS} array<string>" + (", " + kinds if kinds else ""))
        return stacked([self.nodes[t] for t in tables], NODE_COLUMNS, columns)

    def edge_frame(self, tables: Iterable[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        tables = list(self.edges if tables is None else tables)
        columns = self.properties(tables, edges=True) if columns is None else columns
        if not tables:
            kinds = ", ".join(f"`{c}` string" for c in columns)
            head = f"{ID} long, {SRC} long, {DST} long, {LABEL} string, {LABELS} array<string>"
            return local_rows(self.spark, [], head + (", " + kinds if kinds else ""))
        return stacked([self.edges[t] for t in tables], EDGE_COLUMNS, columns)

    def all_nodes(self, label: str | None = None) -> DataFrame:
        """Rows that carry the label, as their own type or beside it."""
        tables = self.node_tables(label)
        frame = self.node_frame(tables)
        return frame.where(F.array_contains(LABELS, label)) if label and any(t != label for t in tables) else frame

    def all_edges(self, label: str | None = None) -> DataFrame:
        tables = self.edge_tables(label)
        frame = self.edge_frame(tables)
        return frame.where(F.array_contains(LABELS, label)) if label and any(t != label for t in tables) else frame

    # -- what the schema says about endpoints --

    def ends(self, table: str, side: str) -> set[str]:
        """Node types at one side (SRC or DST) of an edge type."""
        kind = self.schema.edges.get(table)
        name = None if kind is None else kind.source_type if side == SRC else kind.target_type
        return {name} if name in self.nodes else set(self.nodes)

    def edge_tables_at(self, label: str | None, side: str, nodes: set[str]) -> list[str]:
        """Edge types with the label that may touch nodes of some types at a side."""
        return [t for t in self.edge_tables(label) if self.ends(t, side) & nodes]

    def node_type(self, name: str) -> NodeType:
        if name not in self.schema.nodes:
            raise InvalidCommand(f"unknown node type '{name}'")
        return self.schema.nodes[name]

    def edge_type(self, name: str) -> EdgeType:
        if name not in self.schema.edges:
            raise InvalidCommand(f"unknown edge type '{name}'")
        return self.schema.edges[name]

    def json_field(self, tables: Iterable[str], name: str, edges: bool = False) -> bool:
        """Whether a property is a Json field of one of the types."""
        kinds = self.schema.edges if edges else self.schema.nodes
        return any(name in kinds[t].columns and kinds[t].columns[name].type.json for t in tables if t in kinds)


__all__ = ["DST", "EDGE_COLUMNS", "ID", "LABEL", "LABELS", "NODE_COLUMNS", "SRC", "PropertyGraph", "q", "stacked"]

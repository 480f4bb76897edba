"""Schema objects, their rules, and their Spark types."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from tessera.errors import SchemaError

SCALARS = {
    "Int": T.LongType(),
    "Float": T.DoubleType(),
    "Boolean": T.BooleanType(),
    "DateTime": T.TimestampType(),
    "String": T.StringType(),
}
PRIMITIVES = {**SCALARS, "Json": T.StringType(), "Blob": T.BinaryType()}

#: Columns that the engine keeps beside the properties.
ID, LABEL, LABELS, SRC, DST = "__id", "__label", "__labels", "__src", "__dst"
NODE_COLUMNS, EDGE_COLUMNS = (ID, LABEL, LABELS), (ID, SRC, DST, LABEL, LABELS)
RESERVED = "__"


@dataclass(frozen=True)
class TypeExpr:
    """A field type: a primitive, List<T>, Map<K, V>, Vector<N>, NodeRef<T>, EdgeRef<T>, or the name of a user type."""

    name: str
    args: tuple[TypeExpr, ...] = ()
    size: int | None = None
    user: bool = False

    @property
    def scalar(self) -> bool:
        return not self.user and self.name in SCALARS

    @property
    def json(self) -> bool:
        return not self.user and self.name == "Json"

    def spark(self) -> T.DataType:
        if self.user or self.name in ("NodeRef", "EdgeRef"):
            return T.StringType()
        if self.name == "List":
            return T.ArrayType(self.args[0].spark())
        if self.name == "Map":
            return T.MapType(T.StringType(), self.args[1].spark())
        if self.name == "Vector":
            return T.ArrayType(T.FloatType())
        return PRIMITIVES[self.name]


@dataclass(frozen=True)
class Field:
    name: str
    type: TypeExpr
    indexed: bool = False
    unique: bool = False


@dataclass(frozen=True)
class NodeType:
    name: str
    fields: tuple[Field, ...] = ()
    params: tuple[str, ...] = ()
    extends: str | None = None

    @property
    def columns(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields}


@dataclass(frozen=True)
class EdgeType:
    name: str
    source: TypeExpr
    target: TypeExpr
    fields: tuple[Field, ...] = ()
    params: tuple[tuple[str, str | None], ...] = ()

    @property
    def columns(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields}

    def endpoint(self, expr: TypeExpr) -> str | None:
        """The node type that an endpoint must have; None where any may stand."""
        bounds = dict(self.params)
        if expr.name in bounds and expr.user:
            return bounds[expr.name]
        if expr.name == "NodeRef":
            return expr.args[0].name
        return expr.name if expr.user else None

    @property
    def source_type(self) -> str | None:
        return self.endpoint(self.source)

    @property
    def target_type(self) -> str | None:
        return self.endpoint(self.target)


@dataclass(frozen=True)
class Schema:
    nodes: dict[str, NodeType] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)

    @staticmethod
    def of(definitions: Iterable[NodeType | EdgeType]) -> Schema:
        nodes: dict[str, NodeType] = {}
        edges: dict[str, EdgeType] = {}
        for d in definitions:
            kind = nodes if isinstance(d, NodeType) else edges
            if d.name in kind:
                raise SchemaError(f"type '{d.name}' is defined twice")
            kind[d.name] = d
        return Schema(nodes, edges)

    def check(self) -> Schema:
        """Raises SchemaError where a name refers to nothing or an annotation has no meaning."""
        for node in self.nodes.values():
            if node.extends and node.extends not in self.nodes:
                raise SchemaError(f"node '{node.name}' extends unknown type '{node.extends}'")
            check_fields(f"node '{node.name}'", node.fields)
        for edge in self.edges.values():
            check_fields(f"edge '{edge.name}'", edge.fields)
            params = dict(edge.params)
            for name, bound in edge.params:
                if bound is not None and bound not in self.nodes:
                    raise SchemaError(f"edge '{edge.name}': bound '{bound}' of '{name}' is no node type")
            for side, end in (("from", edge.source), ("to", edge.target)):
                wanted = end.args[0].name if end.name == "NodeRef" else end.name if end.user else None
                if wanted is None or (end.user and wanted in params):
                    continue
                if wanted not in self.nodes:
                    raise SchemaError(f"edge '{edge.name}' {side}: '{wanted}' is no node type")
        return self

    def check_migration(self, new: Schema) -> None:
        """Types and fields may come and go; a field's type and an edge's endpoints may not change."""
        for kind, old_types, new_types in (("node", self.nodes, new.nodes), ("edge", self.edges, new.edges)):
            for name, now in new_types.items():
                before = old_types.get(name)
                if before is None:
                    continue
                for column, f in now.columns.items():
                    if column in before.columns and before.columns[column].type != f.type:
                        raise SchemaError(f"{kind} '{name}': the type of field '{column}' can't change this way")
                if kind == "edge" and (before.source, before.target) != (now.source, now.target):
                    raise SchemaError(f"edge '{name}': endpoints can't change")


def check_fields(where: str, fields: tuple[Field, ...]) -> None:
    names = set()
    for f in fields:
        if f.name in names:
            raise SchemaError(f"{where}: field '{f.name}' is defined twice")
        if f.name.startswith(RESERVED):
            raise SchemaError(f"{where}: field '{f.name}' has a reserved name (it begins with {RESERVED})")
        if (f.indexed or f.unique) and not f.type.scalar:
            raise SchemaError(f"{where}: field '{f.name}' is no scalar and can't be indexed or unique")
        names.add(f.name)


def struct_of(kind: NodeType | EdgeType) -> T.StructType:
    """The Spark schema of a type's table."""
    out = T.StructType([T.StructField(ID, T.LongType(), False)])
    if isinstance(kind, EdgeType):
        out.add(SRC, T.LongType(), False).add(DST, T.LongType(), False)
    out.add(LABEL, T.StringType(), False).add(LABELS, T.ArrayType(T.StringType()), False)
    for f in kind.fields:
        out.add(T.StructField(f.name, f.type.spark(), True, {"size": f.type.size} if f.type.size is not None else {}))
    return out


def with_fields(kind, fields: Iterable[Field]):
    return replace(kind, fields=tuple(fields))


class TypeIds:
    """Numbers of type names: from 1, ascending, never used again, kept when a type goes."""

    def __init__(self, ids: dict[str, int] | None = None):
        self.ids = dict(ids or {})

    def of(self, name: str) -> int:
        if name not in self.ids:
            self.ids[name] = max(self.ids.values(), default=0) + 1
        return self.ids[name]

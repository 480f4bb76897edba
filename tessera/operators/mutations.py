"""Changes of a graph as new table snapshots.

Every function checks first and then replaces DataFrames of the graph by
others over them (union, anti-join, projection); nothing is changed in place, so
older snapshots stay readable.
"""

from __future__ import annotations

import base64
import json
from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import DST, EDGE_COLUMNS, ID, LABEL, LABELS, NODE_COLUMNS, SRC, EdgeType, Field, NodeType, Schema, TypeExpr, struct_of
from tessera.errors import EdgeNotFound, InvalidCommand, NodeNotFound, SchemaError, TypeMismatch, UniqueViolation, ValidationError
from tessera.functions.conversions import convert, convertible
from tessera.graph import PropertyGraph, q, stacked
from tessera.local import local_rows

REPORTED = 100

# -- values --


def accepted(value: Any, kind: TypeExpr) -> bool:
    """Whether a JSON value may stand in a field; null may anywhere."""
    if value is None or kind.json:
        return True
    if kind.user or kind.name in ("NodeRef", "EdgeRef"):
        return isinstance(value, str)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind.name == "Int":
        return number and isinstance(value, int) and -(2**63) <= value < 2**63
    if kind.name == "Float":
        return number
    if kind.name == "Boolean":
        return isinstance(value, bool)
    if kind.name == "DateTime":
        return isinstance(value, (str, datetime)) or (number and isinstance(value, int))
    if kind.name == "String":
        return isinstance(value, str)
    if kind.name == "Blob":
        return isinstance(value, (str, bytes, list))
    if kind.name == "Vector":
        return isinstance(value, list) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value) and (kind.size is None or len(value) == kind.size)
    if kind.name == "List":
        return isinstance(value, list) and all(accepted(v, kind.args[0]) for v in value)
    return isinstance(value, dict) and all(accepted(v, kind.args[1]) for v in value.values())


def stored(value: Any, kind: TypeExpr) -> Any:
    """A JSON value as the field's Spark type holds it."""
    if value is None:
        return None
    if kind.json:
        return json.dumps(value, ensure_ascii=False)
    if kind.name == "Float":
        return float(value)
    if kind.name == "DateTime":
        if isinstance(value, datetime):
            return value
        if isinstance(value, int):
            return datetime.fromtimestamp(value / 1000).astimezone()
        try:
            return datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError as error:
            raise TypeMismatch(f"{value!r} is no date and time") from error
    if kind.name == "Blob":
        return bytes(value) if isinstance(value, list) else base64.b64decode(value) if isinstance(value, str) else value
    if kind.name == "Vector":
        return [float(v) for v in value]
    if kind.name == "List":
        return [stored(v, kind.args[0]) for v in value]
    if kind.name == "Map":
        return {k: stored(v, kind.args[1]) for k, v in value.items()}
    return value


def checked(where: str, properties: dict[str, Any], fields: dict[str, Field]) -> dict[str, Any]:
    for name, value in properties.items():
        if name not in fields:
            raise ValidationError(f"{where} has no field '{name}'")
        if not accepted(value, fields[name].type):
            raise TypeMismatch(f"{where}: {value!r} is no {fields[name].type.name} (field '{name}')")
    return {name: stored(v, fields[name].type) for name, v in properties.items()}


# -- where rows are --


def with_row(graph: PropertyGraph, tables: dict[str, DataFrame], id_: int) -> tuple[str, dict] | None:
    """The type and the row of an id: one job finds the type, one reads the row."""
    if not tables:
        return None
    own = EDGE_COLUMNS if tables is graph.edges else NODE_COLUMNS
    found = stacked([f.where(q(ID) == id_) for f in tables.values()], own, []).select(LABEL).first()
    return None if found is None else (found[0], tables[found[0]].where(q(ID) == id_).first().asDict())


def node_row(graph: PropertyGraph, id_: int) -> tuple[str, dict]:
    found = with_row(graph, graph.nodes, id_)
    if found is None:
        raise NodeNotFound(f"no node {id_}")
    return found


def edge_row(graph: PropertyGraph, id_: int) -> tuple[str, dict]:
    found = with_row(graph, graph.edges, id_)
    if found is None:
        raise EdgeNotFound(f"no edge {id_}")
    return found


# -- unique fields --


def check_unique(graph: PropertyGraph, table: str, added: DataFrame, instead_of: DataFrame | None = None) -> None:
    """No value of a unique field twice among the type's rows (without those replaced) and the added ones."""
    kind = graph.schema.nodes.get(table)
    names = [f.name for f in kind.fields if f.unique] if kind else []
    if not names:
        return
    rest = graph.nodes[table]
    if instead_of is not None:
        rest = rest.join(instead_of.select(ID), ID, "left_anti")
    for name in names:
        fresh = added.where(q(name).isNotNull()).select(q(name).alias("v"))
        twice = fresh.groupBy("v").count().where("count > 1").select("v")
        held = fresh.join(rest.select(q(name).alias("v")), "v", "left_semi")
        bad = twice.unionAll(held).first()
        if bad is not None:
            raise UniqueViolation(f"{table}.{name} holds {bad[0]!r} already")


def unique_violations(graph: PropertyGraph, table: str, name: str) -> DataFrame:
    """(value, count) of values that a field holds twice or more."""
    return graph.nodes[table].where(q(name).isNotNull()).groupBy(q(name).alias("value")).agg(F.count("*").alias("count")).where("count > 1")


# -- insertions --


def insert_nodes(graph: PropertyGraph, table: str, rows: list[dict[str, Any]], labels: list[str] = (), validate: bool = True) -> list[int]:
    """Adds rows of a type; the ids, in order.  ``labels`` beside the type's own; without ``validate`` unknown fields are kept out silently."""
    kind = graph.schema.nodes.get(table)
    if kind is None:
        raise ValidationError(f"unknown node type '{table}'")
    extra = [x for x in dict.fromkeys(labels) if x != table]
    for x in extra:
        if x not in graph.node_labels():
            raise ValidationError(f"unknown node label '{x}'")
    if not validate:
        rows = [{k: v for k, v in r.items() if k in kind.columns and accepted(v, kind.columns[k].type)} for r in rows]
    values = [checked(f"node '{table}'", r, kind.columns) for r in rows]
    ids = list(range(graph.next_id, graph.next_id + len(rows)))
    schema = struct_of(kind)
    data = [(i, table, [table, *extra], *[v.get(f.name) for f in kind.fields]) for i, v in zip(ids, values, strict=True)]
    added = local_rows(graph.spark, data, schema)
    check_unique(graph, table, added)
    graph.append(table, added)
    if extra:
        graph.more_node_labels.setdefault(table, set()).update(extra)
    graph.next_id += len(rows)
    return ids


def insert_edges(graph: PropertyGraph, table: str, rows: list[tuple[int, int, dict[str, Any]]], labels: list[str] = ()) -> list[int]:
    """Adds edges (source id, target id, properties); the ids, in order."""
    kind = graph.schema.edges.get(table)
    if kind is None:
        raise ValidationError(f"unknown edge type '{table}'")
    extra = [x for x in dict.fromkeys(labels) if x != table]
    for x in extra:
        if x not in graph.edge_labels():
            raise ValidationError(f"unknown edge label '{x}'")
    values = [checked(f"edge '{table}'", r, kind.columns) for _, _, r in rows]
    ids = list(range(graph.next_id, graph.next_id + len(rows)))
    data = [
        (i, s, t, table, [table, *extra], *[v.get(f.name) for f in kind.fields]) for i, (s, t, _), v in zip(ids, rows, values, strict=True)
    ]
    added = local_rows(graph.spark, data, struct_of(kind))
    check_endpoints(graph, kind, added)
    graph.append(table, added, edges=True)
    if extra:
        graph.more_edge_labels.setdefault(table, set()).update(extra)
    graph.next_id += len(rows)
    return ids


def check_endpoints(graph: PropertyGraph, kind: EdgeType, added: DataFrame) -> None:
    for side, wanted in ((SRC, kind.source_type), (DST, kind.target_type)):
        there = graph.node_frame(columns=[]).select(q(ID).alias(side), LABEL)
        bad = added.select(side).distinct().join(there, side, "left")
        missing = bad.where(q(LABEL).isNull()).first()
        if missing is not None:
            raise NodeNotFound(f"edge '{kind.name}': no node {missing[side]}")
        other = bad.where(q(LABEL) != wanted).first() if wanted else None
        if other is not None:
            raise ValidationError(f"edge '{kind.name}' needs a {wanted} at its {'start' if side == SRC else 'end'}, not a {other[LABEL]}")


def append_frame(graph: PropertyGraph, table: str, frame: DataFrame, edges: bool = False) -> None:
    """Bulk insertion of rows that already have the table's columns (ids included); checked like single ones."""
    kind = (graph.schema.edges if edges else graph.schema.nodes)[table]
    unknown = set(frame.columns) - set(struct_of(kind).names)
    if unknown:
        raise ValidationError(f"'{table}' has no field {sorted(unknown)}")
    if edges:
        check_endpoints(graph, kind, frame)
    else:
        check_unique(graph, table, frame)
    graph.append(table, frame, edges)


# -- property changes --


def patched(frame: DataFrame, changes: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the values of ``changes`` (ID, names) in place of their own; one row an id in ``changes``."""
    new = changes.select(q(ID), *[q(n).alias(f"__new_{n}") for n in names], F.lit(True).alias("__hit"))
    joined = frame.join(new, ID, "left")
    keep = [F.when(q("__hit"), q(f"__new_{c}")).otherwise(q(c)).alias(c) if c in names else q(c) for c in frame.columns]
    return joined.select(*keep)


def set_properties(graph: PropertyGraph, id_: int, properties: dict[str, Any], whole: bool, edges: bool = False) -> None:
    """Merges properties into a row, or (whole) replaces all of them."""
    table, row = (edge_row if edges else node_row)(graph, id_)
    kind = (graph.schema.edges if edges else graph.schema.nodes).get(table)
    values = checked(f"'{table}'", properties, kind.columns)
    if whole:
        values = {f.name: values.get(f.name) for f in kind.fields}
    tables = graph.edges if edges else graph.nodes
    schema = T.StructType([T.StructField(ID, T.LongType()), *[T.StructField(n, kind.columns[n].type.spark()) for n in values]])
    change = local_rows(graph.spark, [(id_, *values.values())], schema)
    if not edges:
        after = patched(tables[table].where(q(ID) == id_), change, list(values))
        check_unique(graph, table, after, instead_of=change)
    here = q(ID) == id_
    literal = {n: F.lit(None).cast(kind.columns[n].type.spark()) if v is None else constant(v, kind.columns[n].type.spark()) for n, v in values.items()}
    tables[table] = tables[table].withColumns({n: F.when(here, c).otherwise(q(n)) for n, c in literal.items()}) if literal else tables[table]


def constant(value: Any, kind: T.DataType) -> Column:
    if isinstance(value, list):
        return F.array(*[constant(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(value, dict):
        return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), constant(v, kind.valueType))]).cast(kind)
    return F.lit(None).cast(kind) if value is None else F.lit(value).cast(kind)


def apply_changes(graph: PropertyGraph, table: str, changes: DataFrame, names: list[str], edges: bool = False) -> None:
    """Many rows at once: ``changes`` has ID and the named columns."""
    tables = graph.edges if edges else graph.nodes
    if not edges:
        check_unique(graph, table, patched(tables[table].join(changes.select(ID), ID, "left_semi"), changes, names), instead_of=changes)
    tables[table] = patched(tables[table], changes, names)


# -- deletion --


def delete_nodes(graph: PropertyGraph, ids: DataFrame, tables: list[str] | None = None) -> None:
    """Without the nodes of ``ids`` (one column ID) and every edge at them; ``tables``: the types that they may have."""
    gone = ids.select(ID).distinct()
    tables = list(graph.nodes) if tables is None else tables
    for t in tables:
        graph.nodes[t] = graph.nodes[t].join(gone, ID, "left_anti").select(*map(q, graph.nodes[t].columns))
    for t, frame in graph.edges.items():
        for side in (SRC, DST):
            if graph.ends(t, side) & set(tables):
                frame = frame.join(gone.select(q(ID).alias(side)), side, "left_anti").select(*map(q, frame.columns))
        graph.edges[t] = frame


def delete_edges(graph: PropertyGraph, ids: DataFrame, tables: list[str] | None = None) -> None:
    gone = ids.select(ID).distinct()
    for t in list(graph.edges) if tables is None else tables:
        graph.edges[t] = graph.edges[t].join(gone, ID, "left_anti").select(*map(q, graph.edges[t].columns))


def delete_one(graph: PropertyGraph, id_: int, edges: bool = False) -> None:
    """The same for one id, as filters on constants."""
    table, _ = (edge_row if edges else node_row)(graph, id_)
    if edges:
        graph.edges[table] = graph.edges[table].where(q(ID) != id_)
        return
    graph.nodes[table] = graph.nodes[table].where(q(ID) != id_)
    for t, frame in graph.edges.items():
        sides = [q(s) != id_ for s in (SRC, DST) if table in graph.ends(t, s)]
        for side in sides:
            frame = frame.where(side)
        graph.edges[t] = frame


# -- labels --


def change_labels(graph: PropertyGraph, id_: int, label: str, add: bool, edges: bool = False, dynamic: bool = False) -> bool:
    """Adds or removes a label beside the type's own; whether a dynamic label was registered by this."""
    table, row = (edge_row if edges else node_row)(graph, id_)
    known = graph.edge_labels() if edges else graph.node_labels()
    created = label not in known
    if created and not dynamic:
        raise ValidationError(f"unknown label '{label}'")
    if not add and label == table:
        raise InvalidCommand("a type's own label can't be removed")
    labels = [x for x in row[LABELS] if x != label] + ([label] if add else [])
    if label == table:
        labels = row[LABELS]
    tables = graph.edges if edges else graph.nodes
    tables[table] = tables[table].withColumn(LABELS, F.when(q(ID) == id_, F.array(*map(F.lit, labels))).otherwise(q(LABELS)))
    if add and label != table:
        (graph.more_edge_labels if edges else graph.more_node_labels).setdefault(table, set()).add(label)
    if created:
        (graph.dynamic_edges if edges else graph.dynamic_nodes).add(label)
        graph.ids.of(label)
    return created


def relabel(frame: DataFrame, condition: Column, label: str, add: bool) -> DataFrame:
    """Many rows at once: adds or removes a label where the condition holds; order kept, none twice, own label stays first."""
    rest = F.array_remove(q(LABELS), label)
    changed = F.concat(rest, F.array(F.lit(label))) if add else rest
    changed = F.when(F.array_contains(LABELS, label), q(LABELS)).otherwise(changed) if add else changed
    return frame.withColumn(LABELS, F.when(condition & (q(LABEL) != label), changed).otherwise(q(LABELS)))


# -- schema changes --


def apply_schema(graph: PropertyGraph, new: Schema) -> None:
    """Checks the migration, drops what is no longer declared, adds what is new."""
    graph.schema.check_migration(new)
    new.check()
    for kinds, tables, own in ((new.nodes, graph.nodes, NODE_COLUMNS), (new.edges, graph.edges, EDGE_COLUMNS)):
        for name in [t for t in tables if t not in kinds]:
            if not tables[name].isEmpty():
                raise SchemaError(f"'{name}' still has rows")
            del tables[name]
        for name, kind in kinds.items():
            graph.ids.of(name)
            if name not in tables:
                tables[name] = local_rows(graph.spark, [], struct_of(kind))
                continue
            have = tables[name].columns
            columns = [q(c) for c in own]
            columns += [q(f.name) if f.name in have else F.lit(None).cast(f.type.spark()).alias(f.name) for f in kind.fields]
            tables[name] = tables[name].select(*columns)
    graph.schema = new


def _kind(graph: PropertyGraph, table: str, edges: bool) -> NodeType | EdgeType:
    kinds = graph.schema.edges if edges else graph.schema.nodes
    if table not in kinds:
        raise SchemaError(f"unknown type '{table}'")
    return kinds[table]


def _replace_kind(graph: PropertyGraph, kind: NodeType | EdgeType) -> None:
    nodes, edges = dict(graph.schema.nodes), dict(graph.schema.edges)
    (edges if isinstance(kind, EdgeType) else nodes)[kind.name] = kind
    graph.schema = Schema(nodes, edges).check()


def rename_field(graph: PropertyGraph, table: str, old: str, new: str, edges: bool = False) -> None:
    kind = _kind(graph, table, edges)
    if old not in kind.columns:
        raise SchemaError(f"'{table}' has no field '{old}'")
    if new in kind.columns:
        raise SchemaError(f"'{table}' has a field '{new}' already")
    fields = tuple(replace(f, name=new) if f.name == old else f for f in kind.fields)
    _replace_kind(graph, replace(kind, fields=fields))
    tables = graph.edges if edges else graph.nodes
    tables[table] = tables[table].withColumnRenamed(old, new)


def change_field_type(graph: PropertyGraph, table: str, name: str, new: str, null_on_failure: bool = False, edges: bool = False) -> dict:
    """Converts a field's values strictly.  {applied, converted, failed, failed_records (ids, 100 at most)}; nothing changes where a value fails, unless it may become null."""
    kind = _kind(graph, table, edges)
    if name not in kind.columns:
        raise SchemaError(f"'{table}' has no field '{name}'")
    old = kind.columns[name].type
    if not old.scalar or not convertible(old.name, new):
        raise SchemaError(f"a field can't change from {old.name} to {new}")
    tables = graph.edges if edges else graph.nodes
    frame = tables[table]
    value = convert(q(name), old.name, new)
    present = q(name).isNotNull()
    counts = frame.agg(F.count_if(present & value.isNotNull()).alias("ok"), F.count_if(present & value.isNull()).alias("bad")).first()
    failed = []
    if counts["bad"]:
        failed = [r[0] for r in frame.where(present & value.isNull()).select(ID).orderBy(ID).limit(REPORTED).collect()]
    applied = not counts["bad"] or null_on_failure
    if applied:
        fields = tuple(replace(f, type=TypeExpr(new)) if f.name == name else f for f in kind.fields)
        _replace_kind(graph, replace(kind, fields=fields))
        tables[table] = frame.withColumn(name, value)
        if not edges and kind.columns[name].unique and not unique_violations(graph, table, name).isEmpty():
            tables[table] = frame
            _replace_kind(graph, kind)
            raise UniqueViolation(f"{table}.{name} would hold a value twice")
    return {"applied": applied, "converted": counts["ok"] if applied else 0, "failed": counts["bad"], "failed_records": failed}


# -- checks --


def dangling(graph: PropertyGraph) -> DataFrame:
    """(label, edge_id, side, node_id) of edges at a node that is not there."""
    ids = graph.node_frame(columns=[]).select(q(ID).alias("node_id"))
    out: DataFrame | None = None
    for side in (SRC, DST):
        ends = graph.edge_frame(columns=[]).select(q(LABEL).alias("label"), q(ID).alias("edge_id"), F.lit(side.strip("_")).alias("side"), q(side).alias("node_id"))
        part = ends.join(ids, "node_id", "left_anti").select("label", "edge_id", "side", "node_id")
        out = part if out is None else out.unionAll(part)
    return out

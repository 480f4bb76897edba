"""CSV and JSON in and out.

CSV: a header with ``:TYPE``; with ``:FROM`` and ``:TO`` too, all rows are edges.
Cells may hold line feeds, so a file is one task; with ``plain`` none does and a
file is split.  JSON: items {"type", "props", "from"?, "to"?}, one a line (with or
without the brackets and commas of an array), which are read in splits; an array
laid out otherwise is one task a file.  An edge's ends are values of the nodes' id
property, or the "id" of an item without one; of nodes with the same value the
latest counts, and those of the file before those of the graph.  Rows are typed
column-wise by the schema and appended as DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import DST, ID, LABEL, LABELS, SRC, EdgeType, Field, NodeType, Schema, TypeExpr
from tessera.errors import InvalidCommand, NodeNotFound, TypeMismatch, ValidationError
from tessera.functions.conversions import convert
from tessera.graph import PropertyGraph, q
from tessera.local import local_rows
from tessera.operators import mutations
from tessera.operators.iteration import settled

TYPE, FROM, TO = ":TYPE", ":FROM", ":TO"
#: The id that a JSON item has beside its properties.
OWN = ":ID"


# -- in --


def cell(c: Column, f: Field) -> Column:
    """A CSV cell as a field's type; null where it does not fit.  An empty cell is null."""
    text = F.when(c != "", c)
    kind = f.type
    if kind.scalar and kind.name == "DateTime":
        iso = convert(text, "String", "DateTime")
        return F.coalesce(iso, F.timestamp_millis(convert(text, "String", "Int")))
    if kind.scalar and kind.name != "String":
        return convert(text, "String", kind.name)
    if kind.json:
        return text
    if kind.name == "Blob" and not kind.user:
        return F.try_to_binary(text, F.lit("base64"))
    return text if isinstance(kind.spark(), T.StringType) else F.from_json(text, kind.spark())


def inferred(c: Column) -> dict[str, Column]:
    """How a column of cells reads as each type, for a column without a declared one."""
    return {
        "Boolean": F.when(c.isin("true", "false"), c == "true"),
        "Int": convert(c, "String", "Int"),
        "Float": convert(c, "String", "Float"),
        "DateTime": F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.unix_millis(F.try_to_timestamp(c))),
    }


def infer_types(frame: DataFrame) -> dict[str, str]:
    """The type that all filled cells of each column read as; String where there is none.  One pass."""
    columns = [c for c in frame.columns if c not in (TYPE, FROM, TO)]
    kinds = ("Boolean", "Int", "Float", "DateTime")
    counts = [F.count_if(q(c) != "").alias(f"{k}n") for k, c in enumerate(columns)]
    for k, c in enumerate(columns):
        counts += [F.count_if((q(c) != "") & inferred(q(c))[t].isNotNull()).alias(f"{k}{t}") for t in kinds]
    found = frame.agg(*counts).first() if columns else {}
    return {c: next((t for t in kinds if found[f"{k}n"] and found[f"{k}{t}"] == found[f"{k}n"]), "String") for k, c in enumerate(columns)}


def read_csv(graph: PropertyGraph, path: str, plain: bool = False) -> DataFrame:
    frame = graph.spark.read.csv(path, header=True, multiLine=not plain, escape='"', inferSchema=False, nullValue="\u0000none", emptyValue="")
    if TYPE not in frame.columns:
        raise InvalidCommand(f"{path}: the header has no {TYPE}")
    return frame


def declare_types(graph: PropertyGraph, rows: DataFrame, columns: list[str], edges: bool) -> None:
    """Adds the types that the schema lacks; a field has the type that all filled cells of its column read as, and fields without cells are left out."""
    kinds = graph.schema.edges if edges else graph.schema.nodes
    fresh = []
    for name in sorted({r[0] for r in rows.select(q(TYPE)).distinct().collect()} - set(kinds)):
        mine = rows.where(q(TYPE) == name)
        found = infer_types(mine.select(*map(q, columns)))
        filled = mine.agg(*[F.max(q(c) != "").alias(f"f{k}") for k, c in enumerate(columns)]).first() if columns else []
        fields = tuple(Field(c, TypeExpr(found[c])) for c, some in zip(columns, filled, strict=True) if some)
        if not edges:
            fresh.append(NodeType(name, fields))
            continue
        latest = keys_of(graph, "id").groupBy("key").agg(F.max(ID).alias("node"))
        labels = graph.node_frame(columns=[]).select(q(ID).alias("node"), q(LABEL).alias("label"))
        ends = []
        for side in (FROM, TO):
            at = mine.select(q(side).alias("key")).join(latest, "key").join(labels, "node").select("label").distinct().limit(2).collect()
            if len(at) != 1:
                raise ValidationError(f"'{name}' has no one node type at its {side}")
            ends.append(TypeExpr(at[0][0], user=True))
        fresh.append(EdgeType(name, *ends, fields))
    if fresh:
        added = {f.name: f for f in fresh}
        schema = Schema(graph.schema.nodes, {**kinds, **added}) if edges else Schema({**kinds, **added}, graph.schema.edges)
        mutations.apply_schema(graph, schema.check())


def import_csv(graph: PropertyGraph, path: str, id_prop: str = "id", declare: bool = False, plain: bool = False) -> dict:
    """{"nodes", "edges"}: counts of rows added."""
    frame = read_csv(graph, path, plain)
    edges = FROM in frame.columns and TO in frame.columns
    columns = [c for c in frame.columns if c not in (TYPE, FROM, TO)]
    rows = settled(frame.select(q(TYPE), *([q(FROM), q(TO)] if edges else []), *map(q, columns)))
    if declare:
        declare_types(graph, rows, columns, edges)
    if edges:
        return {"nodes": 0, "edges": add_edges(graph, rows, columns, cell, id_prop)}
    return {"nodes": add_nodes(graph, rows, columns, cell), "edges": 0}


ITEM = "type string, props map<string,string>, id string, `from` string, `to` string"


def read_items(graph: PropertyGraph, path: str) -> DataFrame:
    """One row an item of JSON files: (item, good)."""
    # a line's item, without the array's brackets and the comma after it
    line = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\[\s*(?=\{|$)", ""), r"(?:(?<=\})\s*,?|^)\s*\]?,?$", "")
    lines = graph.spark.read.text(path).select(F.trim("value").alias("value"), line.alias("line"))
    whole = F.try_parse_json("line").isNotNull() & F.col("line").startswith("{")
    broken = lines.where((F.col("line") != "") & ~whole).first()
    if broken is None:
        return lines.where("line <> ''").select(F.from_json("line", ITEM).alias("item"))
    text = graph.spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+", "")).alias("value"))
    if text.where(~F.col("value").startswith("[") | F.try_parse_json("value").isNull()).first() is not None:
        raise InvalidCommand(f"{path}: neither a JSON array nor JSON lines")
    return text.select(F.explode(F.from_json("value", f"array<struct<{ITEM}>>")).alias("item"))


def import_json(graph: PropertyGraph, path: str, id_prop: str = "id") -> dict:
    """The same for JSON; each item's properties are typed by the schema."""
    item = read_items(graph, path)
    rows = settled(item.select(F.col("item.type").alias(TYPE), F.col("item.id").alias(OWN), F.col("item.from").alias(FROM), F.col("item.to").alias(TO), F.col("item.props").alias("props")))
    if rows.where(q(TYPE).isNull()).first() is not None:
        raise InvalidCommand(f"{path}: an item has no type")
    keys = [r[0] for r in rows.select(F.explode(F.map_keys("props"))).distinct().collect()]  # property names
    flat = rows.select(q(TYPE), q(OWN), q(FROM), q(TO), *[F.col("props")[k].alias(k) for k in keys])
    is_edge = q(FROM).isNotNull() & q(TO).isNotNull()
    named: list[DataFrame] = []
    count = add_nodes(graph, flat.where(~is_edge).drop(FROM, TO), keys, json_value, named)
    # nodes without an id property go by the item's own id
    own = named[0].where(q(OWN).isNotNull()).select(q(OWN).alias("key"), q(ID))
    if id_prop in keys:
        own = named[0].where(q(OWN).isNotNull() & q(id_prop).isNull()).select(q(OWN).alias("key"), q(ID))
    return {"nodes": count, "edges": add_edges(graph, flat.where(is_edge).drop(OWN), keys, json_value, id_prop, own)}


def json_value(c: Column, f: Field) -> Column:
    """A JSON value, as text (texts without quotes), as a field's type."""
    kind = f.type
    if kind.json:
        return F.when(F.try_parse_json(c).isNotNull(), c).when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6))
    return cell(c, f)


def typed(graph: PropertyGraph, rows: DataFrame, table: str, columns: list[str], read, edges: bool) -> list[Column]:
    """Columns of the table's type, all checked in one pass."""
    kind = (graph.schema.edges if edges else graph.schema.nodes)[table]
    mine = rows.where(q(TYPE) == table)
    filled = lambda c: q(c).isNotNull() & (q(c) != "")
    checks = []
    for k, c in enumerate(columns):
        bad = filled(c) if c not in kind.columns else filled(c) & read(q(c), kind.columns[c]).isNull()
        checks.append(F.count_if(bad).alias(f"c{k}"))
    found = mine.agg(*checks).first() if checks else []
    for c, n in zip(columns, found, strict=True):
        if n and c not in kind.columns:
            raise ValidationError(f"'{table}' has no field '{c}'")
        if n:
            raise TypeMismatch(f"{n} values of '{table}.{c}' are no {kind.columns[c].type.name}")
    return [read(q(c), kind.columns[c]).alias(c) for c in columns if c in kind.columns]


def tables_of(graph: PropertyGraph, rows: DataFrame, edges: bool) -> list[str]:
    known = graph.schema.edges if edges else graph.schema.nodes
    found = [r[0] for r in rows.select(q(TYPE)).distinct().collect()]
    for t in found:
        if t not in known:
            raise ValidationError(f"unknown {'edge' if edges else 'node'} type '{t}'")
    return sorted(found)


def numbered(graph: PropertyGraph, rows: DataFrame) -> DataFrame:
    out = settled(rows.withColumn(ID, F.lit(graph.next_id) + F.monotonically_increasing_id()))
    top = out.agg(F.max(ID)).first()[0]
    graph.next_id = graph.next_id if top is None else top + 1
    return out


def add_nodes(graph: PropertyGraph, rows: DataFrame, columns: list[str], read, named: list[DataFrame] | None = None) -> int:
    """Appends the rows; ``named`` takes them with their ids."""
    tables = tables_of(graph, rows, False)
    plans = {t: typed(graph, rows, t, columns, read, False) for t in tables}
    rows = numbered(graph, rows)
    for t in tables:
        frame = rows.where(q(TYPE) == t).select(q(ID), q(TYPE).alias(LABEL), F.array(q(TYPE)).alias(LABELS), *plans[t])
        mutations.append_frame(graph, t, frame)
    if named is not None:
        named.append(rows)
    return rows.count()


def keys_of(graph: PropertyGraph, id_prop: str) -> DataFrame:
    """(key, id) of the graph's nodes with a text id property."""
    out = local_rows(graph.spark, [], f"key string, {ID} long")
    for t, frame in graph.nodes.items():
        if id_prop in frame.columns and isinstance(frame.schema[id_prop].dataType, T.StringType):
            out = out.unionAll(frame.select(q(id_prop).alias("key"), q(ID)).where("key is not null"))
    return out


def add_edges(graph: PropertyGraph, rows: DataFrame, columns: list[str], read, id_prop: str, own: DataFrame | None = None) -> int:
    tables = tables_of(graph, rows, True)
    plans = {t: typed(graph, rows, t, columns, read, True) for t in tables}
    # new nodes have the highest ids, so the latest of a key is the one with the highest
    keys = keys_of(graph, id_prop)
    latest = (keys if own is None else keys.unionAll(own)).groupBy("key").agg(F.max(ID).alias("node"))
    for name, side in ((FROM, SRC), (TO, DST)):
        ends = latest.select(q("key").alias(f"{side}_key"), q("node").alias(side))
        rows = rows.join(ends, q(name) == q(f"{side}_key"), "left").drop(f"{side}_key")
    rows = numbered(graph, rows)
    lost = rows.where(q(SRC).isNull() | q(DST).isNull()).first()
    if lost is not None:
        raise NodeNotFound(f"no node for {lost[FROM]!r} -> {lost[TO]!r}")
    for t in tables:
        frame = rows.where(q(TYPE) == t).select(q(ID), q(SRC), q(DST), q(TYPE).alias(LABEL), F.array(q(TYPE)).alias(LABELS), *plans[t])
        mutations.append_frame(graph, t, frame, edges=True)
    return rows.count()


# -- out --


def shown(frame: DataFrame, name: str) -> Column:
    """A value as a CSV cell."""
    kind = frame.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(q(name)).alias(name)
    if isinstance(kind, T.BinaryType):
        return F.base64(q(name)).alias(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(q(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(name)
    return q(name).cast("string").alias(name)


def end_names(graph: PropertyGraph, id_prop: str = "id") -> DataFrame:
    """(node, name): a node's text id, else its number."""
    named = keys_of(graph, id_prop).select(q(ID).alias("node"), q("key").alias("name"))
    return graph.node_frame(columns=[]).select(q(ID).alias("node")).join(named, "node", "left").select("node", F.coalesce("name", q("node").cast("string")).alias("name"))


def edge_rows(graph: PropertyGraph, table: str) -> DataFrame:
    """The table with :FROM and :TO."""
    rows = graph.edges[table]
    for name, side in ((FROM, SRC), (TO, DST)):
        ends = end_names(graph).select(q("node").alias(side), q("name").alias(name))
        rows = rows.join(ends, side)
    return rows


def csv_frame(graph: PropertyGraph, table: str) -> DataFrame:
    """What a type's CSV holds: :TYPE (:FROM, :TO) and the properties in order of name."""
    if table in graph.nodes:
        rows, head = graph.nodes[table], [q(LABEL).alias(TYPE)]
    elif table in graph.edges:
        rows, head = edge_rows(graph, table), [q(LABEL).alias(TYPE), q(FROM), q(TO)]
    else:
        raise InvalidCommand(f"unknown type '{table}'")
    names = sorted(graph.properties([table], edges=table in graph.edges))
    return rows.select(*head, *[shown(rows, n) for n in names])


def export_csv(graph: PropertyGraph, table: str, path: str) -> None:
    csv_frame(graph, table).write.csv(path, header=True, escape='"', mode="overwrite")


def json_frame(graph: PropertyGraph, table: str | None = None) -> DataFrame:
    """(pos, value): one JSON text for each node, then each edge."""
    if table is not None and table not in graph.nodes and table not in graph.edges:
        raise InvalidCommand(f"unknown type '{table}'")
    out = local_rows(graph.spark, [], "pos int, value string")
    for t in [table] if table else [*graph.nodes, *graph.edges]:
        edge = t in graph.edges and t not in graph.nodes
        rows = edge_rows(graph, t) if edge else graph.nodes[t]
        names = graph.properties([t], edges=edge)
        props = F.struct(*[q(n) for n in names]) if names else F.create_map().cast("map<string,string>")
        ends = [q(FROM).alias("from"), q(TO).alias("to")] if edge else []
        out = out.unionAll(rows.select(F.lit(int(edge)), F.to_json(F.struct(q(LABEL).alias("type"), q(ID).alias("id"), *ends, props.alias("props")))))
    return out


def export_json(graph: PropertyGraph, path: str, table: str | None = None) -> None:
    """One item a line, in part files, which ``import_json`` reads; ``json_array`` gives the array of a small graph."""
    json_frame(graph, table).select("value").write.text(path)


def json_array(graph: PropertyGraph, table: str | None = None) -> str:
    return "[\n" + ",\n".join(r[0] for r in json_frame(graph, table).orderBy("pos").select("value").collect()) + "\n]"

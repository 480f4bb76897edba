"""``Connection``: one graph with queries, changes, transactions and a place to keep it."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from types import TracebackType
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import ddl
from tessera.catalog import DST, ID, LABELS, SRC, Schema, TypeIds
from tessera.errors import GraphError, InvalidCommand, SchemaError
from tessera.graph import PropertyGraph, q
from tessera.operators import mutations, paths
from tessera.operators.iteration import settled
from tessera.plans import cypher, traversal
from tessera.sources import store, text_files


@dataclass
class DynamicInsert:
    """A new node's id and the labels that its insertion registered."""

    id: int
    created: list[str]


def copied(graph: PropertyGraph) -> PropertyGraph:
    """A snapshot: the same DataFrames, other containers."""
    sets = lambda d: {k: set(v) for k, v in d.items()}
    return replace(
        graph,
        nodes=dict(graph.nodes),
        edges=dict(graph.edges),
        more_node_labels=sets(graph.more_node_labels),
        more_edge_labels=sets(graph.more_edge_labels),
        dynamic_nodes=set(graph.dynamic_nodes),
        dynamic_edges=set(graph.dynamic_edges),
        ids=TypeIds(graph.ids.ids),
        stored=dict(graph.stored),
        grown=dict(graph.grown),
    )


class Connection:
    """Holds a graph; outside a transaction each change of a graph with a path is committed to it at once."""

    def __init__(self, graph: PropertyGraph, path: str | None = None):
        self.graph, self.path = graph, path
        self.held: PropertyGraph | None = None
        self.filters: dict[str, traversal.CustomFilter] = {}

    # -- opening and closing --

    @staticmethod
    def open_in_memory(spark: SparkSession) -> Connection:
        return Connection(PropertyGraph(spark, Schema()))

    @staticmethod
    def create(spark: SparkSession, path: str) -> Connection:
        if store.exists(spark, path):
            raise GraphError(f"there is a graph at {path} already")
        store.save(PropertyGraph(spark, Schema()), path)
        return Connection.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Connection:
        return Connection(store.load(spark, path), path)

    def close(self) -> None:
        """An open transaction is rolled back; all else is on disk."""
        if self.held is not None:
            self.rollback_transaction()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.close()

    # -- transactions --

    def begin_transaction(self) -> None:
        if self.held is not None:
            raise InvalidCommand("a transaction is open already")
        self.held = copied(self.graph)

    def commit_transaction(self) -> None:
        if self.held is None:
            raise InvalidCommand("no transaction is open")
        self.held = None
        self.keep()

    def rollback_transaction(self) -> None:
        if self.held is None:
            raise InvalidCommand("no transaction is open")
        self.graph, self.held = self.held, None

    def transaction(self) -> Transaction:
        return Transaction(self)

    def keep(self) -> None:
        if self.path is not None and self.held is None:
            store.save(self.graph, self.path)
            self.graph = store.load(self.graph.spark, self.path)

    def change(self, do) -> Any:
        """Runs a change on a copy; the graph stays as it was if it fails."""
        before = self.graph
        self.graph = copied(before)
        try:
            out = do(self.graph)
            self.keep()
            return out
        except BaseException:
            self.graph = before
            raise

    def compact(self) -> None:
        """Cuts the lineage of a graph in memory after many small changes."""
        for frames in (self.graph.nodes, self.graph.edges):
            for name, frame in frames.items():
                frames[name] = settled(frame)

    # -- nodes and edges --

    def insert_node(self, type_name: str, props: dict | str) -> int:
        return self.change(lambda g: mutations.insert_nodes(g, type_name, [read(props)]))[0]

    def insert_nodes(self, type_name: str, rows: list[dict]) -> list[int]:
        return self.change(lambda g: mutations.insert_nodes(g, type_name, rows))

    def insert_node_with_labels(self, primary_type: str, additional_labels: list[str], props: dict | str) -> int:
        return self.change(lambda g: mutations.insert_nodes(g, primary_type, [read(props)], additional_labels, validate=False))[0]

    def insert_node_with_dynamic_labels(self, primary_type: str, additional_labels: list[str], props: dict | str) -> DynamicInsert:
        def do(g: PropertyGraph) -> DynamicInsert:
            created = [x for x in dict.fromkeys(additional_labels) if x not in g.node_labels()]
            g.dynamic_nodes.update(created)
            for x in created:
                g.ids.of(x)
            return DynamicInsert(mutations.insert_nodes(g, primary_type, [read(props)], additional_labels, validate=False)[0], created)

        return self.change(do)

    def insert_edge(self, type_name: str, source: int, target: int, props: dict | str = "{}") -> int:
        return self.change(lambda g: mutations.insert_edges(g, type_name, [(source, target, read(props))]))[0]

    def insert_edges(self, type_name: str, rows: list[tuple[int, int, dict]]) -> list[int]:
        return self.change(lambda g: mutations.insert_edges(g, type_name, rows))

    def insert_edge_with_labels(self, type_name: str, labels: list[str], source: int, target: int, props: dict | str = "{}") -> int:
        return self.change(lambda g: mutations.insert_edges(g, type_name, [(source, target, read(props))], labels))[0]

    def update_node_properties(self, id_: int, props: dict | str) -> None:
        self.change(lambda g: mutations.set_properties(g, id_, read(props), whole=True))

    def update_edge_properties(self, id_: int, props: dict | str) -> None:
        self.change(lambda g: mutations.set_properties(g, id_, read(props), whole=True, edges=True))

    def patch_node_properties(self, id_: int, patch: dict | str) -> None:
        self.change(lambda g: mutations.set_properties(g, id_, read(patch), whole=False))

    def patch_edge_properties(self, id_: int, patch: dict | str) -> None:
        self.change(lambda g: mutations.set_properties(g, id_, read(patch), whole=False, edges=True))

    def delete_node(self, id_: int) -> None:
        self.change(lambda g: mutations.delete_one(g, id_))

    def delete_edge(self, id_: int) -> None:
        self.change(lambda g: mutations.delete_one(g, id_, edges=True))

    # -- reading --

    def list_nodes(self, type_name: str | None = None) -> DataFrame:
        """All columns; an unknown type is refused."""
        return self.graph.all_nodes(type_name)

    def list_edges(self, type_name: str | None = None) -> DataFrame:
        """Edges of a type (their own)."""
        if type_name is not None and type_name not in self.graph.edges:
            raise InvalidCommand(f"unknown edge type '{type_name}'")
        return self.graph.edge_frame(None if type_name is None else [type_name])

    def count_nodes(self, type_name: str | None = None) -> int:
        """0 for an unknown type."""
        return self.graph.node_frame([t for t in self.graph.nodes if type_name in (None, t)], []).count()

    def count_edges(self, type_name: str | None = None) -> int:
        return self.graph.edge_frame([t for t in self.graph.edges if type_name in (None, t)], []).count()

    def find_all_nodes(self, type_name: str, path: Any, value: Any) -> DataFrame:
        """Nodes of a type with a property's value."""
        from tessera.functions.predicates import Predicates

        self.graph.node_type(type_name)
        rows = self.graph.node_frame([type_name])
        tests = Predicates(rows, lambda c: self.graph.json_field([type_name], c))
        return rows.where(tests.leaf({"property": path, "operator": "Equals", "value": value}))

    def find_node(self, type_name: str, path: Any, value: Any) -> int | None:
        row = self.find_all_nodes(type_name, path, value).select(ID).orderBy(ID).first()
        return None if row is None else row[0]

    def properties_of(self, id_: int, edges: bool) -> dict:
        table, _ = (mutations.edge_row if edges else mutations.node_row)(self.graph, id_)
        frame = (self.graph.edges if edges else self.graph.nodes)[table].where(q(ID) == id_)
        names = self.graph.properties([table], edges)
        found = json.loads(frame.select(F.to_json(F.struct(*map(q, names)))).first()[0]) if names else {}
        jsons = [n for n in found if self.graph.json_field([table], n, edges)]
        return found | {n: json.loads(found[n]) for n in jsons}

    def get_node_properties(self, id_: int) -> dict:
        return self.properties_of(id_, edges=False)

    def get_edge_properties(self, id_: int) -> dict:
        return self.properties_of(id_, edges=True)

    def node_exists(self, id_: int) -> bool:
        return mutations.with_row(self.graph, self.graph.nodes, id_) is not None

    def edge_exists(self, id_: int) -> bool:
        return mutations.with_row(self.graph, self.graph.edges, id_) is not None

    def get_edge_endpoints(self, id_: int) -> tuple[int, int]:
        _, row = mutations.edge_row(self.graph, id_)
        return row[SRC], row[DST]

    def get_node_type_name(self, id_: int) -> str:
        return mutations.node_row(self.graph, id_)[0]

    def get_edge_type_name(self, id_: int) -> str:
        return mutations.edge_row(self.graph, id_)[0]

    def get_node_labels(self, id_: int) -> list[str]:
        return list(mutations.node_row(self.graph, id_)[1][LABELS])

    def get_edge_labels(self, id_: int) -> list[str]:
        return list(mutations.edge_row(self.graph, id_)[1][LABELS])

    # -- labels --

    def add_node_label(self, id_: int, label: str) -> None:
        self.change(lambda g: mutations.change_labels(g, id_, label, add=True))

    def remove_node_label(self, id_: int, label: str) -> None:
        self.change(lambda g: mutations.change_labels(g, id_, label, add=False))

    def add_edge_label(self, id_: int, label: str) -> None:
        self.change(lambda g: mutations.change_labels(g, id_, label, add=True, edges=True))

    def remove_edge_label(self, id_: int, label: str) -> None:
        self.change(lambda g: mutations.change_labels(g, id_, label, add=False, edges=True))

    def add_node_label_dynamic(self, id_: int, label: str) -> bool:
        """Whether the label was new."""
        return self.change(lambda g: mutations.change_labels(g, id_, label, add=True, dynamic=True))

    def add_edge_label_dynamic(self, id_: int, label: str) -> bool:
        return self.change(lambda g: mutations.change_labels(g, id_, label, add=True, edges=True, dynamic=True))

    # -- schema --

    def apply_schema(self, text: str) -> None:
        self.change(lambda g: mutations.apply_schema(g, ddl.parse(text)))

    def get_schema_text(self) -> str:
        return ddl.unparse(self.graph.schema)

    def rename_node_field(self, type_name: str, old: str, new: str) -> None:
        self.change(lambda g: mutations.rename_field(g, type_name, old, new))

    def rename_edge_field(self, type_name: str, old: str, new: str) -> None:
        self.change(lambda g: mutations.rename_field(g, type_name, old, new, edges=True))

    def change_node_field_type(self, type_name: str, field: str, new_type: str, null_on_failure: bool = False) -> dict:
        return self.change(lambda g: mutations.change_field_type(g, type_name, field, new_type, null_on_failure))

    def change_edge_field_type(self, type_name: str, field: str, new_type: str, null_on_failure: bool = False) -> dict:
        return self.change(lambda g: mutations.change_field_type(g, type_name, field, new_type, null_on_failure, edges=True))

    def node_type_names(self) -> list[str]:
        return sorted(self.graph.schema.nodes)

    def edge_type_names(self) -> list[str]:
        return sorted(self.graph.schema.edges)

    def type_schema(self, type_name: str, edges: bool) -> list[dict]:
        kinds = self.graph.schema.edges if edges else self.graph.schema.nodes
        if type_name not in kinds:
            raise SchemaError(f"unknown type '{type_name}'")
        return [{"name": f.name, "type": ddl.type_text(f.type), "indexed": f.indexed, "unique": f.unique, "nullable": True} for f in kinds[type_name].fields]

    def node_type_schema(self, type_name: str) -> list[dict]:
        return self.type_schema(type_name, edges=False)

    def edge_type_schema(self, type_name: str) -> list[dict]:
        return self.type_schema(type_name, edges=True)

    # -- queries --

    def traverse(self, command: dict | str) -> traversal.Result:
        """A traversal as a lazy DataFrame (``frame``)."""
        return traversal.traverse(self.graph, command, self.filters)

    def execute_traversal(self, command: dict | str) -> str:
        return json.dumps(self.traverse(command).value(), ensure_ascii=False)

    def register_filter(self, name: str, condition: traversal.CustomFilter) -> None:
        self.filters[name] = condition

    def cypher(self, text: str, compat: bool = False) -> cypher.CypherResult:
        """Statements in order; all of their changes or none."""
        changes = any(s.updates for s in cypher.parse(text))
        return self.change(lambda g: cypher.execute(g, text, compat)) if changes else cypher.execute(self.graph, text, compat)

    def execute_cypher(self, text: str) -> str:
        return json.dumps(self.cypher(text).value(), ensure_ascii=False)

    def shortest_path(self, source: int, target: int, max_depth: int = 10, direction: str = "both", edge_labels: list[str] | None = None) -> dict | None:
        rows = paths.shortest_path(self.graph, source, target, max_depth, direction, edge_labels).collect()
        if not rows:
            return None
        return {"nodes": [r["node_id"] for r in rows], "edges": [r["edge_id"] for r in rows[1:]]}

    def connecting_subgraph(self, nodes: list[int], max_depth: int = 10, direction: str = "both", edge_labels: list[str] | None = None) -> dict:
        found, edges = paths.connecting_subgraph(self.graph, nodes, max_depth, direction, edge_labels)
        return {"nodes": sorted(r[0] for r in found.collect()), "edges": sorted(r[0] for r in edges.collect())}

    # -- files and care --

    def import_csv(self, path: str, id_prop: str = "id", declare: bool = False, plain: bool = False) -> dict:
        """``declare``: types that the schema lacks get the types that their cells read as; ``plain``: no cell holds a line feed, so large files are split."""
        return self.change(lambda g: text_files.import_csv(g, path, id_prop, declare, plain))

    def import_json(self, path: str, id_prop: str = "id") -> dict:
        return self.change(lambda g: text_files.import_json(g, path, id_prop))

    def export_csv(self, type_name: str, path: str) -> None:
        text_files.export_csv(self.graph, type_name, path)

    def export_json(self, path: str, type_name: str | None = None) -> None:
        text_files.export_json(self.graph, path, type_name)

    def vacuum(self) -> list[str]:
        """Rewrites the graph compactly and removes older versions."""
        if self.path is None:
            self.compact()
            return []
        if self.held is not None:
            raise InvalidCommand("a transaction is open")
        store.save(self.graph, self.path, whole=True)
        self.graph = store.load(self.graph.spark, self.path)
        return store.vacuum(self.graph.spark, self.path)

    @staticmethod
    def vacuum_file(spark: SparkSession, path: str) -> list[str]:
        """The same for a graph that is not open."""
        with Connection.open(spark, path) as c:
            return c.vacuum()

    def verify(self) -> list[str]:
        """What is wrong: edges at nodes that are not there, repeated ids."""
        bad = mutations.dangling(self.graph).limit(mutations.REPORTED).collect()
        out = [f"edge {r['edge_id']} ({r['label']}): no node {r['node_id']} at its {r['side']}" for r in bad]
        for what, frame in (("node", self.graph.node_frame(columns=[])), ("edge", self.graph.edge_frame(columns=[]))):
            twice = frame.groupBy(ID).count().where("count > 1").limit(mutations.REPORTED).collect()
            out += [f"{what} id {r[0]} stands for {r[1]} rows" for r in twice]
        return out

    def info(self) -> dict:
        if self.path is None:
            return {"nodes": {t: f.count() for t, f in self.graph.nodes.items()}, "edges": {t: f.count() for t, f in self.graph.edges.items()}}
        return store.info(self.graph.spark, self.path)


class Transaction:
    """A block of changes: kept at ``commit``, else undone when the block ends."""

    def __init__(self, connection: Connection):
        self.connection, self.open = connection, False

    def __enter__(self) -> Transaction:
        self.connection.begin_transaction()
        self.open = True
        return self

    def commit(self) -> None:
        self.connection.commit_transaction()
        self.open = False

    def rollback(self) -> None:
        self.connection.rollback_transaction()
        self.open = False

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if self.open:
            self.rollback()


def read(props: dict | str) -> dict:
    found = json.loads(props) if isinstance(props, str) else props
    if not isinstance(found, dict):
        raise InvalidCommand("properties must be an object")
    return found


__all__ = ["Connection", "DynamicInsert", "Transaction"]

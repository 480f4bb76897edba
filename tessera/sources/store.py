"""Graphs in a folder: Parquet tables and a manifest.

A table is one or more folders of Parquet.  A commit writes only what changed: rows
that were appended to a table become one more folder of it, a table that changed
otherwise is written anew, all others keep theirs.  Then the small file that names
the current folders is replaced by a rename.  Readers of an older version keep
reading it until ``vacuum`` removes it.  A table of ``MOST_PARTS`` folders is
written whole at its next change.

One writer at a time: a commit holds for the version that its graph was read from.
It claims that version's succession by a file that only one can create, and is
refused if another commit was there first.  Paths go through Hadoop's file systems,
so the folder may be on any store that Spark reads.

Edges are sorted by their start, nodes by their first unique or indexed field, so
that scans skip row groups; ids, edge ends and these fields have Bloom filters.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.catalog import DST, ID, SRC, Schema, TypeIds
from tessera.ddl import parse, unparse
from tessera.errors import Conflict, GraphError, UnsupportedVersion
from tessera.graph import PropertyGraph, Stored

FORMAT = 2
MOST_PARTS = 32
CURRENT = "CURRENT.json"


class Files:
    """What the store needs of a file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a new file takes the old one's place."""
        fresh = self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(fresh, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        files.rename(fresh, self.path(name), options)

    def claim(self, name: str) -> bool:
        """Creates an empty file; False if it is there already."""
        return self.fs.createNewFile(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, name: str = "", folders: bool = True) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name)) if s.isDirectory() == folders] if self.exists(name) else []

    def bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()


def table_name(kind: str, number: int) -> str:
    return f"{kind}-{number:05d}"


def exists(spark: SparkSession, root: str) -> bool:
    return Files(spark, root).exists(CURRENT)


def laid_out(graph: PropertyGraph, kind: str, name: str, frame: DataFrame):
    """A writer of a table's rows in the order and with the filters that lookups use."""
    if kind == "edge":
        keys, frame = [ID, DST], frame.sortWithinPartitions(SRC, DST)
    else:
        fields = [f.name for f in graph.schema.nodes[name].fields if f.unique or f.indexed] if name in graph.schema.nodes else []
        keys, frame = [ID, *fields], frame.sortWithinPartitions(*fields[:1], ID) if fields else frame
    writer = frame.write
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    return writer


def save(graph: PropertyGraph, root: str, whole: bool = False) -> str:
    """Commits the graph as the next version after the one it was read from; ``whole`` writes every table in one part."""
    files = Files(graph.spark, root)
    expected = graph.version
    version = f"v-{uuid.uuid4().hex}"
    tables = {}
    for kind, frames in (("node", graph.nodes), ("edge", graph.edges)):
        for name, frame in frames.items():
            key = f"{kind}:{name}"
            old = graph.stored.get(key)
            parts = old.parts if old else []
            grown = graph.grown.get(key)
            at = f"{version}/{table_name(kind, graph.ids.of(name))}"
            if old and frame is old.frame and not (whole and len(parts) > 1):
                tables[key] = {"parts": parts, "schema": old.schema}
                continue
            added = old and grown and grown.frame is frame and grown.base is old.frame and len(parts) < MOST_PARTS and not whole
            rows = grown.added if added else frame
            laid_out(graph, kind, name, rows).parquet(f"{files.root}/{at}")
            tables[key] = {"parts": [*parts, at] if added else [at], "schema": frame.schema.json()}
    manifest = {
        "format": FORMAT,
        "version": version,
        "schema": unparse(graph.schema),
        "ids": graph.ids.ids,
        "tables": tables,
        "next_id": graph.next_id,
        "more_node_labels": {k: sorted(v) for k, v in graph.more_node_labels.items()},
        "more_edge_labels": {k: sorted(v) for k, v in graph.more_edge_labels.items()},
        "dynamic_nodes": sorted(graph.dynamic_nodes),
        "dynamic_edges": sorted(graph.dynamic_edges),
    }
    current = json.loads(files.read(CURRENT))["version"] if files.exists(CURRENT) else None
    if current != expected or not files.claim(f"after-{expected}"):
        files.delete(version)
        raise Conflict(f"the graph at {root} was changed by another writer since it was read")
    files.write(CURRENT, json.dumps(manifest, ensure_ascii=False, indent=1))
    return version


def manifest(spark: SparkSession, root: str) -> dict:
    files = Files(spark, root)
    if not files.exists(CURRENT):
        raise GraphError(f"no graph at {root}")
    found = json.loads(files.read(CURRENT))
    if found.get("format") != FORMAT:
        raise UnsupportedVersion(f"format {found.get('format')} at {root}")
    return found


def load(spark: SparkSession, root: str) -> PropertyGraph:
    m = manifest(spark, root)
    schema: Schema = parse(m["schema"])
    frames: dict[str, dict[str, DataFrame]] = {"node": {}, "edge": {}}
    stored = {}
    for key, table in m["tables"].items():
        kind, _, name = key.partition(":")
        shape = T.StructType.fromJson(json.loads(table["schema"]))
        frame = spark.read.schema(shape).parquet(*[f"{root.rstrip('/')}/{at}" for at in table["parts"]])
        frames[kind][name] = frame
        stored[key] = Stored(frame, table["parts"], table["schema"])
    return PropertyGraph(
        spark,
        schema,
        frames["node"],
        frames["edge"],
        {k: set(v) for k, v in m["more_node_labels"].items()},
        {k: set(v) for k, v in m["more_edge_labels"].items()},
        set(m["dynamic_nodes"]),
        set(m["dynamic_edges"]),
        TypeIds(m["ids"]),
        m["next_id"],
        m["version"],
        stored,
    )


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Removes the folders that the current version does not use, and old claims (and with them one that a writer left when it broke off; none may be at work)."""
    files = Files(spark, root)
    m = manifest(spark, root)
    used = {at for table in m["tables"].values() for at in table["parts"]}
    gone = []
    for f in files.names():
        if not f.startswith("v-"):
            continue
        mine = {f"{f}/{t}" for t in files.names(f)}
        for at in [f] if not mine & used else sorted(mine - used):
            files.delete(at)
            gone.append(at)
    for f in files.names(folders=False):
        if f.startswith("after-"):
            files.delete(f)
    return gone


def info(spark: SparkSession, root: str) -> dict:
    """Format, version, bytes and rows by type."""
    m = manifest(spark, root)
    files = Files(spark, root)
    graph = load(spark, root)
    return {
        "format": m["format"],
        "version": m["version"],
        "bytes": sum(files.bytes(at) for table in m["tables"].values() for at in table["parts"]),
        "nodes": {t: f.count() for t, f in graph.nodes.items()},
        "edges": {t: f.count() for t, f in graph.edges.items()},
    }

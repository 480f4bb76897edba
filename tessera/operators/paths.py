"""Path search by breadth-first levels on DataFrames.

One search runs from all sources at once: a row (source, node) is met once, at
its least depth, with the edge and node that it was first met from.  Each level
joins the frontier with the edges, drops what was met before, and keeps one
parent for each node.  Levels are settled in the checkpoint folder.  Whether a
search is done is seen by counting which of the asked-for nodes its sources met; pairs
are never listed.  A path is walked back one level at a time, each step settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidCommand
from tessera.graph import DST, ID, SRC, PropertyGraph, q
from tessera.local import local_rows
from tessera.operators.iteration import settled

DIRECTIONS = {"outgoing": ("out",), "incoming": ("in",), "both": ("out", "in")}
MET = "source long, node long, parent long, edge long, depth int"


def steps(graph: PropertyGraph, direction: str, edge_types: list[str] | None) -> DataFrame:
    """(at, to, edge, turn) of each edge in each direction allowed; edge types are the edges' own."""
    if direction.lower() not in DIRECTIONS:
        raise InvalidCommand(f"unknown direction '{direction}'")
    for t in edge_types or ():
        if t not in graph.edge_labels():
            raise InvalidCommand(f"unknown edge label '{t}'")
    tables = [t for t in graph.edges if edge_types is None or t in edge_types]
    edges = graph.edge_frame(tables, [])
    out: DataFrame | None = None
    for turn, way in enumerate(DIRECTIONS[direction.lower()]):
        a, b = (SRC, DST) if way == "out" else (DST, SRC)
        part = edges.select(q(a).alias("at"), q(b).alias("to"), q(ID).alias("edge"), F.lit(turn).alias("turn"))
        out = part if out is None else out.unionAll(part)
    return out


def search(graph: PropertyGraph, sources: list[int], targets: list[int], max_depth: int, direction: str, edge_types: list[str] | None) -> list[DataFrame]:
    """What the searches met (source, node, parent, edge, depth) at depth 0, 1, ..., until every source has met every target but itself."""
    spark = graph.spark
    ways = steps(graph, direction, edge_types)
    frontier = local_rows(spark, [(s, s, None, None, 0) for s in dict.fromkeys(sources)], MET)
    levels, met = [frontier], frontier.select("source", "node")
    wanted = local_rows(spark, [(t,) for t in dict.fromkeys(targets)], "node long")  # one row a node asked for
    left = len(set(sources)) * len(set(targets)) - len(set(sources) & set(targets))
    for depth in range(1, max_depth + 1):
        moved = frontier.select("source", q("node").alias("at")).join(ways, "at")
        # out before in, newest edge first: the order in which neighbours are met
        first = F.min_by(F.struct("at", "edge"), F.struct("turn", -F.col("edge")))
        level = moved.groupBy("source", q("to").alias("node")).agg(first.alias("best"))
        level = level.join(met, ["source", "node"], "left_anti")
        level = settled(level.select("source", "node", F.col("best.at").alias("parent"), F.col("best.edge").alias("edge"), F.lit(depth).alias("depth")))
        size, found = level.join(wanted.withColumn("hit", F.lit(1)), "node", "left").agg(F.count("*"), F.count("hit")).first()
        if not size:
            break
        levels.append(level)
        met, frontier = met.unionAll(level.select("source", "node")), level
        left -= found
        if left <= 0:
            break
    return levels


def traced(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(source, target, pos, node, edge) of the path of each of ``ends`` (source, target) that was met, walked back from the target; edge leads to the node."""
    here: DataFrame | None = None
    out: DataFrame | None = None
    for depth in range(len(levels) - 1, -1, -1):
        # what ends at this depth, and the parents of what was one deeper
        at = ends.select("source", "target", q("target").alias("node"))
        if here is not None:
            at = at.unionAll(here.select("source", "target", q("parent").alias("node")))
        here = settled(at.join(levels[depth], ["source", "node"]).select("source", "target", q("depth").alias("pos"), "node", "edge", "parent"))
        out = here if out is None else out.unionAll(here)
    return out.drop("parent")


def shortest_path(
    graph: PropertyGraph, start: int, end: int, max_depth: int = 10, direction: str = "both", edge_types: list[str] | None = None
) -> DataFrame:
    """(pos, node_id, edge_id) along one shortest path, empty if there is none; edge_id leads to the node and is null at the start."""
    spark = graph.spark
    if start == end:
        return local_rows(spark, [(0, start, None)], "pos int, node_id long, edge_id long")
    path = traced(search(graph, [start], [end], max_depth, direction, edge_types), local_rows(spark, [(start, end)], "source long, target long"))
    return path.select("pos", q("node").alias("node_id"), q("edge").alias("edge_id")).orderBy("pos")


def connecting_subgraph(
    graph: PropertyGraph, nodes: list[int], max_depth: int = 10, direction: str = "both", edge_types: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(node_id) and (edge_id) on one shortest path between each two of the nodes, and the nodes themselves."""
    nodes = list(dict.fromkeys(nodes))
    spark = graph.spark
    own = local_rows(spark, [(n,) for n in nodes], "node_id long")
    if len(nodes) < 2:
        return own, local_rows(spark, [], "edge_id long")
    levels = search(graph, nodes, nodes, max_depth, direction, edge_types)
    # one path for each two nodes: from the one listed first
    order = local_rows(spark, list(enumerate(nodes)), "place long, node long")
    met = levels[0]
    for level in levels[1:]:
        met = met.unionAll(level)
    first = order.select(q("place").alias("from"), q("node").alias("source"))
    ends = met.join(order, "node").join(first, "source").where(q("from") < q("place")).select("source", q("node").alias("target"))
    path = traced(levels, ends)
    found = path.select(q("node").alias("node_id")).unionAll(own).distinct()
    return found, path.where("edge is not null").select(q("edge").alias("edge_id")).distinct()


def neighbors(graph: PropertyGraph, node: int, direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
    """(edge_id, node_id) next to a node, one row an edge and direction."""
    return steps(graph, direction, edge_types).where(q("at") == node).select(q("edge").alias("edge_id"), q("to").alias("node_id"))


def degrees(graph: PropertyGraph, label: str) -> DataFrame:
    """(id, out_degree, in_degree) of the nodes of a type."""
    edges = graph.edge_frame(columns=[])
    out = edges.groupBy(q(SRC).alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(q(DST).alias("id")).agg(F.count("*").alias("in_degree"))
    ids = graph.node_frame([label], []).select(q(ID).alias("id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return ids.join(out, "id", "left").join(into, "id", "left").select("id", zero("out_degree"), zero("in_degree"))


"""Named queries over the star graph and the SQL that gives the same rows on its tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import Connection, copied
from tessera.catalog import ID, LABELS, Schema
from tessera.errors import UniqueViolation
from tessera.functions.conversions import convert
from tessera.graph import PropertyGraph, q
from tessera.local import local_rows
from tessera.operators import mutations, paths
from tessera.operators.iteration import shared_folder
from tessera.plans import cypher as cypher_plan
from tessera.plans.traversal import traverse
from tessera.sources import store, text_files
from tessera.sources.tables import KEY_BITS, star_graph

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def step(action: str, label: str | None = None, **more: Any) -> dict:
    return {"action": action, **({"label": label} if label else {}), **more}


def where(name: Any, operator: str, value: Any = None) -> dict:
    return {"property": name, "operator": operator, **({} if value is None else {"value": value})}


def all_of(label: str) -> dict:
    return {"type": "AllNodes", "label": label}


def props(*names: str, **more: Any) -> dict:
    return {"type": "Nodes", "properties": list(names), **more}


GRAPHS: dict[tuple[str, str], PropertyGraph] = {}


def graph_of(spark: SparkSession, folder: str) -> PropertyGraph:
    """The star graph of a folder, to change at will; only plans are kept between calls, no data."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in GRAPHS:
        GRAPHS[key] = star_graph(spark, folder)
    return copied(GRAPHS[key])


def query(name: str, sql: str | None):
    """Registers a function of the graph as a query."""

    def add(f: Callable[[PropertyGraph], DataFrame]):
        FOUND[name] = lambda spark, folder: f(graph_of(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


def traversal(name: str, sql: str | None, start: dict, steps: list[dict], collect: dict, bindings: dict | None = None, filters: dict | None = None) -> None:
    command = {"version": 1, "bindings": bindings or {}, "start": start, "steps": steps, "collect": collect}
    query(name, sql)(lambda g: traverse(g, command, filters).frame)


def filtered(name: str, condition: str, label: str, table: str, key: str, **narrow: Any) -> None:
    """Keys of a type's nodes that pass a filter."""
    traversal(name, f"SELECT {key} FROM {table} WHERE {condition}", all_of(label), [step("Filter", **narrow)], props(key))


# -- scans and starts --

traversal("scan_all_nodes", "SELECT c_custkey, c_name FROM customer", all_of("Customer"), [], props("c_custkey", "c_name"))
traversal("scan_all_edges", "SELECT l_quantity, l_discount FROM lineitem", {"type": "AllEdges", "label": "CONTAINS"}, [], {"type": "Edges", "properties": ["l_quantity", "l_discount"]})
traversal(
    "scan_unlabeled_count",
    "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)"
    " + (SELECT count(*) FROM orders) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM events)"
    " + (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS count",
    {"type": "AllNodes", "label": ""}, [], {"type": "Count"},
)
traversal(
    "start_node_binding",
    "SELECT o_orderkey FROM orders WHERE o_custkey = 42 AND o_orderstatus = 'O'",
    {"type": "Node", "label": "Customer", "key": "c_custkey", "value": {"$bind": "customer"}},
    [step("OutEdges", "PLACED"), step("OutNodes", "Order", filter=where("o_orderstatus", "Equals", "O"))],
    props("o_orderkey"),
    {"customer": 42},
)
query("find_nodes", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#17'")(
    lambda g: Connection(g).find_all_nodes("Part", "p_brand", "Brand#17").select("p_partkey", "p_name")
)
query(
    "list_edges",
    "SELECT n_nationkey, n_regionkey FROM nation",
)(lambda g: Connection(g).list_edges("IN_REGION").select((q("__src") % (1 << KEY_BITS)).alias("n_nationkey"), (q("__dst") % (1 << KEY_BITS)).alias("n_regionkey")))


@query(
    "count_by_type",
    "SELECT 'Customer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem",
)
def count_by_type(g: PropertyGraph) -> DataFrame:
    rows = g.node_frame(["Customer", "Order", "Part"], []).select(q("__label").alias("type"))
    return rows.unionAll(g.edge_frame(["CONTAINS"], []).select("__label")).groupBy("type").agg(F.count("*").alias("n"))


# -- movement --

traversal("out_edges_out_nodes", "SELECT o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", all_of("Customer"),
          [step("Filter", filter=where("c_mktsegment", "Equals", "BUILDING")), step("OutEdges", "PLACED"), step("OutNodes", "Order")], props("o_orderkey", "o_totalprice"))
traversal("in_edges_in_nodes", "SELECT c_custkey FROM customer WHERE c_nationkey = 7", all_of("Nation"),
          [step("Filter", filter=where("n_nationkey", "Equals", 7)), step("InEdges", "LIVES_IN"), step("InNodes", "Customer")], props("c_custkey"))
traversal("both_edges_count", "SELECT (SELECT count(*) FROM nation WHERE n_nationkey = 3) + (SELECT count(*) FROM customer WHERE c_nationkey = 3) + (SELECT count(*) FROM supplier WHERE s_nationkey = 3) AS count",
          all_of("Nation"), [step("Filter", filter=where("n_nationkey", "Equals", 3)), step("BothEdges")], {"type": "Count"})
traversal("both_nodes", "SELECT n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
          {"type": "AllEdges", "label": "IN_REGION"}, [step("BothNodes")], props("n_name", "r_name"))
HOPS = [step("OutEdges", "PLACED"), step("OutNodes", "Order"), step("OutEdges", "CONTAINS"), step("OutNodes", "Part")]
TWO_HOP = "FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 5"
OF_NATION = step("Filter", filter=where("c_nationkey", "Equals", 5))
traversal("two_hop_bag", f"SELECT l_partkey AS p_partkey {TWO_HOP}", all_of("Customer"), [OF_NATION, *HOPS], props("p_partkey"))
traversal("two_hop_dedup", f"SELECT DISTINCT l_partkey AS p_partkey {TWO_HOP}", all_of("Customer"), [OF_NATION, *HOPS, step("Dedup")], props("p_partkey"))
traversal("has_label", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", all_of("Document"), [step("HasLabel", labels=["Toxic"])], props("doc_id"))
traversal("additional_label_scan", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", all_of("Labeled"), [], props("doc_id"))
traversal("order_limit_skip", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10", all_of("Customer"),
          [step("OrderBy", order_by={"key": "c_acctbal", "direction": "Desc"}), step("Skip", skip=10), step("Limit", count=20)], props("c_custkey", "c_acctbal"))
traversal("skip_alone", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 25", all_of("Customer"), [step("Skip", skip=25)], props("c_custkey"))
traversal("limit_then_filter", "SELECT c_custkey FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100) WHERE c_acctbal > 0", all_of("Customer"),
          [step("Limit", count=100, filter=where("c_acctbal", "GreaterThan", 0))], props("c_custkey"))

# -- filters --

filtered("filter_eq", "o_orderstatus = 'F'", "Order", "orders", "o_orderkey", filter=where("o_orderstatus", "Equals", "F"))
filtered("filter_ne", "o_orderstatus <> 'F'", "Order", "orders", "o_orderkey", filter=where("o_orderstatus", "NotEquals", "F"))
filtered("filter_gt", "o_totalprice > 200000", "Order", "orders", "o_orderkey", filter=where("o_totalprice", "GreaterThan", 200000))
filtered("filter_lt", "o_totalprice < 20000", "Order", "orders", "o_orderkey", filter=where("o_totalprice", "LessThan", 20000))
filtered("filter_ge", "p_size >= 40", "Part", "part", "p_partkey", filter=where("p_size", "GreaterThanOrEquals", 40))
filtered("filter_le", "p_size <= 10", "Part", "part", "p_partkey", filter=where("p_size", "LessThanOrEquals", 10))
filtered("filter_contains", "contains(p_type, 'AR')", "Part", "part", "p_partkey", filter=where("p_type", "Contains", "AR"))
filtered("filter_starts", "starts_with(p_type, 'STANDARD')", "Part", "part", "p_partkey", filter=where("p_type", "StartsWith", "STANDARD"))
filtered("filter_ends", "ends_with(c_name, '7')", "Customer", "customer", "c_custkey", filter=where("c_name", "EndsWith", "7"))
DOC = "documents LEFT JOIN labels USING (doc_id)"
filtered("filter_exists", "quality IS NOT NULL", "Document", DOC, "doc_id", filter=where("quality", "Exists"))
filtered("filter_is_null", "quality IS NULL", "Document", DOC, "doc_id", filter=where("quality", "IsNull"))
filtered("filter_regex", "regexp_matches(c_name, '0{3}4')", "Customer", "customer", "c_custkey", filter=where("c_name", "Matches", "0{3}4"))
filtered("filter_bad_regex", "false", "Customer", "customer", "c_custkey", filter=where("c_name", "Matches", "("))
filtered("filter_other_kind", "false", "Customer", "customer", "c_custkey", filter=where("c_name", "GreaterThan", 5))
traversal("filter_property_gt", "SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax", {"type": "AllEdges", "label": "CONTAINS"},
          [step("Filter", filter=where("l_discount", "PropertyGreaterThan", {"type": "property", "key": "l_tax"}))], {"type": "Edges", "properties": ["l_quantity", "l_discount", "l_tax"]})
traversal("filter_property_eq", "SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_discount = l_tax", {"type": "AllEdges", "label": "CONTAINS"},
          [step("Filter", filter=where("l_discount", "PropertyEquals", {"type": "property", "key": "l_tax"}))], {"type": "Edges", "properties": ["l_quantity", "l_discount", "l_tax"]})
traversal("filter_property_lt", "SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_discount < l_tax", {"type": "AllEdges", "label": "CONTAINS"},
          [step("Filter", filter=where("l_discount", "PropertyLessThan", {"type": "property", "key": "l_tax"}))], {"type": "Edges", "properties": ["l_quantity", "l_discount", "l_tax"]})
traversal("filter_binding", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'", all_of("Order"), [step("Filter", filter=where("o_orderpriority", "Equals", {"$bind": "p"}))],
          props("o_orderkey"), {"p": "1-URGENT"})
traversal("filter_unbound", "SELECT o_orderkey FROM orders WHERE false", all_of("Order"), [step("Filter", filter=where("o_orderpriority", "Equals", {"$bind": "q"}))], props("o_orderkey"))
filtered("filter_and_or_not", "(coalesce(quality = 1, false) AND NOT coalesce(toxic = 1, false)) OR (NOT coalesce(quality = 0, false) AND lang = 'de')", "Document", DOC, "doc_id",
         compound_filter={"operator": "Or", "filters": [
             {"operator": "And", "filters": [where("quality", "Equals", 1), {"operator": "Not", "filter": where("toxic", "Equals", 1)}]},
             {"operator": "And", "filters": [{"operator": "Not", "filter": where("quality", "Equals", 0)}, where("lang", "Equals", "de")]},
         ]})
filtered("filter_json_path", "CAST(json_extract_string(props, '$.k') AS INT) > 90", "Event", "events", "event_id", filter=where({"path": ["props", "k"]}, "GreaterThan", 90))
filtered("any_key_contains", "contains(lower(text), 'onou') OR contains(lower(lang), 'onou') OR contains(lower(source), 'onou')", "Document", "documents", "doc_id", any_key_contains="ONOU")
traversal("custom_filter", "SELECT p_partkey FROM part WHERE p_size % 7 = 3", all_of("Part"), [step("Filter", custom_filter={"callback_id": "sevens"})], props("p_partkey"),
          filters={"sevens": lambda frame: q("p_size") % 7 == 3})
traversal("custom_filter_absent", "SELECT p_partkey FROM part", all_of("Part"), [step("Filter", custom_filter={"callback_id": "nobody"})], props("p_partkey"))

# -- collectors --

traversal("nodes_with_edges", "SELECT p_partkey, l_quantity AS edge_l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45", {"type": "AllEdges", "label": "CONTAINS"},
          [step("Filter", filter=where("l_quantity", "GreaterThan", 45))], props("p_partkey", with_edges={"label": "CONTAINS", "properties": ["l_quantity"]}))
traversal("collect_exists", "SELECT count(*) > 0 AS exists FROM orders WHERE o_totalprice > 100000", all_of("Order"), [step("Filter", filter=where("o_totalprice", "GreaterThan", 100000))], {"type": "Exists"})
traversal("collect_count", "SELECT count(*) AS count FROM lineitem", all_of("Order"), [step("OutEdges", "CONTAINS")], {"type": "Count"})
query("collect_path", "SELECT 1 AS size, 'Region' AS label, r_name, NULL::INT AS r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda g: traverse(g, {"start": all_of("Nation"), "steps": [step("OutEdges", "IN_REGION"), step("OutNodes")], "collect": {"type": "Path", "node_specs": [{"label": "Region", "properties": ["r_name"]}]}})
    .frame.select(F.size("path").alias("size"), F.col("path")[0]["label"].alias("label"), *[F.col("path")[0]["properties"][c].alias(c) for c in ("r_name", "r_regionkey")])
)
SUMS = [{"func": "Count"}, {"func": "Sum", "property": "o_totalprice", "alias": "total"}, {"func": "Avg", "property": "o_totalprice"}, {"func": "Min", "property": "o_orderdate"}, {"func": "Max", "property": "o_orderpriority"}]


def rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(q(n), 2).alias(n) if t == "double" else q(n) for n, t in frame.dtypes])


query("aggregate_global", "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS avg_o_totalprice, min(o_orderdate) AS min_o_orderdate, max(o_orderpriority) AS max_o_orderpriority FROM orders")(
    lambda g: rounded(traverse(g, {"start": all_of("Order"), "collect": {"type": "Aggregate", "functions": SUMS}}).frame)
)
query("aggregate_empty", "SELECT 0 AS count, 0.0::DOUBLE AS sum_c_acctbal, NULL::DOUBLE AS avg_c_acctbal, NULL::DOUBLE AS min_c_acctbal")(
    lambda g: traverse(g, {"start": all_of("Customer"), "steps": [step("Filter", filter=where("c_custkey", "LessThan", 0))], "collect": {"type": "Aggregate", "functions": [
        {"func": "Count"}, *({"func": f, "property": "c_acctbal"} for f in ("Sum", "Avg", "Min"))]}}).frame
)
query("group_by_node", "SELECT c_mktsegment AS _group, count(*) AS n, round(sum(c_acctbal), 2) AS sum_c_acctbal, max(c_acctbal) AS max_c_acctbal FROM customer GROUP BY 1")(
    lambda g: rounded(traverse(g, {"start": all_of("Customer"), "collect": {"type": "GroupBy", "key": {"source": "Node", "property": "c_mktsegment"}, "functions": [
        {"func": "Count", "alias": "n"}, {"func": "Sum", "property": "c_acctbal"}, {"func": "Max", "property": "c_acctbal"}]}}).frame)
)
query("group_by_missing", "SELECT coalesce(quality::VARCHAR, 'null') AS _group, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")(
    lambda g: traverse(g, {"start": all_of("Document"), "collect": {"type": "GroupBy", "key": {"source": "Node", "property": "quality"}, "functions": [{"func": "Count"}]}}).frame
)
query("group_by_edge", "SELECT l_returnflag AS _group, count(*) AS count, round(avg(l_quantity), 2) AS avg_l_quantity FROM lineitem GROUP BY 1")(
    lambda g: rounded(traverse(g, {"start": {"type": "AllEdges", "label": "CONTAINS"}, "collect": {"type": "GroupBy", "key": {"source": "Edge", "property": "l_returnflag"}, "functions": [
        {"func": "Count"}, {"func": "Avg", "property": "l_quantity"}]}}).frame)
)

# -- repetition and paths --

NEXT = [step("OutEdges", "NEXT"), step("OutNodes", "Turn")]
FIRST_TURNS = step("Filter", filter=where("turn", "Equals", 0))
REACHED = """WITH RECURSIVE r(conv_id, turn, d) AS (
  SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0
  UNION SELECT c.conv_id, c.turn, r.d + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1 WHERE r.d < {depth}
) SELECT DISTINCT conv_id, turn FROM r"""
traversal("repeat_next", REACHED.format(depth=3), all_of("Turn"), [FIRST_TURNS, step("Repeat", repeat_steps=NEXT, max_depth=3)], props("conv_id", "turn"))
traversal("repeat_deep", REACHED.format(depth=8), all_of("Turn"), [FIRST_TURNS, step("Repeat", repeat_steps=NEXT, max_depth=8)], props("conv_id", "turn"))
traversal("repeat_both", "SELECT n_nationkey, NULL::INT AS r_regionkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT NULL, 2", all_of("Nation"),
          [step("Filter", filter=where("n_regionkey", "Equals", 2)), step("Repeat", max_depth=2, repeat_steps=[step("BothEdges", "IN_REGION"), step("BothNodes")])], props("n_nationkey", "r_regionkey"))


def id_of(g: PropertyGraph, label: str, key: str, value: int) -> int:
    return g.nodes[label].where(q(key) == value).select(ID).first()[0]


@query("shortest_path_len", "SELECT CASE WHEN a.n_regionkey = b.n_regionkey THEN 4 ELSE NULL END AS hops FROM customer x JOIN nation a ON x.c_nationkey = a.n_nationkey, customer y JOIN nation b ON y.c_nationkey = b.n_nationkey WHERE x.c_custkey = 1 AND y.c_custkey = (SELECT min(c_custkey) FROM customer z JOIN nation n ON z.c_nationkey = n.n_nationkey WHERE n.n_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1) AND z.c_nationkey <> (SELECT c_nationkey FROM customer WHERE c_custkey = 1))")
def shortest_path_len(g: PropertyGraph) -> DataFrame:
    """From a customer to the first one of another nation in the same region, by home and region."""
    customers = g.nodes["Customer"].join(g.nodes["Nation"].select("n_nationkey", "n_regionkey"), q("c_nationkey") == q("n_nationkey"))
    one = customers.where("c_custkey = 1").first()
    other = customers.where((q("n_regionkey") == one["n_regionkey"]) & (q("c_nationkey") != one["c_nationkey"])).orderBy("c_custkey").first()
    path = paths.shortest_path(g, one[ID], other[ID], 6, "both", ["LIVES_IN", "IN_REGION"])
    return path.agg((F.count("*").cast("int") - 1).alias("hops"))


@query("shortest_path_next", "SELECT turn::INT AS pos, turn FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations WHERE turn = 3) AND turn <= 3")
def shortest_path_next(g: PropertyGraph) -> DataFrame:
    conv = g.nodes["Turn"].where("turn = 3").agg(F.min("conv_id")).first()[0]
    ends = [g.nodes["Turn"].where((q("conv_id") == conv) & (q("turn") == t)).select(ID).first()[0] for t in (0, 3)]
    path = paths.shortest_path(g, *ends, 10, "outgoing", ["NEXT"])
    return path.join(g.nodes["Turn"], q("node_id") == q(ID)).select("pos", "turn")


@query("connecting_subgraph_nodes", "SELECT n_nationkey, NULL::INT AS r_regionkey FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT NULL, 1")
def connecting_subgraph_nodes(g: PropertyGraph) -> DataFrame:
    ids = [r[0] for r in g.nodes["Nation"].where("n_regionkey = 1").select(ID).collect()]
    found, _ = paths.connecting_subgraph(g, ids, 4, "both", ["IN_REGION"])
    return found.join(g.node_frame(["Nation", "Region"], ["n_nationkey", "r_regionkey"]), q("node_id") == q(ID)).select("n_nationkey", "r_regionkey")


query("neighbors", "SELECT c_custkey FROM customer WHERE c_nationkey = 4")(
    lambda g: paths.neighbors(g, id_of(g, "Nation", "n_nationkey", 4), "incoming", ["LIVES_IN"]).join(g.nodes["Customer"], q("node_id") == q(ID)).select("c_custkey")
)
query("degree_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) + 1 + (SELECT count(*) FROM events WHERE user_id = c_custkey) AS out_degree, 0::BIGINT AS in_degree FROM customer")(
    lambda g: paths.degrees(g, "Customer").join(g.nodes["Customer"], q("id") == q(ID)).select("c_custkey", "out_degree", "in_degree")
)

# -- Cypher --


def cypher(name: str, text: str, sql: str | None, shape: Callable[[DataFrame], DataFrame] = lambda f: f) -> None:
    query(name, sql)(lambda g: shape(cypher_plan.execute(g, text).frame))


cypher("cypher_match_where_return", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 AND c.c_mktsegment = 'MACHINERY' RETURN c.c_custkey AS k, c.c_name AS name",
       "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'MACHINERY'")
cypher("cypher_inline_properties", "MATCH (p:Part {p_size: 15, p_brand: 'Brand#17'}) RETURN p.p_partkey", 'SELECT p_partkey AS "p.p_partkey" FROM part WHERE p_size = 15 AND p_brand = \'Brand#17\'')
cypher("cypher_path", "MATCH (c:Customer {c_nationkey: 5})-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 40 RETURN c.c_custkey AS c, o.o_orderkey AS o, l.l_quantity AS n, p.p_name AS p",
       "SELECT c_custkey AS c, o_orderkey AS o, l_quantity AS n, p_name AS p FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_nationkey = 5 AND l_quantity > 40")
cypher("cypher_left", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WHERE n.n_name STARTS WITH 'N' RETURN n.n_name AS nation, c.c_custkey AS k",
       "SELECT n_name AS nation, c_custkey AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE starts_with(n_name, 'N')")
cypher("cypher_both", "MATCH (n:Nation {n_nationkey: 3})-[r]-(x) RETURN x.c_custkey AS c, x.s_suppkey AS s, x.r_regionkey AS r",
       "SELECT NULL::BIGINT AS c, NULL::BIGINT AS s, n_regionkey AS r FROM nation WHERE n_nationkey = 3 UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_nationkey = 3 UNION ALL SELECT NULL, s_suppkey, NULL FROM supplier WHERE s_nationkey = 3")
cypher("cypher_anonymous", "MATCH (:Customer {c_nationkey: 5})-[:PLACED]->()-[:CONTAINS]->(p) RETURN p.p_partkey AS p",
       "SELECT l_partkey AS p FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 5")
cypher("cypher_cross", "MATCH (a:Region), (b:Nation) WHERE a.r_regionkey < b.n_regionkey RETURN a.r_name AS a, b.n_name AS b", "SELECT r_name AS a, n_name AS b FROM region, nation WHERE r_regionkey < n_regionkey")
cypher("cypher_shared", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer), (n)<-[:BASED_IN]-(s:Supplier) WHERE c.c_acctbal > 9000 RETURN c.c_custkey AS c, s.s_suppkey AS s",
       "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000")
cypher("cypher_order_skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
cypher("cypher_order_hidden", "MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice, o.o_orderkey LIMIT 7", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7")
cypher("cypher_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.c_mktsegment AS segment, o.o_orderstatus AS status", "SELECT DISTINCT c_mktsegment AS segment, o_orderstatus AS status FROM customer JOIN orders ON o_custkey = c_custkey")
cypher("cypher_expr_arith", "MATCH (p:Part) WHERE p.p_size / 7 = 3 RETURN p.p_partkey AS k, p.p_size * 2 + 1 AS a, -p.p_size / 4 AS b, p.p_size - 0.5 AS c, p.p_size / 0 AS d",
       "SELECT p_partkey AS k, (p_size * 2 + 1)::BIGINT AS a, -(p_size // 4)::BIGINT AS b, p_size - 0.5::DOUBLE AS c, NULL::BIGINT AS d FROM part WHERE p_size // 7 = 3")
cypher("cypher_expr_bool", "MATCH (d:Document) WHERE (d.quality = 1 XOR d.toxic = 1) OR NOT (d.lang = 'en' OR d.quality >= 0) RETURN d.doc_id AS id",
       "SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE (coalesce(quality = 1, false) <> coalesce(toxic = 1, false)) OR NOT (lang = 'en' OR coalesce(quality >= 0, false))")
cypher("cypher_chained", "MATCH (p:Part) WHERE 10 <= p.p_size < 20 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size < 20")
cypher("cypher_is_null", "MATCH (d:Document) WHERE d.quality IS NULL AND d.lang IS NOT NULL RETURN d.doc_id AS id", "SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND lang IS NOT NULL")
cypher("cypher_string_ops", "MATCH (p:Part) WHERE p.p_type CONTAINS 'AR' AND p.p_type STARTS WITH 'S' AND NOT p.p_name ENDS WITH '3' RETURN p.p_partkey AS k",
       "SELECT p_partkey AS k FROM part WHERE contains(p_type, 'AR') AND starts_with(p_type, 'S') AND NOT ends_with(p_name, '3')")
cypher("cypher_regex", "MATCH (c:Customer) WHERE c.c_name =~ '.*0{3}4.*' RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE regexp_full_match(c_name, '.*0{3}4.*')")
cypher("cypher_node_object", "MATCH (n:Nation) RETURN n", "SELECT 'Nation' AS label, n_nationkey, n_name, n_regionkey FROM nation",
       lambda f: f.select(F.col("n.labels")[0].alias("label"), *[F.col(f"n.properties.{c}").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")]))
cypher("cypher_edge_object", "MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN r, x.r_name AS name", "SELECT 'IN_REGION' AS type, n_nationkey AS source, n_regionkey AS target, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
       lambda f: f.select(F.col("r.type").alias("type"), (F.col("r.source") % (1 << KEY_BITS)).cast("int").alias("source"), (F.col("r.target") % (1 << KEY_BITS)).cast("int").alias("target"), "name"))


def after(g: PropertyGraph, text: str) -> PropertyGraph:
    cypher_plan.execute(g, text)
    return g


query("cypher_set", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")(
    lambda g: after(g, "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' SET c.c_acctbal = c.c_acctbal + 100").nodes["Customer"].select("c_custkey", "c_acctbal")
)
query("cypher_set_edge", "SELECT l_orderkey, l_partkey, CASE WHEN l_quantity > 49 THEN 0.0 ELSE l_discount END AS l_discount FROM lineitem")(
    lambda g: after(g, "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 49 SET l.l_discount = 0.0").edges["CONTAINS"].select(
        (q("__src") % (1 << KEY_BITS)).alias("l_orderkey"), (q("__dst") % (1 << KEY_BITS)).alias("l_partkey"), "l_discount")
)
query("cypher_remove", "SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS p_brand FROM part")(
    lambda g: after(g, "MATCH (p:Part) WHERE p.p_size < 10 REMOVE p.p_brand").nodes["Part"].select("p_partkey", "p_brand")
)
query("cypher_delete_cascade", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS nodes, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0) AS edges")(
    lambda g: (lambda h: h.nodes["Customer"].agg(F.count("*").alias("nodes")).crossJoin(h.edges["PLACED"].agg(F.count("*").alias("edges"))))(after(g, "MATCH (c:Customer) WHERE c.c_acctbal < 0 DELETE c"))
)
query("cypher_create", "SELECT r_name FROM region UNION ALL SELECT 'NOWHERE'")(lambda g: after(g, "CREATE (r:Region {r_regionkey: 99, r_name: 'NOWHERE'})").nodes["Region"].select("r_name"))
query("cypher_match_create", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'ELSEWHERE' FROM nation WHERE n_regionkey = 1")(
    lambda g: cypher_plan.execute(after(g, "CREATE (r:Region {r_regionkey: 98, r_name: 'ELSEWHERE'}); MATCH (n:Nation {n_regionkey: 1}), (r:Region {r_regionkey: 98}) CREATE (n)-[:IN_REGION]->(r)"),
                                  "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n_name, r.r_name AS r_name").frame
)
query("cypher_merge", "SELECT r_name FROM region UNION ALL SELECT 'NEW'")(
    lambda g: after(g, "MERGE (r:Region {r_name: 'ASIA'}); MERGE (r:Region {r_name: 'NEW'}); MERGE (r:Region {r_name: 'NEW'})").nodes["Region"].select("r_name")
)

# -- changes --


@query("patch_nodes", "SELECT p_partkey, CASE WHEN p_size = 5 THEN 50 ELSE p_size END AS p_size FROM part")
def patch_nodes(g: PropertyGraph) -> DataFrame:
    mutations.apply_changes(g, "Part", g.nodes["Part"].where("p_size = 5").select(q(ID), F.lit(50).alias("p_size")), ["p_size"])
    return g.nodes["Part"].select("p_partkey", "p_size")


@query("labels_add_remove", "SELECT doc_id, list_sort(list_filter(['Document', CASE WHEN quality IS NOT NULL THEN 'Labeled' END, CASE WHEN lang = 'de' THEN 'German' END], lambda x: x IS NOT NULL))::VARCHAR AS labels FROM documents LEFT JOIN labels USING (doc_id)")
def labels_add_remove(g: PropertyGraph) -> DataFrame:
    frame = mutations.relabel(g.nodes["Document"], q("lang") == "de", "German", add=True)
    frame = mutations.relabel(frame, F.lit(True), "Toxic", add=False)
    return frame.select("doc_id", F.concat(F.lit("["), F.array_join(F.array_sort(LABELS), ", "), F.lit("]")).alias("labels"))


query("unique_violations", "SELECT c_nationkey AS value, count(*) AS count FROM customer GROUP BY 1 HAVING count(*) > 1")(lambda g: mutations.unique_violations(g, "Customer", "c_nationkey"))


@query("rename_field", "SELECT p_partkey, p_size AS size FROM part WHERE p_size > 45")
def rename_field(g: PropertyGraph) -> DataFrame:
    mutations.rename_field(g, "Part", "p_size", "size")
    return traverse(g, {"start": all_of("Part"), "steps": [step("Filter", filter=where("size", "GreaterThan", 45))], "collect": props("p_partkey", "size")}).frame


@query("change_type_report", "SELECT count(*) FILTER (TRY_CAST(source AS BIGINT) IS NOT NULL) AS converted, count(*) FILTER (TRY_CAST(source AS BIGINT) IS NULL) AS failed FROM documents")
def change_type_report(g: PropertyGraph) -> DataFrame:
    report = mutations.change_field_type(g, "Document", "source", "Int")
    return g.spark.createDataFrame([(report["converted"], report["failed"])], "converted long, failed long")


query("change_type_values", "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT END AS whole FROM orders")(
    lambda g: g.nodes["Order"].select("o_orderkey", convert(q("o_totalprice"), "Float", "Int").alias("whole"))
)


@query("purge_field", "SELECT p_partkey, NULL::VARCHAR AS p_brand FROM part")
def purge_field(g: PropertyGraph) -> DataFrame:
    """A field that is dropped from the schema and declared again holds nothing."""
    from dataclasses import replace

    full = g.schema
    part = full.nodes["Part"]
    without = Schema({**full.nodes, "Part": replace(part, fields=tuple(f for f in part.fields if f.name != "p_brand"))}, full.edges)
    mutations.apply_schema(g, without)
    mutations.apply_schema(g, full)
    return g.nodes["Part"].select("p_partkey", "p_brand")


KEPT = "(SELECT c_custkey FROM customer WHERE c_nationkey <> 1)"
DANGLING = f"""SELECT label, side, n FROM (
  SELECT 'PLACED' AS label, 'src' AS side, (SELECT count(*) FROM orders WHERE o_custkey NOT IN {KEPT}) AS n
  UNION ALL SELECT 'LIVES_IN', 'src', (SELECT count(*) FROM customer WHERE c_nationkey = 1)
  UNION ALL SELECT 'PERFORMED', 'src', (SELECT count(*) FROM events WHERE user_id NOT IN {KEPT})
  UNION ALL SELECT 'CONTAINS', 'src', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'CONTAINS', 'dst', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
  UNION ALL SELECT 'SHIPPED_BY', 'src', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'SHIPPED_BY', 'dst', (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier))
) WHERE n > 0"""
query("verify_dangling", DANGLING)(
    lambda g: mutations.dangling(PropertyGraph(g.spark, g.schema, {**g.nodes, "Customer": g.nodes["Customer"].where("c_nationkey <> 1")}, g.edges)).groupBy("label", "side").agg(F.count("*").alias("n"))
)


@query("transaction_rollback", "SELECT count(*) AS n FROM region")
def transaction_rollback(g: PropertyGraph) -> DataFrame:
    c = Connection(g)
    with c.transaction():
        c.insert_node("Region", {"r_regionkey": 77, "r_name": "GONE"})
    return c.graph.nodes["Region"].agg(F.count("*").alias("n"))


# -- files --


def folder(g: PropertyGraph, name: str) -> str:
    """A folder that driver and executors share."""
    return f"{shared_folder(g.spark)}/{name}-{g.spark._jvm.java.util.UUID.randomUUID()}"


def part_of(g: PropertyGraph, nodes: tuple[str, ...], edges: tuple[str, ...] = (), rows: bool = True) -> PropertyGraph:
    """Some types of a graph, with their rows or empty."""
    schema = Schema({t: g.schema.nodes[t] for t in nodes}, {t: g.schema.edges[t] for t in edges})
    return PropertyGraph(g.spark, schema, {t: g.nodes[t] for t in nodes}, {t: g.edges[t] for t in edges}) if rows else PropertyGraph(g.spark, schema)


@query("csv_roundtrip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_roundtrip(g: PropertyGraph) -> DataFrame:
    at = folder(g, "csv")
    text_files.export_csv(g, "Supplier", at)
    c = Connection(part_of(g, ("Supplier",), rows=False))
    c.import_csv(at, plain=True)
    return c.graph.nodes["Supplier"].select("s_suppkey", "s_name", q("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


HOMES = "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"
HOMES_OF = "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.c_name AS c_name, n.n_name AS n_name"


@query("csv_edges", HOMES)
def csv_edges(g: PropertyGraph) -> DataFrame:
    """Edges by way of CSV: their ends are found by the nodes' names."""
    at = folder(g, "csv")
    c = Connection(part_of(g, ("Customer", "Nation"), ("LIVES_IN",), rows=False))
    for t, name in (("Customer", "c_name"), ("Nation", "n_name")):
        rows = text_files.csv_frame(g, t).withColumnRenamed(name, "id")
        rows.write.csv(f"{at}/{t}", header=True, escape='"')
        c.rename_node_field(t, name, "id")
        c.import_csv(f"{at}/{t}", plain=True)
    ends = g.nodes["Customer"].join(g.nodes["Nation"], q("c_nationkey") == q("n_nationkey"))
    ends.select(F.lit("LIVES_IN").alias(":TYPE"), q("c_name").alias(":FROM"), q("n_name").alias(":TO")).write.csv(f"{at}/edges", header=True)
    c.import_csv(f"{at}/edges", plain=True)
    return c.cypher("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.id AS c_name, n.id AS n_name").frame


@query("json_roundtrip", HOMES)
def json_roundtrip(g: PropertyGraph) -> DataFrame:
    """Nodes and edges out to JSON lines and in again."""
    at = folder(g, "json")
    some = ("Customer", "Nation"), ("LIVES_IN",)
    text_files.export_json(part_of(g, *some), at)
    c = Connection(part_of(g, *some, rows=False))
    c.import_json(at)
    return c.cypher(HOMES_OF).frame


query("csv_type_inference", "SELECT 'r_name' AS name, 'String' AS type UNION ALL SELECT 'r_regionkey', 'Int'")(
    lambda g: g.spark.createDataFrame(sorted(text_files.infer_types(text_files.csv_frame(g, "Region")).items()), "name string, type string")
)


@query("store_roundtrip", HOMES)
def store_roundtrip(g: PropertyGraph) -> DataFrame:
    at = folder(g, "graph")
    store.save(part_of(g, ("Customer", "Nation"), ("LIVES_IN",)), at)
    return cypher_plan.execute(store.load(g.spark, at), HOMES_OF).frame


@query("store_appends", "SELECT r_name FROM region UNION ALL SELECT 'A' UNION ALL SELECT 'B'")
def store_appends(g: PropertyGraph) -> DataFrame:
    """Two commits that append, then a vacuum."""
    at = folder(g, "graph")
    store.save(part_of(g, ("Region",)), at)
    with Connection.open(g.spark, at) as c:
        for name in ("A", "B"):
            c.insert_node("Region", {"r_name": name})
        c.vacuum()
        return c.list_nodes("Region").select("r_name")


@query("store_info", "SELECT 'Nation' AS type, count(*) AS n FROM nation UNION ALL SELECT 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
def store_info(g: PropertyGraph) -> DataFrame:
    at = folder(g, "graph")
    store.save(part_of(g, ("Nation", "Region"), ("IN_REGION",)), at)
    found = store.info(g.spark, at)
    return local_rows(g.spark, sorted({**found["nodes"], **found["edges"]}.items()), "type string, n long")


# -- lookups and single changes --

query("list_nodes", "SELECT n_nationkey, n_name FROM nation")(lambda g: Connection(g).list_nodes("Nation").select("n_nationkey", "n_name"))


@query("counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, 0::BIGINT AS nothing")
def counts(g: PropertyGraph) -> DataFrame:
    c = Connection(g)
    return local_rows(g.spark, [(c.count_nodes("Order"), c.count_edges("CONTAINS"), c.count_nodes("Nothing"))], "orders long, lines long, nothing long")


@query("one_node", "SELECT n_name, r_name, true AS there, false AS nowhere FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7")
def one_node(g: PropertyGraph) -> DataFrame:
    """A node found by a key, its edge's ends, and their properties, by id."""
    c = Connection(g)
    node = c.find_node("Nation", "n_nationkey", 7)
    edge = paths.neighbors(g, node, "outgoing", ["IN_REGION"]).first()["edge_id"]
    source, target = c.get_edge_endpoints(edge)
    row = (c.get_node_properties(source)["n_name"], c.get_node_properties(target)["r_name"], c.edge_exists(edge), c.node_exists(-5))
    return local_rows(g.spark, [row], "n_name string, r_name string, there boolean, nowhere boolean")


@query("insert_rows", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'X', 'Y'")
def insert_rows(g: PropertyGraph) -> DataFrame:
    c = Connection(g)
    n, r = c.insert_node("Nation", {"n_name": "X"}), c.insert_node("Region", '{"r_name": "Y"}')
    c.insert_edge("IN_REGION", n, r)
    return c.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n_name, r.r_name AS r_name").frame


@query("replace_properties", "SELECT CASE WHEN r_regionkey <> 2 THEN r_regionkey END AS r_regionkey, CASE WHEN r_regionkey = 2 THEN 'NEW' ELSE r_name END AS r_name FROM region")
def replace_properties(g: PropertyGraph) -> DataFrame:
    c = Connection(g)
    c.update_node_properties(c.find_node("Region", "r_regionkey", 2), {"r_name": "NEW"})
    return c.list_nodes("Region").select(q("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("delete_edges", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def delete_edges(g: PropertyGraph) -> DataFrame:
    return cypher_plan.execute(after(g, "MATCH (n:Nation)-[e:IN_REGION]->(r:Region {r_name: 'ASIA'}) DELETE e"), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n_name, r.r_name AS r_name").frame


@query("dynamic_labels", "SELECT n_name FROM nation WHERE n_nationkey = 4")
def dynamic_labels(g: PropertyGraph) -> DataFrame:
    """A label of a node and one of its edge, both made up on the way."""
    c = Connection(g)
    node = c.find_node("Nation", "n_nationkey", 4)
    c.add_node_label_dynamic(node, "Seen")
    c.add_edge_label_dynamic(paths.neighbors(c.graph, node, "outgoing", ["IN_REGION"]).first()["edge_id"], "MARKED")
    return c.traverse({"start": all_of("Seen"), "steps": [step("OutEdges", "MARKED"), step("InNodes")], "collect": props("n_name")}).frame


@query("self_loop", "SELECT 2::BIGINT AS count")
def self_loop(g: PropertyGraph) -> DataFrame:
    """A loop is met once in each direction."""
    c = Connection.open_in_memory(g.spark)
    c.apply_schema("node N { k: Int } edge E { from: N to: N }")
    n = c.insert_node("N", {"k": 1})
    c.insert_edge("E", n, n)
    return c.traverse({"start": all_of("N"), "steps": [step("BothEdges")], "collect": {"type": "Count"}}).frame


@query("change_type_null", "SELECT doc_id, TRY_CAST(source AS BIGINT) AS source FROM documents")
def change_type_null(g: PropertyGraph) -> DataFrame:
    mutations.change_field_type(g, "Document", "source", "Int", null_on_failure=True)
    return g.nodes["Document"].select("doc_id", "source")


query("conversions", "SELECT p_partkey, p_size::VARCHAR AS as_text, p_size::DOUBLE AS as_float, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT END AS as_int, 'true' AS as_word FROM part")(
    lambda g: g.nodes["Part"].select("p_partkey", convert(q("p_size"), "Int", "String").alias("as_text"), convert(q("p_size"), "Int", "Float").alias("as_float"),
                                     convert(q("p_retailprice"), "Float", "Int").alias("as_int"), convert(F.lit(True), "Boolean", "String").alias("as_word"))
)


@query("schema_text", "SELECT 'n_name' AS name, 'String' AS type UNION ALL SELECT 'n_nationkey', 'Int' UNION ALL SELECT 'n_regionkey', 'Int'")
def schema_text(g: PropertyGraph) -> DataFrame:
    """The schema written out, read again, and a type's fields."""
    c = Connection.open_in_memory(g.spark)
    c.apply_schema(Connection(g).get_schema_text())
    return local_rows(g.spark, sorted((f["name"], f["type"]) for f in c.node_type_schema("Nation")), "name string, type string")


@query("unique_enforced", "SELECT count(*) AS n, true AS refused FROM region")
def unique_enforced(g: PropertyGraph) -> DataFrame:
    c = Connection(part_of(g, ("Region",), rows=False))
    c.apply_schema("node Region { r_regionkey: Int @unique r_name: String }")
    c.insert_nodes("Region", [{k: r[k] for k in ("r_regionkey", "r_name")} for r in g.nodes["Region"].collect()])
    refused = False
    try:
        c.insert_node("Region", {"r_regionkey": 0})
    except UniqueViolation:
        refused = True
    return c.list_nodes("Region").agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


traversal("filter_property_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= s_nationkey AND s_acctbal <> s_suppkey", all_of("Supplier"),
          [step("Filter", filter=where("s_acctbal", "GreaterThanOrEquals", {"type": "property", "key": "s_nationkey"})), step("Filter", filter=where("s_acctbal", "NotEquals", {"type": "property", "key": "s_suppkey"}))], props("s_suppkey"))
traversal("filter_property_pattern", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, p_brand)", all_of("Part"),
          [step("Filter", filter=where("p_type", "Matches", {"type": "property", "key": "p_brand"}))], props("p_partkey"))


@query("aggregate_not_finite", "SELECT 3::BIGINT AS count, NULL::DOUBLE AS sum_x, NULL::DOUBLE AS avg_x")
def aggregate_not_finite(g: PropertyGraph) -> DataFrame:
    c = Connection.open_in_memory(g.spark)
    c.apply_schema("node N { x: Float }")
    c.insert_nodes("N", [{"x": 1.0}, {"x": 2.0}, {"x": float("inf")}])
    return c.traverse({"start": all_of("N"), "collect": {"type": "Aggregate", "functions": [{"func": "Count"}, {"func": "Sum", "property": "x"}, {"func": "Avg", "property": "x"}]}}).frame


# -- more Cypher --

cypher("cypher_join", "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 8000 RETURN c.c_custkey AS c, s.s_suppkey AS s",
       "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 8000")
cypher("cypher_optional", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 RETURN c.c_custkey AS c, o.o_orderkey AS o",
       "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
cypher("cypher_grouped", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS segment, count(*) AS n, count(DISTINCT c) AS customers, max(o.o_totalprice) AS top",
       "SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_custkey) AS customers, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
cypher("cypher_in_case", "MATCH (p:Part) WHERE p.p_size IN [3, 5, 7] RETURN p.p_partkey AS k, CASE WHEN p.p_size < 5 THEN 'small' ELSE toLower(p.p_brand) END AS c",
       "SELECT p_partkey AS k, CASE WHEN p_size < 5 THEN 'small' ELSE lower(p_brand) END AS c FROM part WHERE p_size IN (3, 5, 7)")
cypher("cypher_no_match", "RETURN 1 AS one", "SELECT 1 AS one WHERE false")
cypher("cypher_literals", "MATCH (r:Region) RETURN r.r_name AS name, [1, r.r_regionkey] AS list, {a: r.r_name, b: 2.5} AS map", "SELECT r_name AS name, r_regionkey AS second, 2.5::DOUBLE AS b FROM region",
       lambda f: f.select("name", F.col("list")[1].cast("int").alias("second"), F.col("map.b").alias("b")))
query("cypher_merge_rows", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)")(
    lambda g: after(g, "MATCH (n:Nation) MERGE (r:Region {r_name: n.n_name})").nodes["Region"].select(q("r_name").alias("name"))
)


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

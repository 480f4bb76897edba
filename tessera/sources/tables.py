"""A property graph over relational tables: rows become nodes, keys become edges.

A node's id is its type's number and its key in one long (16 and 48 bits), so
ids are unique without a lookup and an edge's ends follow from foreign keys.  A key
of more than 48 bits, or a part of one that has no room, ends the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import DST, ID, LABEL, LABELS, SRC, EdgeType, Field, NodeType, Schema, TypeExpr
from tessera.graph import PropertyGraph, q

KEY_BITS = 48
#: Bits of a turn's number in its conversation, and of a line's number in its order.
TURN_BITS, LINE_BITS = 12, 12

NAMES = [
    (T.BooleanType, "Boolean"),
    (T.IntegralType, "Int"),
    (T.NumericType, "Float"),
    (T.TimestampType, "DateTime"),
    (T.TimestampNTZType, "DateTime"),
    (T.DateType, "DateTime"),
    (T.BinaryType, "Blob"),
    (T.VariantType, "Json"),
]


def type_of(kind: T.DataType) -> TypeExpr:
    if isinstance(kind, T.ArrayType):
        return TypeExpr("List", (type_of(kind.elementType),))
    if isinstance(kind, T.MapType):
        return TypeExpr("Map", (TypeExpr("String"), type_of(kind.valueType)))
    return TypeExpr(next((n for k, n in NAMES if isinstance(kind, k)), "String"))


def fields_of(frame: DataFrame, json: set[str]) -> tuple[Field, ...]:
    return tuple(Field(f.name, TypeExpr("Json") if f.name in json else type_of(f.dataType)) for f in frame.schema if not f.name.startswith("__"))


def fitting(key: Column, bound: int) -> Column:
    """A key from 0 up to a bound; a null stays null, any other value ends the job."""
    key = key.cast("long")
    return F.when(key.isNull() | key.between(0, bound - 1), key).otherwise(F.raise_error(F.concat(F.lit("a key has no room in an id: "), key.cast("string"))).cast("long"))


def pair_key(major: Column, minor: Column, bits: int) -> Column:
    """Two keys in one: ``bits`` bits for the second."""
    return fitting(major, 1 << (KEY_BITS - bits)) * F.lit(1 << bits) + fitting(minor, 1 << bits)


class Builder:
    """Collects node and edge tables; ``graph`` makes the graph."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, DataFrame] = {}
        self.edge_frames: dict[str, DataFrame] = {}
        self.definitions: list[NodeType | EdgeType] = []
        self.more: dict[str, set[str]] = {}
        self.numbers: dict[str, int] = {}

    def id_of(self, label: str, key: Column) -> Column:
        return F.lit(self.numbers[label]).cast("long") * F.lit(1 << KEY_BITS) + fitting(key, 1 << KEY_BITS)

    def node(self, label: str, frame: DataFrame, key: Column, json: set[str] = frozenset(), extra: Column | None = None, extra_labels: set[str] = frozenset()) -> None:
        """``extra``: an array of further labels of a row, all among ``extra_labels``."""
        self.numbers[label] = len(self.numbers) + 1
        labels = F.array(F.lit(label)) if extra is None else F.concat(F.array(F.lit(label)), extra)
        self.frames[label] = frame.select(self.id_of(label, key).alias(ID), F.lit(label).alias(LABEL), labels.alias(LABELS), *map(q, frame.columns))
        self.definitions.append(NodeType(label, fields_of(frame, json)))
        if extra_labels:
            self.more[label] = set(extra_labels)

    def edge(self, name: str, frame: DataFrame, source: tuple[str, Column], target: tuple[str, Column], key: Column, properties: list[str] = ()) -> None:
        """key: a long that tells the rows of the table apart."""
        number = len(self.edge_frames) + 1
        self.edge_frames[name] = frame.select(
            (F.lit(number).cast("long") * F.lit(1 << KEY_BITS) + fitting(key, 1 << KEY_BITS)).alias(ID),
            self.id_of(*source).alias(SRC),
            self.id_of(*target).alias(DST),
            F.lit(name).alias(LABEL),
            F.array(F.lit(name)).alias(LABELS),
            *map(q, properties),
        )
        fields = fields_of(frame.select(*map(q, properties)), set()) if properties else ()
        self.definitions.append(EdgeType(name, TypeExpr(source[0], user=True), TypeExpr(target[0], user=True), fields))

    def graph(self) -> PropertyGraph:
        dynamic = set().union(*self.more.values(), set()) - set(self.frames)
        return PropertyGraph(
            self.spark, Schema.of(self.definitions).check(), dict(self.frames), dict(self.edge_frames), self.more, dynamic_nodes=dynamic, next_id=64 << KEY_BITS
        )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """With __line, a line's place in its order; plans that ask for no edge id leave it out."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lines.withColumn("__line", F.row_number().over(place) - 1)


def star_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph over the star schema and corpus tables of ``folder``."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    b = Builder(spark)
    for label, table, key in (
        ("Region", "region", "r_regionkey"),
        ("Nation", "nation", "n_nationkey"),
        ("Customer", "customer", "c_custkey"),
        ("Supplier", "supplier", "s_suppkey"),
        ("Part", "part", "p_partkey"),
        ("Order", "orders", "o_orderkey"),
        ("Page", "pages", "page_id"),
        ("BenchmarkItem", "benchmark", "item_id"),
        ("Vec", "embeddings", "vec_id"),
    ):
        b.node(label, read(table), q(key))
    b.node("Event", read("events"), q("event_id"), json={"props"})
    documents = read("documents").join(read("labels"), "doc_id", "left")
    marks = F.array_compact(F.array(F.when(q("quality").isNotNull(), F.lit("Labeled")), F.when(q("toxic") == 1, F.lit("Toxic"))))
    b.node("Document", documents, q("doc_id"), extra=marks, extra_labels={"Labeled", "Toxic"})
    turns = read("conversations")
    turn_key = pair_key(q("conv_id"), q("turn"), TURN_BITS)
    b.node("Turn", turns, turn_key)
    lines = numbered_lines(read("lineitem"))
    b.edge("IN_REGION", read("nation"), ("Nation", q("n_nationkey")), ("Region", q("n_regionkey")), q("n_nationkey"))
    b.edge("LIVES_IN", read("customer"), ("Customer", q("c_custkey")), ("Nation", q("c_nationkey")), q("c_custkey"))
    b.edge("BASED_IN", read("supplier"), ("Supplier", q("s_suppkey")), ("Nation", q("s_nationkey")), q("s_suppkey"))
    b.edge("PLACED", read("orders"), ("Customer", q("o_custkey")), ("Order", q("o_orderkey")), q("o_orderkey"))
    line_key = pair_key(q("l_orderkey"), q("__line"), LINE_BITS)
    measures = [c for c in lines.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey", "__line")]
    b.edge("CONTAINS", lines, ("Order", q("l_orderkey")), ("Part", q("l_partkey")), line_key, measures)
    b.edge("SHIPPED_BY", lines, ("Order", q("l_orderkey")), ("Supplier", q("l_suppkey")), line_key, ["l_quantity", "l_shipdate"])
    b.edge("PERFORMED", read("events"), ("Customer", q("user_id")), ("Event", q("event_id")), q("event_id"))
    after = turns.select("conv_id", (q("turn") + 1).alias("turn")).join(turns.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    b.edge("NEXT", after, ("Turn", pair_key(q("conv_id"), q("turn") - 1, TURN_BITS)), ("Turn", turn_key), turn_key)
    return b.graph()

import datetime

import pytest

from tessera.api import Connection
from tessera.errors import Conflict, EdgeNotFound, GraphError, InvalidCommand, NodeNotFound, SchemaError, TypeMismatch, UniqueViolation, ValidationError
from tessera.operators import mutations, paths
from tessera.sources import store

SCHEMA = """
node User { id: String email: String @unique age: Int born: DateTime more: Json raw: Blob tags: List<Int> }
node Admin { role: String }
node Project { id: String }
edge OWNS { from: User to: Project props: { role: String } }
edge MANAGES { from: User to: Project props: { since: String } }
"""


@pytest.fixture
def c(spark):
    c = Connection.open_in_memory(spark)
    c.apply_schema(SCHEMA)
    return c


def test_insert_and_read(c):
    u = c.insert_node("User", '{"id": "u", "age": 3, "born": "2024-01-01T00:00:00Z", "more": {"a": [1, "x"]}, "raw": "aGk=", "tags": [1, 2]}')
    assert c.get_node_properties(u) == {"id": "u", "age": 3, "born": "2024-01-01T00:00:00.000Z", "more": {"a": [1, "x"]}, "raw": "aGk=", "tags": [1, 2]}
    p = c.insert_node("Project", {"id": "p"})
    e = c.insert_edge("OWNS", u, p, {"role": "owner"})
    assert c.get_edge_endpoints(e) == (u, p) and c.get_edge_properties(e) == {"role": "owner"}
    assert c.get_node_type_name(u) == "User" and c.get_edge_type_name(e) == "OWNS"
    assert c.node_exists(u) and not c.node_exists(e + 9) and c.edge_exists(e) and not c.edge_exists(u)
    assert c.count_nodes() == 2 and c.count_nodes("Nobody") == 0 and c.count_edges("OWNS") == 1
    for do in (
        lambda: c.insert_node("Nobody", {}),
        lambda: c.insert_node("User", {"no": 1}),
        lambda: c.insert_edge("OWNS", p, u),
    ):
        with pytest.raises(ValidationError):
            do()
    for bad in ({"age": "3"}, {"age": 1.5}, {"age": True}, {"tags": ["x"]}, {"born": "soon"}):
        with pytest.raises(TypeMismatch):
            c.insert_node("User", bad)
    with pytest.raises(NodeNotFound):
        c.insert_edge("OWNS", u, 10**6)
    with pytest.raises(EdgeNotFound):
        c.get_edge_properties(10**6)
    assert c.verify() == []


def test_updates_and_unique(c):
    a, b = c.insert_nodes("User", [{"email": "a", "age": 1}, {"email": "b"}])
    c.insert_nodes("User", [{}, {}])  # missing values may repeat
    with pytest.raises(UniqueViolation):
        c.insert_node("User", {"email": "a"})
    with pytest.raises(UniqueViolation):
        c.patch_node_properties(b, {"email": "a"})
    c.patch_node_properties(a, {"email": "a", "age": 2})
    assert c.get_node_properties(a) == {"email": "a", "age": 2}
    c.update_node_properties(a, {"id": "x"})
    assert c.get_node_properties(a) == {"id": "x"}
    c.patch_node_properties(b, {"email": "a", "tags": [4], "more": [1]})
    assert c.get_node_properties(b) == {"email": "a", "tags": [4], "more": [1]}
    p = c.insert_node("Project", {})
    e = c.insert_edge("OWNS", a, p, {"role": "x"})
    c.update_edge_properties(e, {})
    assert c.get_edge_properties(e) == {}


def test_delete(c):
    u, v = c.insert_nodes("User", [{}, {}])
    p = c.insert_node("Project", {})
    e, f = c.insert_edges("OWNS", [(u, p, {}), (v, p, {})])
    c.delete_edge(e)
    assert not c.edge_exists(e) and c.node_exists(u)
    c.delete_node(v)
    assert not c.edge_exists(f) and c.count_edges() == 0
    with pytest.raises(NodeNotFound):
        c.delete_node(v)
    with pytest.raises(EdgeNotFound):
        c.delete_edge(f)


def test_labels(c):
    u = c.insert_node_with_labels("User", ["Admin", "User", "Admin"], {"id": "u", "nothing": 1})
    assert c.get_node_labels(u) == ["User", "Admin"]
    c.remove_node_label(u, "Admin")
    c.add_node_label(u, "Project")
    assert c.get_node_labels(u) == ["User", "Project"]
    with pytest.raises(ValidationError):
        c.add_node_label(u, "Unknown")
    with pytest.raises(InvalidCommand):
        c.remove_node_label(u, "User")
    found = c.insert_node_with_dynamic_labels("User", ["Fresh", "Admin"], {})
    assert found.created == ["Fresh"] and c.get_node_labels(found.id) == ["User", "Fresh", "Admin"]
    e = c.insert_edge_with_labels("OWNS", ["MANAGES"], u, c.insert_node("Project", {}))
    assert c.get_edge_labels(e) == ["OWNS", "MANAGES"]
    c.remove_edge_label(e, "MANAGES")
    assert c.get_edge_labels(e) == ["OWNS"]
    c.apply_schema(SCHEMA)  # dynamic labels live on
    assert c.list_nodes("Fresh").count() == 1


def test_transactions(c, tmp_path, spark):
    with c.transaction():
        c.insert_node("User", {})
        c.apply_schema(SCHEMA + "node Extra { }")
        with pytest.raises(InvalidCommand):
            c.begin_transaction()
    assert c.count_nodes() == 0 and "Extra" not in c.node_type_names()
    with c.transaction() as t:
        c.insert_node("User", {})
        t.commit()
    assert c.count_nodes() == 1
    with pytest.raises(InvalidCommand):
        c.commit_transaction()
    with pytest.raises(ValidationError):
        c.cypher("CREATE (u:User {id: 'x'}); CREATE (u:User {no: 1})")
    assert c.count_nodes() == 1  # all statements or none


def test_stored(tmp_path, spark):
    at = f"file://{tmp_path}/graph"
    with Connection.create(spark, at) as c:
        c.apply_schema(SCHEMA)
        u = c.insert_node_with_dynamic_labels("User", ["New"], {"id": "ü", "more": {"k": 1}}).id
        p = c.insert_node("Project", {"id": "p"})
        c.insert_edge("OWNS", u, p, {"role": "r"})
        c.begin_transaction()
        c.insert_node("User", {})
    with pytest.raises(GraphError):
        Connection.create(spark, at)
    with Connection.open(spark, at) as c:
        assert c.count_nodes("User") == 1 and c.get_node_labels(u) == ["User", "New"]
        assert c.get_node_properties(u) == {"id": "ü", "more": {"k": 1}}
        assert c.cypher("MATCH (u:User)-[:OWNS]->(p) RETURN p.id AS p").value() == [{"p": "p"}]
        assert len(c.vacuum()) >= 3
        assert c.info()["nodes"]["User"] == 1
        assert c.insert_node("User", {}) not in (u, p)
    assert len(Connection.vacuum_file(spark, at)) >= 1
    with pytest.raises(GraphError):
        Connection.open(spark, f"file://{tmp_path}/nothing")


def test_two_writers(tmp_path, spark):
    """The second of two commits over one version is refused, and the first one's rows stay."""
    at = f"file://{tmp_path}/shared"
    with Connection.create(spark, at) as c:
        c.apply_schema(SCHEMA)
    one, two = Connection.open(spark, at), Connection.open(spark, at)
    one.insert_node("Project", {"id": "first"})
    with pytest.raises(Conflict):
        two.insert_node("Project", {"id": "second"})
    assert two.count_nodes() == 0  # as it was read
    two = Connection.open(spark, at)
    two.insert_node("Project", {"id": "second"})
    assert sorted(r["id"] for r in Connection.open(spark, at).list_nodes("Project").collect()) == ["first", "second"]
    with pytest.raises(Conflict):
        one.vacuum()


def test_commits_write_what_changed(tmp_path, spark):
    at = f"file://{tmp_path}/parts"
    with Connection.create(spark, at) as c:
        c.apply_schema(SCHEMA)
        parts = lambda: {k: list(t["parts"]) for k, t in store.manifest(spark, at)["tables"].items()}
        before = parts()
        u = c.insert_node("User", {"email": "a", "age": 1})
        after = parts()
        assert after["node:User"][:-1] == before["node:User"] and len(after["node:User"]) == len(before["node:User"]) + 1
        assert all(after[k] == before[k] for k in before if k != "node:User")
        with c.transaction() as t:
            c.insert_nodes("User", [{"email": "b"}, {"email": "c"}])
            c.insert_node("User", {"email": "d"})
            t.commit()
        assert len(parts()["node:User"]) == len(after["node:User"]) + 1  # one more part for both
        p = c.insert_node("Project", {})
        c.insert_edge("OWNS", u, p, {"role": "x"})
        before = parts()
        c.patch_node_properties(u, {"age": 2})  # another change: that table is written anew, alone
        after = parts()
        assert len(after["node:User"]) == 1 and all(after[k] == before[k] for k in before if k != "node:User")
        c.delete_node(p)
        assert parts()["edge:MANAGES"] != after["edge:MANAGES"] and parts()["node:User"] == after["node:User"]
        assert c.count_nodes("User") == 4 and c.count_edges() == 0
        for k in range(3):
            c.insert_node("User", {"email": f"x{k}"})
        c.vacuum()
        assert all(len(x) == 1 for x in parts().values()) and c.count_nodes("User") == 7
        assert c.vacuum() == []


def test_ids_have_room(spark):
    from tessera.sources.tables import LINE_BITS, pair_key

    rows = spark.createDataFrame([(5, 4095), (2**36 - 1, 0)], "a long, b long")
    assert [r[0] for r in rows.select(pair_key(rows["a"], rows["b"], LINE_BITS)).collect()] == [5 * 4096 + 4095, (2**36 - 1) * 4096]
    for bad in ((1, 4096), (2**36, 0), (-1, 0)):
        frame = spark.createDataFrame([bad], "a long, b long")
        with pytest.raises(Exception, match="no room"):
            frame.select(pair_key(frame["a"], frame["b"], LINE_BITS)).collect()


def test_evolution(c):
    a = c.insert_node("User", {"id": "7", "age": 5, "email": "e"})
    b = c.insert_node("User", {"id": "x"})
    c.rename_node_field("User", "id", "code")
    assert c.get_node_properties(a)["code"] == "7"
    for old, new in (("no", "x"), ("code", "age")):
        with pytest.raises(SchemaError):
            c.rename_node_field("User", old, new)
    assert c.change_node_field_type("User", "code", "Int") == {"applied": False, "converted": 0, "failed": 1, "failed_records": [b]}
    assert c.get_node_properties(b) == {"code": "x"}
    assert c.change_node_field_type("User", "code", "Int", null_on_failure=True) == {"applied": True, "converted": 1, "failed": 1, "failed_records": [b]}
    assert c.get_node_properties(a)["code"] == 7 and c.get_node_properties(b) == {}
    with pytest.raises(SchemaError):
        c.change_node_field_type("User", "code", "Boolean")
    text = c.get_schema_text()
    c.apply_schema(text.replace("  age: Int\n", ""))
    c.apply_schema(text)
    assert "age" not in c.get_node_properties(a)  # a dropped field's values are gone
    with pytest.raises(SchemaError):
        c.apply_schema(text.replace("code: Int", "code: String"))
    assert [f["name"] for f in c.node_type_schema("User")][:2] == ["code", "email"]
    assert c.edge_type_schema("OWNS") == [{"name": "role", "type": "String", "indexed": False, "unique": False, "nullable": True}]


@pytest.mark.parametrize(
    ("value", "old", "new", "found"),
    [
        ("7", "String", "Int", 7),
        (" 7 ", "String", "Int", 7),
        ("7.0", "String", "Int", None),
        ("9223372036854775808", "String", "Int", None),
        ("1e3", "String", "Float", 1000.0),
        ("inf", "String", "Float", None),
        ("NaN", "String", "Float", None),
        ("true", "String", "Boolean", True),
        ("TRUE", "String", "Boolean", None),
        (2.0, "Float", "Int", 2),
        (2.5, "Float", "Int", None),
        (1e19, "Float", "Int", None),
        (2**53, "Int", "Float", float(2**53)),
        (2**53 + 1, "Int", "Float", None),
        (2**63 - 1, "Int", "Float", None),
        (True, "Boolean", "String", "true"),
        (5, "Int", "String", "5"),
    ],
)
def test_conversions(spark, value, old, new, found):
    from tessera.catalog import SCALARS
    from tessera.functions.conversions import convert
    from tessera.graph import q

    frame = spark.createDataFrame([(value,)], f"v {SCALARS[old].simpleString()}")
    assert frame.select(convert(q("v"), old, new)).first()[0] == found


def test_paths(spark):
    c = Connection.open_in_memory(spark)
    c.apply_schema("node N { k: Int } edge E { from: N to: N } edge F { from: N to: N }")
    n = c.insert_nodes("N", [{"k": i} for i in range(8)])
    e = c.insert_edges("E", [(n[a], n[b], {}) for a, b in [(0, 1), (1, 2), (2, 3), (3, 4), (0, 5)]])
    f = c.insert_edge("F", n[0], n[3])
    assert c.shortest_path(n[0], n[0]) == {"nodes": [n[0]], "edges": []}
    assert c.shortest_path(n[0], n[4]) == {"nodes": [n[0], n[3], n[4]], "edges": [f, e[3]]}
    assert c.shortest_path(n[0], n[4], 10, "outgoing", ["E"]) == {"nodes": n[:5], "edges": e[:4]}
    assert c.shortest_path(n[0], n[4], 3, "outgoing", ["E"]) is None
    assert c.shortest_path(n[4], n[0], 10, "outgoing") is None
    assert c.shortest_path(n[4], n[0], 10, "incoming", ["E"])["nodes"] == n[4::-1]
    assert c.shortest_path(n[0], n[7]) is None
    with pytest.raises(InvalidCommand):
        c.shortest_path(n[0], n[1], 3, "sideways")
    with pytest.raises(InvalidCommand):
        c.shortest_path(n[0], n[1], 3, "both", ["G"])
    assert c.connecting_subgraph([n[0], n[1], n[2]], edge_labels=["E"]) == {"nodes": n[:3], "edges": sorted(e[:2])}
    assert c.connecting_subgraph([n[4], n[5], n[2]], edge_labels=["E"]) == {"nodes": sorted([*n[:6]]), "edges": sorted(e)}
    assert c.connecting_subgraph([n[1], n[7]]) == {"nodes": [n[1], n[7]], "edges": []}
    assert {r["node_id"] for r in paths.neighbors(c.graph, n[3], "incoming").collect()} == {n[2], n[0]}


def test_dangling(c):
    u, p = c.insert_node("User", {}), c.insert_node("Project", {})
    c.insert_edge("OWNS", u, p)
    c.graph.nodes["Project"] = c.graph.nodes["Project"].where("false")
    assert len(c.verify()) == 1 and "no node" in c.verify()[0]
    assert mutations.dangling(c.graph).count() == 1


def test_time_values(c):
    u = c.insert_node("User", {"born": 86400000})
    assert c.graph.nodes["User"].first()["born"] == datetime.datetime(1970, 1, 2) or c.get_node_properties(u)["born"].startswith("1970-01-02")

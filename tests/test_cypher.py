import pytest

from tessera.api import Connection
from tessera.errors import InvalidCommand, TypeMismatch, ValidationError

PEOPLE = """
node Person { name: String age: Int }
node City { name: String }
edge KNOWS { from: Person to: Person props: { since: String } }
edge LIVES_IN { from: Person to: City }
node 人物 { 名前: String `first name`: String }
edge `works at` { from: 人物 to: City }
"""


@pytest.fixture
def c(spark):
    c = Connection.open_in_memory(spark)
    c.apply_schema(PEOPLE)
    people = c.insert_nodes("Person", [{"name": "Alice", "age": 30}, {"name": "Bob", "age": 25}, {"name": "Carol", "age": 35}, {"name": "Dan"}])
    city = c.insert_node("City", {"name": "Oslo"})
    c.insert_edges("KNOWS", [(people[0], people[1], {"since": "2024"}), (people[1], people[2], {}), (people[0], people[0], {})])
    c.insert_edge("LIVES_IN", people[0], city)
    return c


def rows(c, text, **how):
    return c.cypher(text, **how).value()


def names(c, text, key="n"):
    return sorted(r.get(key) for r in rows(c, text))


def test_reading(c):
    assert names(c, "MATCH (n:Person) WHERE n.age > 28 RETURN n.name AS n") == ["Alice", "Carol"]
    assert rows(c, "MATCH (n:Person {name: 'Bob'}) RETURN n.age") == [{"n.age": 25}]
    found = rows(c, "MATCH (a:Person)-[r:KNOWS {since: '2024'}]->(b) RETURN a, r, b")
    assert len(found) == 1 and found[0]["r"]["type"] == "KNOWS"
    assert found[0]["r"]["source"] == found[0]["a"]["id"] and found[0]["r"]["target"] == found[0]["b"]["id"]
    assert found[0]["a"]["labels"] == ["Person"] and found[0]["a"]["properties"] == {"name": "Alice", "age": 30}
    assert names(c, "MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(n) WHERE a.name = 'Alice' RETURN n.name AS n") == ["Alice", "Bob", "Carol"]
    assert names(c, "MATCH (c:City)<-[:LIVES_IN]-(n) RETURN n.name AS n") == ["Alice"]
    assert names(c, "MATCH (a {name: 'Bob'})--(n:Person) RETURN n.name AS n") == ["Alice", "Carol"]
    assert [r["n"] for r in rows(c, "MATCH (a {name: 'Bob'})--(n) RETURN n.name AS n", compat=True)] == ["Carol"]
    assert names(c, "MATCH (n)-[:KNOWS]->(n) RETURN n.name AS n") == ["Alice"]
    assert len(rows(c, "MATCH (a:Person), (b:Person) RETURN a.name AS a, b.name AS b")) == 16
    assert rows(c, "MATCH (c {name: 'Carol'}), (a)-[:KNOWS {since: '2024'}]->(b) RETURN c.name AS c, a.name AS a") == [{"c": "Carol", "a": "Alice"}]
    assert names(c, "MATCH (a)-[:KNOWS]->(b), (b)-[:KNOWS]->(n) WHERE a.name = 'Alice' AND b.name = 'Bob' RETURN n.name AS n") == ["Carol"]
    assert len(rows(c, "MATCH (:Person) RETURN 1")) == 4
    assert rows(c, "RETURN 1") == []
    assert len(rows(c, "MATCH (a)-[r:KNOWS|LIVES_IN]->(b) RETURN r")) == 4


def test_projection(c):
    assert [r["k"] for r in rows(c, "MATCH (n:Person) RETURN n.name AS k ORDER BY n.age DESC")] == ["Carol", "Alice", "Bob", "Dan"]
    assert [r["k"] for r in rows(c, "MATCH (n:Person) RETURN n.name AS k ORDER BY k SKIP 1 LIMIT 2")] == ["Bob", "Carol"]
    assert rows(c, "MATCH (a)-[r]->(b:Person) RETURN DISTINCT a.name AS a ORDER BY a LIMIT 1") == [{"a": "Alice"}]
    assert rows(c, "MATCH (n {name: 'Bob'}) RETURN n.age * 2 + 1") == [{"value": 51}]
    assert rows(c, "MATCH (n {name: 'Dan'}) RETURN n.age") == [{}]
    assert rows(c, "MATCH (n:Person {name: 'Bob'}) RETURN *")[0]["n"]["properties"]["age"] == 25


@pytest.mark.parametrize(
    ("test", "found"),
    [
        ("n.age >= 25 AND n.age <= 30", ["Alice", "Bob"]),
        ("20 < n.age < 30", ["Bob"]),
        ("n.age = 25.0", ["Bob"]),
        ("n.age <> 25", ["Alice", "Carol"]),
        ("n.age = 'x'", []),
        ("NOT n.age > 26", ["Bob", "Dan"]),
        ("n.age > 26 XOR n.name = 'Alice'", ["Carol"]),
        ("n.age IS NULL", ["Dan"]),
        ("n.age IS NOT NULL AND NOT n.name CONTAINS 'o'", ["Alice"]),
        ("n.name STARTS WITH 'A' OR n.name ENDS WITH 'n'", ["Alice", "Dan"]),
        ("n.name =~ '.*l.*'", ["Alice", "Carol"]),
        ("n.name", ["Alice", "Bob", "Carol", "Dan"]),
        ("null", []),
        ("n.age / 10 = 3", ["Alice", "Carol"]),
        ("n.age / 0 = 3", []),
        ("-n.age < -(+30)", ["Carol"]),
        ("n.nothing = 1", []),
        ("n.name = \"Al\\u0069ce\"", ["Alice"]),
        ("n.age IN [25, 30, 'x']", ["Alice", "Bob"]),
        ("NOT n.age IN [25]", ["Alice", "Carol", "Dan"]),
        ("n.age IN []", []),
        ("CASE WHEN n.age > 26 THEN 'old' WHEN n.age > 1 THEN 'young' END = 'young'", ["Bob"]),
        ("CASE n.name WHEN 'Dan' THEN 1 ELSE 0 END = 1", ["Dan"]),
        ("toUpper(n.name) = 'BOB' OR size(n.name) = 3 AND coalesce(n.age, 7) = 7", ["Bob", "Dan"]),
        ("n.name =~ n.name", ["Alice", "Bob", "Carol", "Dan"]),
        ("n.name =~ ('(')", []),
        ("abs(n.age - 40) > 12 AND toInteger('3') = 3", ["Bob"]),
    ],
)
def test_expressions(c, test, found):
    assert names(c, f"MATCH (n:Person) WHERE {test} RETURN n.name AS n") == found


def test_grouped(c):
    assert rows(c, "MATCH (n:Person) RETURN count(*) AS all, count(n.age) AS ages, count(DISTINCT n.age) AS different, sum(n.age) AS s, min(n.name) AS first") == [
        {"all": 4, "ages": 3, "different": 3, "s": sum(r["a"] for r in rows(c, "MATCH (n:Person) WHERE n.age > 0 RETURN n.age AS a")), "first": "Alice"}
    ]
    assert rows(c, "MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, count(r) AS n ORDER BY n DESC, a LIMIT 1") == [{"a": "Alice", "n": 2}]
    assert rows(c, "MATCH (n:Person {name: 'Nobody'}) RETURN count(*)") == [{"count(*)": 0}]
    assert sorted(rows(c, "MATCH (n:City) RETURN collect(n.name) AS x")[0]["x"]) == sorted(names(c, "MATCH (n:City) RETURN n.name AS n"))


def test_optional(c):
    found = rows(c, "MATCH (n:Person) OPTIONAL MATCH (n)-[:LIVES_IN]->(x:City) RETURN n.name AS n, x.name AS x, x")
    assert {r["n"]: r.get("x") is not None for r in found} == {"Alice": True, "Bob": False, "Carol": False, "Dan": False}
    found = rows(c, "MATCH (n:Person {name: 'Alice'}) OPTIONAL MATCH (n)-[:KNOWS]->(m) WHERE m.name = 'Bob' RETURN m.name AS m")
    assert found == [{"m": "Bob"}]
    assert rows(c, "MATCH (n:Person {name: 'Dan'}) OPTIONAL MATCH (n)-[:KNOWS]->(m) RETURN count(m) AS k, count(*) AS all") == [{"k": 0, "all": 1}]


def test_merge_for_each_row(c):
    assert rows(c, "MATCH (n:Person) MERGE (x:City {name: n.name}) RETURN n.name AS n, x.name AS x ORDER BY n") == [{"n": n, "x": n} for n in ("Alice", "Bob", "Carol", "Dan")]
    assert c.count_nodes("City") == 5
    assert rows(c, "MATCH (n:Person) MERGE (x:City {name: n.name})") == {"created": {"nodes": 0, "edges": 0}}
    assert rows(c, "MATCH (n:Person) MERGE (x:City {name: 'One'}) CREATE (n)-[:LIVES_IN]->(x)") == {"created": {"nodes": 1, "edges": 4}}
    assert len(rows(c, "MATCH (n)-[:LIVES_IN]->(x {name: 'One'}) RETURN n.name AS n")) == 4
    assert c.verify() == []


def test_no_match(c):
    found = c.cypher("RETURN 1 AS one").frame
    assert found.columns == ["one"] and found.collect() == []


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_plans(spark):
    """Filters reach the scan, and an equality across patterns joins by hash or merge."""
    from tessera import queries

    folder = "/root/testdata/sf0.001"
    for name, columns in (("cypher_match_where_return", ("c_acctbal", "c_mktsegment")), ("cypher_inline_properties", ("p_size", "p_brand"))):
        scan = [x for x in plan_of(queries.FOUND[name](spark, folder)).splitlines() if "PushedFilters" in x][-1]
        assert f"PushedFilters: [IsNotNull({columns[0]})" in scan and f"isnotnull({columns[1]}" in scan, scan
    g = queries.graph_of(spark, folder)
    text = "MATCH (a:Customer), (b:Order), (r:Region) WHERE a.c_custkey = b.o_custkey AND r.r_regionkey < 2 AND a.c_acctbal = b.o_totalprice RETURN a.c_custkey AS a, b.o_orderkey AS b"
    physical = plan_of(queries.cypher_plan.execute(g, text).frame).split("== Physical Plan ==")[1]
    joins = [x for x in physical.splitlines() if "HashJoin" in x or "SortMergeJoin" in x]
    assert any("c_custkey" in x and "c_acctbal" in x for x in joins)
    text = "MATCH (c:Customer)-[:PLACED]->(o:Order), (s:Supplier) WHERE s.s_nationkey = c.c_nationkey RETURN s.s_suppkey AS s, o.o_orderkey AS o"
    physical = plan_of(queries.cypher_plan.execute(g, text).frame).split("== Physical Plan ==")[1]
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_unicode(c):
    rows(c, "CREATE (p:人物 {名前: '花', `first name`: 'Hana'})-[:`works at`]->(c:City {name: '東京'})")
    assert rows(c, "MATCH (p:人物)-[:`works at`]->(c) WHERE p.`first name` = 'Hana' RETURN p.名前, c.name AS c") == [{"p.名前": "花", "c": "東京"}]


def test_create_and_merge(c):
    assert rows(c, "CREATE (n:Person {name: 'Eve', age: 1})") == {"created": {"nodes": 1, "edges": 0}}
    assert rows(c, "CREATE (a:Person {name: 'F'})-[:KNOWS {since: '1'}]->(b:Person {name: 'G'}), (b)-[:KNOWS]->(a)") == {"created": {"nodes": 2, "edges": 2}}
    assert rows(c, "MATCH (n:Person), (x:City) CREATE (n)-[:LIVES_IN]->(x)") == {"created": {"nodes": 0, "edges": 7}}
    assert len(rows(c, "MATCH (n)-[:LIVES_IN]->(x) RETURN n.name AS n")) == 8
    assert rows(c, "MATCH (n:Person {age: 99}) CREATE (n)-[:KNOWS]->(n)") == {"created": {"nodes": 0, "edges": 0}}
    assert rows(c, "CREATE (n:Person {name: 'H'}) RETURN n.name AS n") == [{"n": "H"}]
    assert rows(c, "MERGE (n:Person {name: 'Alice'}) RETURN n.age AS a") == [{"a": 30}]
    assert rows(c, "MERGE (n:Person {name: 'New'}) RETURN n.name AS n") == [{"n": "New"}]
    assert c.verify() == []
    for bad in ("CREATE (n:Nobody)", "CREATE (n:Person {no: 1})", "CREATE (a:City {name: 'x'})-[:KNOWS]->(b:City {name: 'y'})"):
        with pytest.raises(ValidationError):
            rows(c, bad)
    with pytest.raises(TypeMismatch):
        rows(c, "CREATE (n:Person {age: 'old'})")
    assert c.count_nodes("City") == 1


def test_updates(c):
    assert rows(c, "MATCH (n:Person {name: 'Alice'}) SET n.age = n.age + 1, n.name = 'Al' RETURN n.age AS a, n.name AS n") == [{"a": 31, "n": "Al"}]
    assert rows(c, "MATCH (a)-[r:KNOWS]->(b {name: 'Bob'}) SET r.since = '2025'") == {"updated": 1}
    assert rows(c, "MATCH ()-[r:KNOWS {since: '2025'}]->() RETURN r.since") == [{"r.since": "2025"}]
    assert rows(c, "MATCH (n:Person) REMOVE n.age") == {"updated": 4}
    assert names(c, "MATCH (n:Person) WHERE n.age IS NOT NULL RETURN n.name AS n") == []
    assert rows(c, "MATCH (n:Person {name: 'Zed'}) SET n.age = 1") == {"updated": 0}
    with pytest.raises(ValidationError):
        rows(c, "MATCH (n:Person) SET n.no = 1")
    with pytest.raises(TypeMismatch):
        rows(c, "MATCH (n:Person) SET n.age = 'x'")


def test_delete(c):
    assert rows(c, "MATCH (a)-[r:KNOWS]->(b {name: 'Bob'}) DELETE r") == {"deleted": 1}
    assert c.count_nodes() == 5 and c.count_edges("KNOWS") == 2
    assert rows(c, "MATCH (a:Person {name: 'Alice'}), (b:Person) DELETE a") == {"deleted": 1}
    assert c.count_nodes("Person") == 3 and c.count_edges("KNOWS") == 1 and c.count_edges("LIVES_IN") == 0
    assert c.verify() == []


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (n:Person) MATCH (m:Person) RETURN n",
        "OPTIONAL MATCH (n:Person) RETURN n",
        "MATCH (n:Person) WITH n RETURN n",
        "UNWIND [1] AS x RETURN x",
        "MATCH (n)-[*1..3]->(m) RETURN m",
        "MATCH (n)-[:KNOWS]->+(m) RETURN m",
        "MATCH (n:Person) RETURN n UNION MATCH (n:City) RETURN n",
        "MATCH (n:Person) RETURN nothing(n)",
        "MATCH (n:Person) RETURN count(n) + 1",
        "MATCH (n:Person) RETURN count(n) AS k ORDER BY n.age",
        "MATCH (n:Person) RETURN CASE WHEN n.age > 1 THEN 1 ELSE 'x' END",
        "MATCH (n:Person) WHERE n.age > 'x' RETURN n",
        "MATCH (n:Typo) RETURN n",
        "MATCH (n:Person) RETURN m",
        "CREATE (n:Person {name: 'x'}) SET n.age = 1",
        "MATCH (n:Person) MERGE (m:Person {name: 'x'}) SET n.age = 1",
        "SET n.age = 1",
        "MATCH (n:Person) SET m.age = 1",
        "MATCH (n:Person) DELETE m",
        "MATCH (n:Person) REMOVE n:Person",
        "MERGE (a:Person)-[:KNOWS]->(b:Person)",
        "MATCH (n:Person) FOREACH (x IN [1] | SET n.age = 1)",
        "MATCH (n:Person RETURN n",
        "MATCH (n:Person) RETURN n LIMIT 'x'",
        "MATCH (n:Person) RETURN n.age % 2",
        "MATCH (n:Person) RETURN $p",
    ],
)
def test_refused(c, text):
    before = c.count_nodes()
    with pytest.raises(InvalidCommand):
        rows(c, text)
    assert c.count_nodes() == before

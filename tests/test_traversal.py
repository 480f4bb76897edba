import random

import pytest

from tessera.api import Connection
from tessera.errors import InvalidCommand, NodeNotFound

LIBRARY = """
node Reader { id: String nick: String }
node Shelf { id: String sign: String locked: Boolean marks: List<String> extra: Json rank: Int floor: Int }
edge BORROWS { from: Reader to: Shelf props: { term: String } }
"""


@pytest.fixture(scope="module")
def own(spark):
    c = Connection.open_in_memory(spark)
    c.apply_schema(LIBRARY)
    readers = c.insert_nodes("Reader", [{"id": "r1", "nick": "Ines"}, {"id": "r2", "nick": "Tariq"}])
    shelves = c.insert_nodes(
        "Shelf",
        [
            {"id": "s1", "sign": "Walnut", "locked": False, "marks": ["oak", "Cedar"], "extra": {"depth": 512, "by": {"hand": "Odile"}}, "rank": 41, "floor": 30},
            {"id": "s2", "sign": "Teak", "locked": True, "extra": {"depth": 498, "state": "full"}, "rank": 12, "floor": 30},
            {"id": "s3", "sign": "Mahogany", "extra": {"depth": "344"}, "rank": 37, "floor": 30},
        ],
    )
    c.insert_edges("BORROWS", [(readers[0], shelves[0], {"term": "long"}), (readers[0], shelves[1], {"term": "short"}), (readers[1], shelves[0], {"term": "hall"})])
    return c


def ids(c, steps, start=None, collect=None, **more):
    start = start or {"type": "Node", "label": "Reader", "key": "id", "value": "r1"}
    rows = c.traverse({"version": 1, "start": start, "steps": steps, "collect": collect or {"type": "Nodes", "properties": ["id"]}, **more}).value()
    return [r.get("id") for r in rows] if isinstance(rows, list) else rows


def hop(**more):
    return [{"action": "OutEdges", "label": "BORROWS"}, {"action": "OutNodes", "label": "Shelf", **more}]


SHELVES = {"type": "AllNodes", "label": "Shelf"}


def test_movement(own):
    assert set(ids(own, hop())) == {"s1", "s2"}
    assert ids(own, hop(filter={"property": "locked", "operator": "Equals", "value": False})) == ["s1"]
    back = [{"action": "InEdges", "label": "BORROWS"}, {"action": "InNodes", "label": "Reader"}]
    start = {"type": "Node", "label": "Shelf", "key": "id", "value": "s1"}
    assert set(ids(own, back, start)) == {"r1", "r2"}
    assert ids(own, [*hop(), *back], collect={"type": "Count"}) == {"count": 3}
    assert sorted(ids(own, [*hop(), *back, {"action": "Dedup"}])) == ["r1", "r2"]
    assert ids(own, [{"action": "BothEdges"}, {"action": "BothNodes"}], collect={"type": "Count"}) == {"count": 4}


def test_newest_edge_first(own):
    assert ids(own, [*hop(), {"action": "Limit", "count": 1}]) == ["s2"]
    assert ids(own, [*hop(), {"action": "Skip", "skip": 1}]) == ["s1"]


def test_start(own):
    with pytest.raises(NodeNotFound):
        ids(own, [], {"type": "Node", "label": "Reader", "key": "id", "value": "nobody"})
    start = {"type": "Node", "label": "Reader", "key": "id", "value": {"$bind": "who"}}
    assert ids(own, [], start, bindings={"who": "r2"}) == ["r2"]
    with pytest.raises(NodeNotFound):
        ids(own, [], start)
    with pytest.raises(InvalidCommand):
        ids(own, [], {"type": "AllNodes", "label": "Typo"})


def narrow(own, **step):
    return sorted(ids(own, [{"action": "Filter", **step}], SHELVES))


def one(name, operator, value=None):
    return {"property": name, "operator": operator, "value": value}


@pytest.mark.parametrize(
    ("test", "found"),
    [
        (one("sign", "Equals", "Walnut"), ["s1"]),
        (one("sign", "NotEquals", "Walnut"), ["s2", "s3"]),
        (one("locked", "NotEquals", True), ["s1"]),
        (one("sign", "Equals", 5), []),
        (one("sign", "NotEquals", 5), ["s1", "s2", "s3"]),
        (one("rank", "GreaterThan", 12), ["s1", "s3"]),
        (one("rank", "GreaterThan", 36.5), ["s1", "s3"]),
        (one("rank", "LessThanOrEquals", 37), ["s2", "s3"]),
        (one("locked", "GreaterThan", False), []),
        (one("rank", "PropertyGreaterThan", {"type": "property", "key": "floor"}), ["s1", "s3"]),
        (one("rank", "LessThan", {"type": "property", "key": "floor"}), ["s2"]),
        (one("rank", "GreaterThan", {"type": "property", "key": "sign"}), []),
        (one("sign", "Contains", "a"), ["s1", "s2", "s3"]),
        (one("sign", "StartsWith", "Wa"), ["s1"]),
        (one("sign", "EndsWith", "ak"), ["s2"]),
        (one("sign", "Matches", "^.{4}$"), ["s2"]),
        (one("sign", "Matches", "("), []),
        (one("locked", "Exists"), ["s1", "s2"]),
        (one("locked", "IsNull"), ["s3"]),
        (one("nothing", "IsNull"), ["s1", "s2", "s3"]),
        (one("nothing", "Equals", 1), []),
        (one({"path": ["extra", "depth"]}, "Equals", 512), ["s1"]),
        (one({"path": ["extra", "depth"]}, "Equals", "344"), ["s3"]),
        (one({"path": ["extra", "depth"]}, "NotEquals", 512), ["s2", "s3"]),
        (one({"path": ["extra", "by", "hand"]}, "StartsWith", "Od"), ["s1"]),
        (one({"path": ["extra", "by"]}, "Exists"), ["s1"]),
        (one({"path": ["extra", "by", "no"]}, "Exists"), []),
    ],
)
def test_filters(own, test, found):
    assert narrow(own, filter=test) == found
    rest = sorted({"s1", "s2", "s3"} - set(found))
    assert narrow(own, compound_filter={"operator": "Not", "filter": test}) == rest


def test_compound(own):
    a, b = one("sign", "StartsWith", "Wa"), one("sign", "Contains", "e")
    assert narrow(own, compound_filter={"operator": "Or", "filters": [a, b]}) == ["s1", "s2"]
    assert narrow(own, compound_filter={"operator": "And", "filters": [a, {"operator": "Not", "filter": b}]}) == ["s1"]
    assert narrow(own, compound_filter={"operator": "And", "filters": []}) == ["s1", "s2", "s3"]
    with pytest.raises(InvalidCommand):
        narrow(own, compound_filter={"operator": "Nor", "filters": []})


def test_any_key(own):
    assert narrow(own, any_key_contains="CEDAR") == ["s1"]
    assert narrow(own, any_key_contains="odi") == ["s1"]
    assert narrow(own, any_key_contains="depth") == []
    assert narrow(own, any_key_contains="s") == ["s1", "s2", "s3"]


def test_custom_filter(own, spark):
    c = Connection(own.graph)
    c.register_filter("high", lambda frame: frame["rank"] > 30)
    c.register_filter("rows", lambda frame: frame.where("rank < 20"))
    assert narrow(c, custom_filter={"callback_id": "high"}) == ["s1", "s3"]
    assert narrow(c, custom_filter={"callback_id": "rows"}) == ["s2"]
    assert narrow(c, custom_filter={"callback_id": "nobody"}) == ["s1", "s2", "s3"]
    with pytest.raises(InvalidCommand):
        ids(c, [{"action": "OutEdges", "custom_filter": {"callback_id": "high"}}])


def test_order(own):
    by = lambda way, key="rank": {"action": "OrderBy", "order_by": {"key": key, "direction": way}}
    assert ids(own, [by("Asc")], SHELVES) == ["s2", "s3", "s1"]
    assert ids(own, [by("Desc")], SHELVES) == ["s1", "s3", "s2"]
    assert ids(own, [by("Asc", "locked")], SHELVES) == ["s3", "s1", "s2"]
    assert ids(own, [by("Desc", "locked")], SHELVES) == ["s2", "s1", "s3"]
    assert ids(own, [by("Asc"), {"action": "Skip", "skip": 1}, {"action": "Limit", "count": 1}], SHELVES) == ["s3"]
    assert ids(own, [by("Asc"), {"action": "Limit", "count": 2, "filter": one("id", "Equals", "s1")}], SHELVES) == []
    assert ids(own, [by("Asc", {"path": ["extra", "depth"]})], SHELVES)[1:] == ["s2", "s1"]
    with pytest.raises(InvalidCommand):
        ids(own, [{"action": "OrderBy"}], SHELVES)


def test_collectors(own):
    edges = {"type": "AllEdges", "label": "BORROWS"}
    assert sorted(r["term"] for r in own.traverse({"start": edges, "collect": {"type": "Edges", "properties": ["term"]}}).value()) == ["hall", "long", "short"]
    rows = own.traverse({"start": edges, "collect": {"type": "Nodes", "properties": ["id"], "with_edges": {"label": "BORROWS", "properties": ["term"]}}}).value()
    assert {(r["id"], r["edge_term"]) for r in rows} == {("s1", "long"), ("s2", "short"), ("s1", "hall")}
    assert all("edge_term" not in r for r in own.traverse({"start": edges, "collect": {"type": "Nodes", "with_edges": {"label": "OTHER"}}}).value())
    assert own.traverse({"start": SHELVES, "collect": {"type": "Edges"}}).value() == []
    assert own.traverse({"start": SHELVES, "collect": {"type": "Exists"}}).value() == {"exists": True}
    path = own.traverse({"start": SHELVES, "collect": {"type": "Path", "node_specs": [{"label": "Shelf", "properties": ["id"]}]}}).value()
    assert [len(p["path"]) for p in path] == [1, 1, 1] and path[0]["path"][0]["label"] == "Shelf"
    functions = [{"func": "Count"}, {"func": "Sum", "property": "rank"}, {"func": "Avg", "property": "sign"}, {"func": "Min", "property": "sign"}, {"func": "Max", "property": {"path": ["extra", "depth"]}}]
    assert own.traverse({"start": SHELVES, "collect": {"type": "Aggregate", "functions": functions}}).value() == {"count": 3, "sum_rank": 90.0, "min_sign": "Mahogany", "max_extra.depth": "512.0"}
    groups = own.traverse({"start": SHELVES, "collect": {"type": "GroupBy", "key": {"source": "Node", "property": "locked"}, "functions": [{"func": "Count"}]}}).value()
    assert groups == [{"_group": "false", "count": 1}, {"_group": "null", "count": 1}, {"_group": "true", "count": 1}]


@pytest.mark.parametrize("steps", [[{"action": "OutNodes"}], [{"action": "OutEdges"}, {"action": "OutEdges"}], [{"action": "OutEdges"}, {"action": "HasLabel", "labels": ["Reader"]}], [{"action": "Fly"}], [{"action": "OutEdges"}, {"action": "Repeat", "repeat_steps": []}]])
def test_wrong_cursor(own, steps):
    with pytest.raises(InvalidCommand):
        ids(own, steps)


def test_labels(own):
    c = Connection(own.graph)
    first = c.find_node("Shelf", "id", "s1")
    assert c.add_node_label_dynamic(first, "Shiny") and not c.add_node_label_dynamic(first, "Shiny")
    assert ids(c, [], {"type": "AllNodes", "label": "Shiny"}) == ["s1"]
    assert ids(c, [{"action": "HasLabel", "labels": ["Shiny", "Reader"]}], SHELVES) == ["s1"]
    assert ids(c, [{"action": "HasLabel", "labels": []}], SHELVES) == []
    assert ids(c, [*hop()[:1], {"action": "OutNodes", "label": "Shiny"}]) == []  # a node's own type only
    edge = c.list_edges("BORROWS").first()["__id"]
    c.add_edge_label_dynamic(edge, "SECRET")
    assert ids(c, [{"action": "OutEdges", "label": "SECRET"}], {"type": "AllNodes", "label": "Reader"}, {"type": "Count"}) == {"count": 1}


def test_repeat(own, spark):
    c = Connection.open_in_memory(spark)
    c.apply_schema("node N { id: Int } edge E { from: N to: N }")
    n = c.insert_nodes("N", [{"id": i} for i in range(7)])
    c.insert_edges("E", [(n[a], n[b], {}) for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6)]])
    walk = [{"action": "OutEdges"}, {"action": "OutNodes"}]
    start = {"type": "Node", "label": "N", "key": "id", "value": 0}
    reach = lambda depth, inner=walk, more=(): sorted(ids(c, [{"action": "Repeat", "repeat_steps": inner, "max_depth": depth}, *more], start))
    assert reach(1) == [0, 1]
    assert reach(2) == [0, 1, 2]
    assert reach(4) == [0, 1, 2, 3, 4]
    assert reach(9) == list(range(7))
    assert reach(3, walk[:1]) == [0]
    assert reach(5, [*walk, {"action": "Limit", "count": 1}]) == [0, 1, 2, 3, 4, 5]  # the newest edge leads on
    assert ids(c, [{"action": "Repeat", "repeat_steps": walk, "max_depth": 3}, {"action": "Limit", "count": 2}], start) == [0, 1]


def test_random_graphs(spark):
    """Bags of nodes after random walks, against lists."""
    rng = random.Random(7)
    for _ in range(4):
        count = rng.randrange(2, 9)
        edges = [(rng.randrange(count), rng.randrange(count)) for _ in range(rng.randrange(0, 20))]
        c = Connection.open_in_memory(spark)
        c.apply_schema("node N { id: Int } edge E { from: N to: N }")
        n = c.insert_nodes("N", [{"id": i} for i in range(count)])
        c.insert_edges("E", [(n[a], n[b], {}) for a, b in edges])
        bag, steps = [0], []
        for _ in range(3):
            way = rng.choice(["Out", "In", "Both"])
            steps += [{"action": f"{way}Edges"}, {"action": f"{way}Nodes"}]
            out = [e for x in bag for e in edges if e[0] == x]
            into = [e for x in bag for e in edges if e[1] == x]
            moved = {"Out": out, "In": into, "Both": out + into}[way]
            bag = [x for e in moved for x in {"Out": e[1:], "In": e[:1], "Both": e[::-1]}[way]]
        start = {"type": "Node", "label": "N", "key": "id", "value": 0}
        assert sorted(ids(c, steps, start)) == sorted(bag)
        assert sorted(ids(c, [*steps, {"action": "Dedup"}], start)) == sorted(set(bag))

import json
import subprocess
import sys
from pathlib import Path

import pytest

from tessera.api import Connection, copied
from tessera.errors import InvalidCommand, NodeNotFound, TypeMismatch, ValidationError
from tessera.sources import text_files
from tessera.streaming import table_stream

SCHEMA = """
node Ship { id: String flag: String draught: Float afloat: Boolean launched: DateTime log: Json }
node Port { id: String town: String }
edge ESCORTS { from: Ship to: Ship props: { reason: String } }
edge CALLS_AT { from: Ship to: Port props: { pilot: String } }
"""


@pytest.fixture
def c(spark):
    c = Connection.open_in_memory(spark)
    c.apply_schema(SCHEMA)
    return c


def put(tmp_path, name, text):
    at = tmp_path / name
    at.write_text(text, encoding="utf-8")
    return f"file://{at}"


def test_csv(c, tmp_path):
    nodes = put(tmp_path, "n.csv", ':TYPE,id,flag,draught,afloat,launched\nShip,ada,"No, ""way""",7.25,false,1999-12-31T23:00:00Z\nShip,bo,"red\nwhite",,,172800000\n')
    assert c.import_csv(nodes) == {"nodes": 2, "edges": 0}
    found = {p["id"]: p for p in (c.get_node_properties(r["__id"]) for r in c.list_nodes("Ship").select("__id").collect())}
    assert found["ada"] == {"id": "ada", "flag": 'No, "way"', "draught": 7.25, "afloat": False, "launched": "1999-12-31T23:00:00.000Z"}
    assert found["bo"] == {"id": "bo", "flag": "red\nwhite", "launched": "1970-01-03T00:00:00.000Z"}
    assert c.import_csv(put(tmp_path, "e.csv", ":TYPE,:FROM,:TO,reason\nESCORTS,ada,bo,ice\n"), plain=True) == {"nodes": 0, "edges": 1}
    assert c.cypher("MATCH (a)-[r:ESCORTS]->(b) RETURN a.id AS a, r.reason AS r, b.id AS b").value() == [{"a": "ada", "r": "ice", "b": "bo"}]
    c.export_csv("ESCORTS", f"file://{tmp_path}/out")
    assert "\n".join(p.read_text() for p in Path(tmp_path, "out").glob("*.csv")).strip() == ":TYPE,:FROM,:TO,reason\nESCORTS,ada,bo,ice"
    for text, error in (
        ("id\nada\n", InvalidCommand),
        (":TYPE,id\nNobody,x\n", ValidationError),
        (":TYPE,no\nShip,x\n", ValidationError),
        (":TYPE,draught\nShip,x\n", TypeMismatch),
        (":TYPE,:FROM,:TO\nESCORTS,ada,nobody\n", NodeNotFound),
    ):
        with pytest.raises(error):
            c.import_csv(put(tmp_path, "bad.csv", text))
    assert c.count_nodes() == 2


def test_inference(c, tmp_path, spark):
    frame = text_files.read_csv(c.graph, put(tmp_path, "t.csv", ":TYPE,a,b,c,d,e,f\nX,1,1.5,true,1999-12-31T23:00:00Z,nan,\nX,2,2,false,2001-01-02T00:00:00Z,1,\n"))
    assert text_files.infer_types(frame) == {"a": "Int", "b": "Float", "c": "Boolean", "d": "DateTime", "e": "String", "f": "String"}


def test_types_declared_by_a_file(spark, tmp_path):
    """Types that the schema lacks are declared as their cells read, if asked for."""
    c = Connection.open_in_memory(spark)
    nodes = put(tmp_path, "n.csv", ":TYPE,id,length,steam\nTug,t1,20,true\nTug,t2,31,false\nBuoy,b1,2.5,\n")
    with pytest.raises(ValidationError):
        c.import_csv(nodes)
    assert c.import_csv(nodes, declare=True) == {"nodes": 3, "edges": 0}
    assert {f["name"]: f["type"] for f in c.node_type_schema("Tug")} == {"id": "String", "length": "Int", "steam": "Boolean"}
    assert {f["name"]: f["type"] for f in c.node_type_schema("Buoy")} == {"id": "String", "length": "Float"}
    assert c.import_csv(put(tmp_path, "e.csv", ":TYPE,:FROM,:TO,n\nPASSED,t1,b1,3\n"), declare=True) == {"nodes": 0, "edges": 1}
    assert c.cypher("MATCH (a)-[r:PASSED]->(b) RETURN a.length AS a, r.n AS n, b.length AS b").value() == [{"a": 20, "n": 3, "b": 2.5}]


def test_json(c, tmp_path):
    items = [
        {"type": "Ship", "props": {"id": "ada", "flag": "F", "draught": 3, "afloat": True, "log": {"k": [1]}}},
        {"type": "Port", "props": {"id": "oslo", "town": "Oslo"}},
        {"type": "CALLS_AT", "from": "ada", "to": "oslo", "props": {"pilot": "none"}},
    ]
    for text in (json.dumps(items, indent=1), "[" + ",\n".join(map(json.dumps, items)) + "]", "\n".join(map(json.dumps, items))):
        d = Connection(copied(c.graph))
        assert d.import_json(put(tmp_path, "x.json", text)) == {"nodes": 2, "edges": 1}
        out = json.loads(text_files.json_array(d.graph))
        assert [o["type"] for o in out] == ["Ship", "Port", "CALLS_AT"] and out[2]["from"] == "ada" and out[2]["to"] == "oslo"
        assert out[0]["props"]["draught"] == 3.0 and json.loads(out[0]["props"]["log"]) == {"k": [1]}
        assert [o["type"] for o in json.loads(text_files.json_array(d.graph, "Port"))] == ["Port"]
    for text, error in (('{"type": "Ship"', InvalidCommand), ("7", InvalidCommand), ('[{"props": {}}]', InvalidCommand), ('{"props": {}}', InvalidCommand), ('[{"type": "Nobody", "props": {}}]', ValidationError)):
        with pytest.raises(error):
            c.import_json(put(tmp_path, "bad.json", text))


def test_json_there_and_back(c, tmp_path, spark):
    """What is exported is read again, edges at nodes without an id of their own included."""
    a, b = c.insert_nodes("Ship", [{"id": "ada", "log": {"a": [1, "x"]}, "draught": 1.5, "launched": "2001-02-03T04:05:06Z"}, {"flag": "none"}])
    p = c.insert_node("Port", {"town": "Oslo"})
    c.insert_edges("CALLS_AT", [(a, p, {"pilot": "x"}), (b, p, {})])
    c.export_json(f"file://{tmp_path}/all")
    d = Connection.open_in_memory(spark)
    d.apply_schema(SCHEMA)
    assert d.import_json(f"file://{tmp_path}/all") == {"nodes": 3, "edges": 2}
    show = "MATCH (s:Ship)-[r]->(p:Port) RETURN s.id AS id, s.flag AS flag, s.log AS log, s.draught AS d, s.launched AS l, r.pilot AS r, p.town AS t ORDER BY id"
    assert d.cypher(show).value() == c.cypher(show).value()


def test_stream(c, tmp_path, spark):
    rows = spark.createDataFrame([(1, "Port", ["Port"], "s1", "t"), (2, "Port", ["Port"], "s2", "t")], "__id long, __label string, __labels array<string>, id string, town string")
    rows.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        table_stream(c, "Port", f"file://{tmp_path}/in", f"file://{tmp_path}/at").awaitTermination()
        assert c.count_nodes("Port") == 2


def test_command_line(tmp_path):
    def run(*args):
        done = subprocess.run([sys.executable, "-m", "tessera", *args], capture_output=True, text=True, cwd=Path(__file__).parent.parent, timeout=300)
        return done.returncode, done.stdout.strip().splitlines()[-1]

    db = f"file://{tmp_path}/db"
    (tmp_path / "s.graph").write_text("node Buoy { id: String }")
    assert run("init", "--db", db)[0] == 0
    assert run("schema", "apply", "--db", db, "--schema", str(tmp_path / "s.graph"))[0] == 0
    assert json.loads(run("node", "add", "--db", db, "--type", "Buoy", "--props", '{"id": "x"}')[1])["success"]
    assert json.loads(run("cypher", "--db", db, "--text", "MATCH (b:Buoy) RETURN b.id AS id")[1])["result"] == [{"id": "x"}]
    code, line = run("node", "add", "--db", db, "--type", "Nobody")
    assert code == 1 and not json.loads(line)["success"]

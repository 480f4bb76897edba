import pytest

from tessera import ddl
from tessera.catalog import TypeIds, struct_of
from tessera.errors import SchemaError

HARBOUR = """
// ships, and what they carry where
node Ship { code: String @unique  flag: String  afloat: Boolean  launched: DateTime }
node Port { code: String  town: String @index  frozen: Boolean }
node Cargo { kind: String  scan: Vector<16>  weights: Map<String, List<Int>> }
edge CALLS_AT<S: Ship> { from: S to: Port props: { pilot: String since: DateTime } }
edge CARRIES { from: Ship to: Cargo props: { tons: Float } }
edge STORED { from: NodeRef<Cargo> to: Port }
node Crate<A, B> { left: A right: B }
node Tug extends Ship { power: String }
node 港 { 町: String @index  `old name`: String  `x``y`: Int  data: Json  raw: Blob  Integer: Integer }
"""


def test_round_trip():
    schema = ddl.parse(HARBOUR)
    assert ddl.parse(ddl.unparse(schema)) == schema
    assert schema.edges["CALLS_AT"].source_type == "Ship"
    assert schema.edges["STORED"].source_type == "Cargo"
    assert [f.name for f in schema.nodes["港"].fields] == ["町", "old name", "x`y", "data", "raw", "Integer"]
    assert schema.nodes["港"].columns["Integer"].type.user
    assert schema.nodes["Tug"].extends == "Ship" and len(schema.nodes["Tug"].fields) == 1


def test_spark_types():
    text = struct_of(ddl.parse(HARBOUR).nodes["Cargo"]).simpleString()
    assert "scan:array<float>" in text and "weights:map<string,array<bigint>>" in text


@pytest.mark.parametrize(
    "text",
    [
        "node A { x: Int @big }",
        "node A extends B { }",
        "node A { x: List<Int> @index }",
        "edge E { from: A to: A }",
        "node A {} edge E<T: B> { from: T to: A }",
        "node A { x: Vector<a> }",
        "node A { x Int }",
        "node A { x: Int } node A { }",
        "node A { __id: Int }",
        "thing A { }",
        "node A { x: Int",
        "node A { x: Int ? }",
    ],
)
def test_refused(text):
    with pytest.raises(SchemaError):
        ddl.parse(text)


def test_migration():
    old = ddl.parse("node A { x: Int y: String } edge E { from: A to: A }")
    old.check_migration(ddl.parse("node A { x: Int z: Float } node B { } edge E { from: A to: A }"))
    for bad in ("node A { x: Float }", "node A { } node B { } edge E { from: A to: B }"):
        with pytest.raises(SchemaError):
            old.check_migration(ddl.parse(bad))


def test_type_ids():
    ids = TypeIds()
    assert [ids.of("A"), ids.of("B"), ids.of("A")] == [1, 2, 1]
    assert TypeIds({"A": 1, "B": 5}).of("C") == 6

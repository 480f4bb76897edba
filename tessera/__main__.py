"""Command line: python -m tessera init | schema | node | edge | query | cypher | info | import | export | vacuum | verify."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from tessera import ddl
from tessera.api import Connection
from tessera.errors import GraphError
from tessera.operators.iteration import shared_folder


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)

    def command(*names: str, **options: dict) -> argparse.ArgumentParser:
        at = commands
        for name in names[:-1]:
            at = groups.setdefault(name, commands.add_parser(name).add_subparsers(dest="action", required=True)) if name not in groups else groups[name]
        p = at.add_parser(names[-1])
        p.add_argument("--db", required=True)
        for option, more in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", **more)
        return p

    groups: dict = {}
    need, brace = {"required": True}, {"default": "{}"}
    command("init")
    command("schema", "apply", schema=need)
    command("schema", "show")
    command("node", "add", type=need, props=brace)
    command("edge", "add", type=need, source={"required": True, "type": int}, target={"required": True, "type": int}, props=brace)
    command("query", json=need)
    command("cypher", text=need)
    command("info")
    command("vacuum")
    command("verify")
    command("import", format={"required": True, "choices": ["csv", "json"]}, id_prop={"default": "id"}, declare={"action": "store_true"}, plain={"action": "store_true"}).add_argument("file")
    command("export", format={"required": True, "choices": ["csv", "json"]}, type={}, out=need)
    return top


def stored_input(spark, kind: str) -> str:
    """Standard input as a file in the folder that the executors share."""
    path = f"{shared_folder(spark)}/stdin-{uuid.uuid4().hex}.{kind}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        while part := sys.stdin.buffer.read(1 << 20):
            out.write(part)
    finally:
        out.close()
    return path


def run(spark, args: argparse.Namespace) -> object:
    if args.command == "init":
        Connection.create(spark, args.db).close()
        return {"created": args.db}
    with Connection.open(spark, args.db) as c:
        action = getattr(args, "action", None)
        if args.command == "schema":
            if action == "show":
                return ddl.unparse(c.graph.schema)
            with open(args.schema, encoding="utf-8") as f:
                c.apply_schema(f.read())
            return {"applied": args.schema}
        if args.command == "node":
            return {"id": c.insert_node(args.type, args.props)}
        if args.command == "edge":
            return {"id": c.insert_edge(args.type, args.source, args.target, args.props)}
        if args.command == "query":
            return c.traverse(args.json).value()
        if args.command == "cypher":
            return c.cypher(args.text).value()
        if args.command == "import":
            path = args.file
            if path == "-":
                path = stored_input(spark, args.format)
            return c.import_csv(path, args.id_prop, args.declare, args.plain) if args.format == "csv" else c.import_json(path, args.id_prop)
        if args.command == "export":
            if args.format == "csv" and not args.type:
                raise GraphError("CSV holds one type: give --type")
            c.export_csv(args.type, args.out) if args.format == "csv" else c.export_json(args.out, args.type)
            return {"exported": args.out}
        return {"info": c.info, "vacuum": c.vacuum, "verify": c.verify}[args.command]()


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        found = run(spark, args)
    except (GraphError, OSError, ValueError) as error:
        print(json.dumps({"success": False, "error": str(error)}, ensure_ascii=False))
        return 1
    print(found if isinstance(found, str) else json.dumps({"success": True, "result": found}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())

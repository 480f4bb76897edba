"""The schema language: text to ``Schema`` and back."""

from __future__ import annotations

import re

from tessera.catalog import PRIMITIVES, EdgeType, Field, NodeType, Schema, TypeExpr
from tessera.errors import SchemaError

TOKEN = re.compile(r"\s+|//[^\n]*|(?P<quoted>`(?:``|[^`\n\r])+`)|(?P<number>[0-9]+)|(?P<mark>[{}<>:,@])|(?P<word>\w+)")
BARE = re.compile(r"[^\W\d]\w*\Z")


class Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or not m.end() > at:
                raise SchemaError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def have(self, text: str) -> bool:
        kind, found = self.peek()
        if found == text and kind != "quoted":
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.have(text):
            raise SchemaError(f"expected {text!r}, found {self.peek()[1] or 'the end'!r}")

    def name(self) -> tuple[str, bool]:
        """A name and whether it was quoted."""
        kind, text = self.take()
        if kind == "quoted":
            return text[1:-1].replace("``", "`"), True
        if kind == "word" and BARE.match(text):
            return text, False
        raise SchemaError(f"expected a name, found {text or 'the end'!r}")

    def listed(self, item) -> tuple:
        """< item, item, ... >, or nothing."""
        if not self.have("<"):
            return ()
        out = [item()]
        while self.have(","):
            out.append(item())
        self.need(">")
        return tuple(out)

    def type(self) -> TypeExpr:
        name, quoted = self.name()
        if quoted:
            return TypeExpr(name, user=True)
        if name in PRIMITIVES:
            return TypeExpr(name)
        if name in ("List", "Map", "Vector", "NodeRef", "EdgeRef") and self.peek()[1] == "<":
            self.need("<")
            if name == "Vector":
                kind, digits = self.take()
                if kind != "number":
                    raise SchemaError(f"expected a vector's size, found {digits!r}")
                out = TypeExpr(name, size=int(digits))
            elif name == "Map":
                key = self.type()
                self.need(",")
                out = TypeExpr(name, (key, self.type()))
            elif name == "List":
                out = TypeExpr(name, (self.type(),))
            else:
                out = TypeExpr(name, (TypeExpr(self.name()[0], user=True),))
            self.need(">")
            return out
        return TypeExpr(name, user=True)

    def fields(self) -> tuple[Field, ...]:
        self.need("{")
        out = []
        while not self.have("}"):
            name, _ = self.name()
            self.need(":")
            kind, marks = self.type(), set()
            while self.have("@"):
                mark, _ = self.name()
                if mark not in ("index", "unique"):
                    raise SchemaError(f"field '{name}': unknown annotation @{mark}")
                marks.add(mark)
            out.append(Field(name, kind, "index" in marks, "unique" in marks))
        return tuple(out)

    def node(self) -> NodeType:
        name, _ = self.name()
        params = self.listed(lambda: self.name()[0])
        extends = self.name()[0] if self.have("extends") else None
        return NodeType(name, self.fields(), params, extends)

    def edge(self) -> EdgeType:
        name, _ = self.name()
        params = self.listed(lambda: (self.name()[0], self.name()[0] if self.have(":") else None))
        self.need("{")
        ends = []
        for side in ("from", "to"):
            self.need(side)
            self.need(":")
            ends.append(self.type())
        fields: tuple[Field, ...] = ()
        if self.have("props"):
            self.need(":")
            fields = self.fields()
        self.need("}")
        return EdgeType(name, *ends, fields, params)


def parse(text: str) -> Schema:
    """Reads and checks a schema text."""
    reader = Reader(text)
    found: list[NodeType | EdgeType] = []
    while reader.peek()[0] != "end":
        if reader.have("node"):
            found.append(reader.node())
        elif reader.have("edge"):
            found.append(reader.edge())
        else:
            raise SchemaError(f"expected 'node' or 'edge', found {reader.peek()[1]!r}")
    return Schema.of(found).check()


def name_text(name: str, as_type: bool = False) -> str:
    plain = BARE.match(name) and not (as_type and name in (*PRIMITIVES, "List", "Map", "Vector", "NodeRef", "EdgeRef"))
    return name if plain else "`" + name.replace("`", "``") + "`"


def type_text(t: TypeExpr) -> str:
    if t.user:
        return name_text(t.name, as_type=True)
    inner = [str(t.size)] if t.size is not None else [name_text(a.name) if t.name.endswith("Ref") else type_text(a) for a in t.args]
    return t.name + (f"<{', '.join(inner)}>" if inner else "")


def fields_text(fields: tuple[Field, ...], pad: str) -> str:
    marks = lambda f: " @index" * f.indexed + " @unique" * f.unique
    return "".join(f"{pad}{name_text(f.name)}: {type_text(f.type)}{marks(f)}\n" for f in fields)


def unparse(schema: Schema) -> str:
    """Text that ``parse`` reads as the same schema."""
    out = []
    for n in schema.nodes.values():
        params = f"<{', '.join(map(name_text, n.params))}>" if n.params else ""
        extends = f" extends {name_text(n.extends)}" if n.extends else ""
        out.append(f"node {name_text(n.name)}{params}{extends} {{\n{fields_text(n.fields, '  ')}}}\n")
    for e in schema.edges.values():
        params = ", ".join(name_text(p) + (f": {name_text(b)}" if b is not None else "") for p, b in e.params)
        props = f"  props: {{\n{fields_text(e.fields, '    ')}  }}\n" if e.fields else ""
        head = f"edge {name_text(e.name)}" + (f"<{params}>" if params else "")
        out.append(f"{head} {{\n  from: {type_text(e.source)}\n  to: {type_text(e.target)}\n{props}}}\n")
    return "\n".join(out)

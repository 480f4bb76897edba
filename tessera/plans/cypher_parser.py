"""Reads the supported part of Cypher into plain data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from tessera.errors import InvalidCommand

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<float>(?:[0-9]+\.[0-9]+|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)
    |(?P<int>0x[0-9a-fA-F]+|[0-9]+)
    |(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<quoted>`(?:``|[^`])+`)
    |(?P<word>[^\W\d]\w*)
    |(?P<mark><>|<=|>=|=~|\+=|\.\.|[-+*/%^=<>(){}\[\].,:;|$])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass
class Expr:
    """kind: literal, variable, property, list, map, compare, contains-like, in, and/or/xor, not, arithmetic, negate, plus, is_null, is_not_null, case, call (distinct: of different values)."""

    kind: str
    value: Any = None
    parts: list[Expr] = field(default_factory=list)
    distinct: bool = False

    def text(self) -> str:
        if self.kind == "variable":
            return self.value
        if self.kind == "call":
            return f"{self.value}({'DISTINCT ' * self.distinct}{', '.join(p.text() for p in self.parts) or '*'})"
        return f"{self.parts[0].text()}.{self.value}" if self.kind == "property" else "value"

    def variables(self) -> set[str]:
        own = {self.value} if self.kind == "variable" else set()
        return own.union(*(p.variables() for p in self.parts))


@dataclass
class NodePattern:
    variable: str | None
    labels: list[str]
    properties: dict[str, Expr]


@dataclass
class EdgePattern:
    variable: str | None
    types: list[str]
    properties: dict[str, Expr]
    direction: str  # right, left, both


@dataclass
class Path:
    nodes: list[NodePattern]
    edges: list[EdgePattern]


@dataclass
class Return:
    items: list[tuple[Expr, str | None]]
    everything: bool
    distinct: bool
    order: list[tuple[Expr, bool]]
    skip: int
    limit: int | None


@dataclass
class Update:
    """kind: create (paths), merge (paths), set ([(target, key, value)]), remove ([(target, key)]), delete ([target])."""

    kind: str
    items: list


@dataclass
class Statement:
    match: list[Path] | None = None
    where: Expr | None = None
    optional: list[tuple[list[Path], Expr | None]] = field(default_factory=list)
    updates: list[Update] = field(default_factory=list)
    result: Return | None = None


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise InvalidCommand(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    # -- tokens --

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        """Takes these key words, if they come next."""
        for k, w in enumerate(words):
            kind, text = self.peek(k)
            if kind != "word" or text.upper() != w:
                return False
        self.at += len(words)
        return True

    def mark(self, text: str) -> bool:
        if self.peek() == ("mark", text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.mark(text):
            raise InvalidCommand(f"expected {text!r}, found {self.peek()[1] or 'the end'!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind not in ("word", "quoted"):
            raise InvalidCommand(f"expected a name, found {text or 'the end'!r}")
        self.at += 1
        return text[1:-1].replace("``", "`") if kind == "quoted" else text

    # -- statements --

    def statements(self) -> list[Statement]:
        out = []
        while self.peek()[0] != "end":
            if not self.mark(";"):
                out.append(self.statement())
                if self.peek()[0] != "end":
                    self.need(";")
        return out

    def statement(self) -> Statement:
        s = Statement()
        while self.peek()[0] != "end" and self.peek() != ("mark", ";"):
            if s.result is not None:
                raise InvalidCommand("UNION is not supported" if self.word("UNION") else "nothing may follow RETURN")
            if self.word("OPTIONAL", "MATCH"):
                if s.match is None or s.updates:
                    raise InvalidCommand("OPTIONAL MATCH needs a MATCH before it and no updates")
                paths = self.paths()
                s.optional.append((paths, self.expression() if self.word("WHERE") else None))
                continue
            if self.word("MATCH"):
                if s.match is not None:
                    raise InvalidCommand("a second MATCH is not supported")
                if s.updates:
                    raise InvalidCommand("MATCH must come before updates")
                s.match = self.paths()
                if self.word("WHERE"):
                    s.where = self.expression()
            elif self.word("CREATE"):
                s.updates.append(Update("create", self.paths()))
            elif self.word("MERGE"):
                s.updates.append(Update("merge", [self.path()]))
                if self.word("ON"):
                    raise InvalidCommand("ON CREATE and ON MATCH are not supported")
            elif self.word("SET"):
                s.updates.append(Update("set", self.listed(self.assignment)))
            elif self.word("REMOVE"):
                s.updates.append(Update("remove", self.listed(self.target)))
            elif self.word("DETACH", "DELETE") or self.word("DELETE"):
                s.updates.append(Update("delete", self.listed(self.name)))
            elif self.word("RETURN"):
                s.result = self.returned()
            else:
                text = self.peek()[1]
                raise InvalidCommand(f"{text.upper()} is not supported" if text.upper() in ("WITH", "UNWIND", "CALL", "FOREACH", "UNION", "FINISH", "LOAD") else f"unexpected {text!r}")
        return s

    def listed(self, item) -> list:
        out = [item()]
        while self.mark(","):
            out.append(item())
        return out

    def target(self) -> tuple[str, str]:
        variable = self.name()
        if self.peek() == ("mark", ":"):
            raise InvalidCommand("removing or setting labels is not supported")
        self.need(".")
        return variable, self.name()

    def assignment(self) -> tuple[str, str, Expr]:
        variable, key = self.target()
        self.need("=")
        return variable, key, self.expression()

    def returned(self) -> Return:
        distinct, items = self.word("DISTINCT"), []
        everything = self.mark("*")
        if not everything:
            items = self.listed(lambda: (self.expression(), self.name() if self.word("AS") else None))
        order: list[tuple[Expr, bool]] = []
        if self.word("ORDER", "BY"):
            order = self.listed(self.sort_item)
        skip = self.count() if self.word("SKIP") or self.word("OFFSET") else 0
        limit = self.count() if self.word("LIMIT") else None
        return Return(items, everything, distinct, order, skip, limit)

    def sort_item(self) -> tuple[Expr, bool]:
        e = self.expression()
        down = self.word("DESC") or self.word("DESCENDING")
        if not down:
            _ = self.word("ASC") or self.word("ASCENDING")
        return e, not down

    def count(self) -> int:
        e = self.expression()
        if e.kind != "literal" or isinstance(e.value, bool) or not isinstance(e.value, int) or e.value < 0:
            raise InvalidCommand("SKIP and LIMIT take a whole number")
        return e.value

    # -- patterns --

    def paths(self) -> list[Path]:
        return self.listed(self.path)

    def path(self) -> Path:
        if self.peek()[0] in ("word", "quoted") and self.peek(1) == ("mark", "="):
            raise InvalidCommand("named paths are not supported")
        nodes, edges = [self.node()], []
        while self.peek() in (("mark", "-"), ("mark", "<")):
            edges.append(self.edge())
            nodes.append(self.node())
        return Path(nodes, edges)

    def node(self) -> NodePattern:
        self.need("(")
        variable = self.name() if self.peek()[0] in ("word", "quoted") else None
        labels = []
        while self.mark(":"):
            labels.append(self.name())
        properties = self.pairs() if self.peek() == ("mark", "{") else {}
        if self.word("WHERE"):
            raise InvalidCommand("WHERE inside a pattern is not supported")
        self.need(")")
        if self.peek() in (("mark", "+"), ("mark", "*")):
            raise InvalidCommand("quantified patterns are not supported")
        return NodePattern(variable, labels, properties)

    def edge(self) -> EdgePattern:
        left = self.mark("<")
        self.need("-")
        variable, types, properties = None, [], {}
        if self.mark("["):
            variable = self.name() if self.peek()[0] in ("word", "quoted") else None
            if self.mark(":"):
                types.append(self.name())
                while self.mark("|"):
                    self.mark(":")
                    types.append(self.name())
            if self.peek() == ("mark", "*"):
                raise InvalidCommand("paths of variable length are not supported")
            properties = self.pairs() if self.peek() == ("mark", "{") else {}
            self.need("]")
        self.need("-")
        right = self.mark(">")
        if self.peek() in (("mark", "+"), ("mark", "*")):
            raise InvalidCommand("quantified patterns are not supported")
        return EdgePattern(variable, types, properties, "both" if left == right else "left" if left else "right")

    def pairs(self) -> dict[str, Expr]:
        self.need("{")
        out: dict[str, Expr] = {}
        while not self.mark("}"):
            if out:
                self.need(",")
            key = self.name()
            self.need(":")
            out[key] = self.expression()
        return out

    # -- expressions, by rising precedence --

    def expression(self) -> Expr:
        return self.joined("OR", lambda: self.joined("XOR", lambda: self.joined("AND", self.negated)))

    def joined(self, word: str, below) -> Expr:
        out = below()
        while self.word(word):
            out = Expr(word.lower(), None, [out, below()])
        return out

    def negated(self) -> Expr:
        return Expr("not", None, [self.negated()]) if self.word("NOT") else self.comparison()

    def comparison(self) -> Expr:
        out, operators, parts = self.sum(), [], []
        while True:
            kind, text = self.peek()
            if kind == "mark" and text in ("=", "<>", "<", ">", "<=", ">=", "=~"):
                self.at += 1
                operators.append(text)
            elif self.word("CONTAINS"):
                operators.append("contains")
            elif self.word("STARTS", "WITH"):
                operators.append("starts")
            elif self.word("ENDS", "WITH"):
                operators.append("ends")
            elif self.word("IS", "NOT", "NULL"):
                out = Expr("is_not_null", None, [self.compared(out, operators, parts)])
                operators, parts = [], []
                continue
            elif self.word("IS", "NULL"):
                out = Expr("is_null", None, [self.compared(out, operators, parts)])
                operators, parts = [], []
                continue
            elif self.word("IN"):
                out = Expr("in", None, [self.compared(out, operators, parts), self.sum()])
                operators, parts = [], []
                continue
            else:
                return self.compared(out, operators, parts)
            parts.append(self.sum())

    @staticmethod
    def compared(first: Expr, operators: list[str], rest: list[Expr]) -> Expr:
        return Expr("compare", list(operators), [first, *rest]) if operators else first

    def sum(self) -> Expr:
        out = self.product()
        while self.peek() in (("mark", "+"), ("mark", "-")):
            operator = self.peek()[1]
            self.at += 1
            out = Expr("arithmetic", operator, [out, self.product()])
        return out

    def product(self) -> Expr:
        out = self.signed()
        while self.peek()[0] == "mark" and self.peek()[1] in "*/%^":
            operator = self.peek()[1]
            if operator in "%^":
                raise InvalidCommand(f"operator {operator} is not supported")
            self.at += 1
            out = Expr("arithmetic", operator, [out, self.signed()])
        return out

    def signed(self) -> Expr:
        if self.mark("-"):
            e = self.signed()
            return Expr("literal", -e.value) if e.kind == "literal" and isinstance(e.value, (int, float)) and not isinstance(e.value, bool) else Expr("negate", None, [e])
        return Expr("plus", None, [self.signed()]) if self.mark("+") else self.postfixed()

    def postfixed(self) -> Expr:
        out = self.atom()
        while self.peek() in (("mark", "."), ("mark", "[")):
            if self.mark("["):
                raise InvalidCommand("indexing is not supported")
            self.need(".")
            out = Expr("property", self.name(), [out])
        return out

    def atom(self) -> Expr:
        kind, text = self.peek()
        if kind == "int":
            self.at += 1
            value = int(text, 0) if text.startswith("0x") else int(text)
            if value > 2**63:
                raise InvalidCommand(f"{text} is too large")
            return Expr("literal", value)
        if kind == "float":
            self.at += 1
            return Expr("literal", float(text))
        if kind == "text":
            self.at += 1
            unescape = lambda m: ESCAPES.get(m[1], chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) > 1 else m[1])
            return Expr("literal", re.sub(r"\\(u[0-9a-fA-F]{4}|.)", unescape, text[1:-1], flags=re.S))
        if self.mark("("):
            e = self.expression()
            self.need(")")
            return e
        if self.mark("["):
            items = [] if self.peek() == ("mark", "]") else self.listed(self.expression)
            self.need("]")
            return Expr("list", None, items)
        if (kind, text) == ("mark", "{"):
            pairs = self.pairs()
            return Expr("map", list(pairs), list(pairs.values()))
        if kind == "word" and text.upper() in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            return Expr("literal", {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()])
        if self.word("CASE"):
            return self.case()
        if kind == "mark" and text == "$":
            raise InvalidCommand("parameters are not supported")
        name = self.name()
        if self.mark("("):
            return self.call(name.lower())
        return Expr("variable", name)

    def case(self) -> Expr:
        """CASE, with or without a value to compare; parts: condition, value, ..., value of the rest."""
        subject = None if self.peek()[1].upper() == "WHEN" else self.expression()
        parts = []
        while self.word("WHEN"):
            test = self.expression()
            if not self.word("THEN"):
                raise InvalidCommand("expected THEN")
            parts += [test if subject is None else Expr("compare", ["="], [subject, test]), self.expression()]
        rest = self.expression() if self.word("ELSE") else Expr("literal", None)
        if not parts or not self.word("END"):
            raise InvalidCommand("expected WHEN or END")
        return Expr("case", None, [*parts, rest])

    def call(self, name: str) -> Expr:
        distinct = self.word("DISTINCT")
        if name == "count" and self.mark("*"):
            parts = []
        else:
            parts = self.listed(self.expression)
        self.need(")")
        return Expr("call", name, parts, distinct)


def parse(text: str) -> list[Statement]:
    return Parser(text).statements()

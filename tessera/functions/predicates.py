"""Filters of a traversal as two-valued Spark conditions.

A missing property (SQL null) makes every comparison false.  Leaves stay plain
comparisons, which Parquet scans can take over: a filter, And and Or treat null
as false anyway, and ``Not`` coalesces what it negates.  Values of kinds that do
not compare are unequal and unordered; that is decided while the plan is built.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidCommand
from tessera.functions.values import OTHER, TEXT, TIME, Property, kind_of_value, property_of
from tessera.graph import q


ORDERINGS: dict[str, Callable[[Column, Column], Column]] = {
    "GreaterThan": lambda a, b: a > b,
    "LessThan": lambda a, b: a < b,
    "GreaterThanOrEquals": lambda a, b: a >= b,
    "LessThanOrEquals": lambda a, b: a <= b,
}
TEXT_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "Contains": F.contains,
    "StartsWith": F.startswith,
    "EndsWith": F.endswith,
}
ALIASES = {"PropertyEquals": "Equals", "PropertyGreaterThan": "GreaterThan", "PropertyLessThan": "LessThan"}
UNBOUND = object()


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def literal(v: Any) -> Column:
    if isinstance(v, list):
        return F.array(*[literal(x) for x in v])
    return F.lit(v)


def bound(value: Any, bindings: dict[str, Any]) -> Any:
    """A literal, or what {"$bind": name} stands for; UNBOUND where it stands for nothing."""
    if isinstance(value, dict) and set(value) == {"$bind"}:
        return bindings.get(value["$bind"], UNBOUND)
    return value


def valid_pattern(frame: DataFrame, pattern: str) -> bool:
    jvm = frame.sparkSession._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except (IllegalArgumentException, Py4JJavaError):  # the JVM's syntax error, which is an illegal argument
        return False


@F.pandas_udf(T.BooleanType())
def _found(text: pd.Series, pattern: pd.Series) -> pd.Series:
    known: dict[str, re.Pattern | None] = {}

    def test(t: str | None, p: str | None) -> bool | None:
        if t is None or p is None:
            return None
        if p not in known:
            try:
                known[p] = re.compile(p)
            except re.error:
                known[p] = None
        return known[p] is not None and known[p].search(t) is not None

    return pd.Series([test(t, p) for t, p in zip(text, pattern, strict=True)], dtype=object)


def matches(text: Column, pattern: Column, whole: bool = False) -> Column:
    """A pattern that is a value of the row, where a bad one is false.

    The JVM's functions end the job at a bad pattern, so this one goes through Arrow batches, and its
    patterns are Python's.  Patterns that the command names stay in the JVM.
    """
    return _found(text, F.concat(F.lit("^(?:"), pattern, F.lit(r")\Z")) if whole else pattern)


class Predicates:
    """Conditions over the rows of one frame."""

    def __init__(self, frame: DataFrame, is_json: Callable[[str], bool], bindings: dict[str, Any] | None = None):
        self.frame, self.is_json, self.bindings = frame, is_json, bindings or {}

    def property(self, path) -> Property | None:
        return property_of(self.frame, path, self.is_json)

    def leaf(self, spec: dict) -> Column:
        operator = ALIASES.get(spec["operator"], spec["operator"])
        actual = self.property(spec["property"])
        if operator == "Exists":
            return F.lit(False) if actual is None else actual.present()
        if operator == "IsNull":
            return F.lit(True) if actual is None else ~actual.present()
        if operator not in {"Equals", "NotEquals", "Matches", *ORDERINGS, *TEXT_TESTS}:
            raise InvalidCommand(f"unknown operator '{spec['operator']}'")
        value = spec.get("value")
        if spec["operator"] in ALIASES and not isinstance(value, dict):
            value = {"type": "property", "key": value}
        if actual is None:
            return F.lit(False)
        if isinstance(value, dict) and value.get("type") == "property":
            other = self.property(value["key"])
            return F.lit(False) if other is None else self.of_two(operator, actual, other)
        value = bound(value, self.bindings)
        if value is UNBOUND or value is None:
            return F.lit(False)
        return self.of_value(operator, actual, value)

    def of_value(self, operator: str, actual: Property, value: Any) -> Column:
        kind = kind_of_value(value)
        right = literal(value)
        if actual.kind == TIME and kind == TEXT:
            left, right, kind = actual.column, F.try_to_timestamp(F.lit(value)), TIME
        elif actual.kind == OTHER and kind == OTHER and isinstance(value, (list, dict)):
            return self.deep(operator, actual, value)
        else:
            left = actual.as_kind(kind)
        if left is None:  # another kind: only unequal
            return actual.present() if operator == "NotEquals" else F.lit(False)
        if operator == "NotEquals":
            return left != right if actual.type is not None else actual.present() & F.coalesce(left != right, F.lit(True))
        if operator == "Equals":
            return left == right
        if operator in ORDERINGS:
            return F.lit(False) if kind == "bool" else ORDERINGS[operator](left, right)
        if kind != TEXT:
            return F.lit(False)
        if operator == "Matches":
            return left.rlike(value) if valid_pattern(self.frame, value) else F.lit(False)
        return TEXT_TESTS[operator](left, right)

    def deep(self, operator: str, actual: Property, value: Any) -> Column:
        import json

        if operator not in ("Equals", "NotEquals") or actual.type is None:
            return F.lit(False)
        same = F.to_json(actual.column) == F.to_json(F.from_json(F.lit(json.dumps(value)), actual.type))
        return same if operator == "Equals" else actual.present() & F.coalesce(~same, F.lit(True))

    def of_two(self, operator: str, a: Property, b: Property) -> Column:
        kinds = [k for k in (a.kind, b.kind) if k is not None] or [TEXT]
        kind = kinds[0]
        left, right = a.as_kind(kind), b.as_kind(kind)
        if left is None or right is None or (kind == OTHER and a.type != b.type):
            return a.present() & b.present() if operator == "NotEquals" else F.lit(False)
        if operator == "Equals":
            return left == right
        if operator == "NotEquals":
            return a.present() & b.present() & F.coalesce(left != right, F.lit(True))
        if operator in ORDERINGS:
            return F.lit(False) if kind in ("bool", OTHER) else ORDERINGS[operator](left, right)
        if kind != TEXT:
            return F.lit(False)
        return matches(left, right) if operator == "Matches" else TEXT_TESTS[operator](left, right)

    def compound(self, spec: dict) -> Column:
        operator = spec["operator"]
        if operator == "Not":
            return ~false_if_null(self.any(spec["filter"]))
        if operator not in ("And", "Or"):
            raise InvalidCommand(f"unknown compound operator '{operator}'")
        parts = [self.any(s) for s in spec["filters"]]
        start = F.lit(operator == "And")
        return functools.reduce(lambda x, y: x & y if operator == "And" else x | y, parts, start) if parts else start

    def any(self, spec: dict) -> Column:
        return self.compound(spec) if spec["operator"] in ("And", "Or", "Not") else self.leaf(spec)

    def any_key_contains(self, needle: str, columns: list[str]) -> Column:
        """Case-insensitive: some text value of the row, at any depth, holds the needle (keys do not count)."""
        needle = needle.lower()
        tests = []
        for name in columns:
            kind = self.frame.schema[name].dataType
            if isinstance(kind, T.VariantType):
                tests.append(in_json(F.to_json(q(name)), needle))
            elif isinstance(kind, T.StringType):
                tests.append(in_json(q(name), needle) if self.is_json(name) else F.contains(F.lower(q(name)), F.lit(needle)))
            else:
                deep = in_value(q(name), kind, needle)
                if deep is not None:
                    tests.append(deep)
        return functools.reduce(lambda x, y: x | y, [false_if_null(t) for t in tests], F.lit(False))


#: A key of a JSON object, or (group 1) another string.
JSON_TEXT = r'"(?:[^"\\]|\\.)*+"\s*:|"((?:[^"\\]|\\.)*+)"'


def in_json(text: Column, needle: str) -> Column:
    values = F.regexp_extract_all(text, F.lit(JSON_TEXT), F.lit(1))
    whole = F.from_json(F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ","), F.lit("]")), "array<string>")
    return F.exists(whole, lambda v: F.contains(F.lower(v), F.lit(needle)))


def in_value(value: Column, kind: T.DataType, needle: str) -> Column | None:
    if isinstance(kind, T.StringType):
        return F.contains(F.lower(value), F.lit(needle))
    if isinstance(kind, T.ArrayType):
        return None if in_value(F.lit(None), kind.elementType, needle) is None else F.exists(value, lambda x: in_value(x, kind.elementType, needle))
    if isinstance(kind, T.MapType):
        return in_value(F.map_values(value), T.ArrayType(kind.valueType), needle)
    if isinstance(kind, T.StructType):
        parts = [in_value(value.getField(f.name), f.dataType, needle) for f in kind]
        parts = [false_if_null(p) for p in parts if p is not None]
        return functools.reduce(lambda x, y: x | y, parts) if parts else None
    return None

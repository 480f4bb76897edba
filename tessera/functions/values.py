"""Property access: a name or path of a property to a Spark column, with its kind."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.graph import q

NUMBER, TEXT, BOOL, TIME, OTHER = "number", "text", "bool", "time", "other"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    return OTHER


def kind_of_value(v: Any) -> str:
    if isinstance(v, bool):
        return BOOL
    if isinstance(v, (int, float)):
        return NUMBER
    return TEXT if isinstance(v, str) else OTHER


JSON_TYPES = {NUMBER: "double", TEXT: "string", BOOL: "boolean"}


def json_path(keys: list[str]) -> str:
    plain = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
    return "$" + "".join(f".{k}" if plain.match(k) else "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)


@dataclass
class Property:
    """A property of a row: a column of a kind, or (kind None) a JSON value that is read as the kind asked for."""

    column: Column
    type: T.DataType | None
    path: str = "$"

    @property
    def kind(self) -> str | None:
        return None if self.type is None else kind_of(self.type)

    def as_kind(self, kind: str) -> Column | None:
        """The value as a kind; null where it has another one, None where no row can have it."""
        if self.type is None:
            if kind not in JSON_TYPES:
                return None
            value = F.try_variant_get(self.column, self.path, "variant")
            typed = F.try_variant_get(self.column, self.path, JSON_TYPES[kind])
            # a JSON string is no number, and a number no string
            marks = {NUMBER: ["BIGINT", "DOUBLE", "DECIMAL", "INT", "SMALLINT", "TINYINT", "FLOAT"], TEXT: ["STRING"], BOOL: ["BOOLEAN"]}[kind]
            return F.when(F.split(F.schema_of_variant(value), "\\(")[0].isin(*marks), typed)
        return self.column if self.kind == kind else None

    def present(self) -> Column:
        if self.type is None:
            value = F.try_variant_get(self.column, self.path, "variant")
            return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
        return self.column.isNotNull()

    def text(self) -> Column:
        """What a group key or a result shows."""
        if self.type is None:
            return F.try_variant_get(self.column, self.path, "string")
        return self.column.cast("string") if self.kind != OTHER else F.to_json(self.column)

    def plain(self) -> Column:
        """The value as it is shown in a result; JSON as text."""
        return self.text() if self.type is None else self.column

    def number(self) -> Column:
        """A double, null for anything else."""
        found = self.as_kind(NUMBER)
        return F.lit(None).cast("double") if found is None else found.cast("double")


def property_of(frame: DataFrame, path: str | dict | list, is_json) -> Property | None:
    """The property at a flat name or {"path": [...]}; None where no row has it.  ``is_json(name)`` tells JSON fields."""
    keys = list(path["path"]) if isinstance(path, dict) else [path] if isinstance(path, str) else list(path)
    if not keys or keys[0] not in frame.columns:
        return None
    kind = frame.schema[keys[0]].dataType
    column = q(keys[0])
    if isinstance(kind, T.VariantType):
        return Property(column, None, json_path(keys[1:]))
    if isinstance(kind, T.StringType) and is_json(keys[0]):
        return Property(F.try_parse_json(column), None, json_path(keys[1:]))
    for k in keys[1:]:
        if isinstance(kind, T.StructType) and k in kind.names:
            kind, column = kind[k].dataType, column.getField(k)
        elif isinstance(kind, T.MapType):
            kind, column = kind.valueType, F.try_element_at(column, F.lit(k))
        else:
            return None
    return Property(column, kind)

"""Strict conversions between scalar field types: the whole value or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import SchemaError

#: Two to the 63rd, the first double above every long.
TOP = float(2**63)


def convertible(old: str, new: str) -> bool:
    """Text to and from any scalar, and whole numbers to and from others."""
    scalars = {"String", "Int", "Float", "Boolean", "DateTime"}
    if not {old, new} <= scalars:
        return False
    return old == new or "String" in (old, new) or {old, new} == {"Int", "Float"}


def convert(c: Column, old: str, new: str) -> Column:
    """Null where the value has no exact counterpart."""
    if not convertible(old, new):
        raise SchemaError(f"a field can't change from {old} to {new}")
    if old == new:
        return c
    if new == "String":
        if old == "DateTime":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return c.cast("string")
    if (old, new) == ("Int", "Float"):
        exact = c.cast("double")
        return F.when((exact < TOP) & (exact.cast("decimal(38,0)") == c.cast("decimal(38,0)")), exact)
    if (old, new) == ("Float", "Int"):
        whole = (F.floor(c).cast("double") == c) & (c >= -TOP) & (c < TOP)
        return F.when(whole, c.try_cast("long"))
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    if new == "Int":
        return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))
    if new == "Float":
        number = F.when(c.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), c.try_cast("double"))
        return F.when(F.abs(number) < float("inf"), number)
    if new == "Boolean":
        return F.when(c == "true", True).when(c == "false", False)
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}"), F.try_to_timestamp(c))

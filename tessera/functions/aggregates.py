"""The five aggregates of collectors, as partial and final Spark aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidCommand
from tessera.functions.values import NUMBER, TEXT, Property


def path_text(path) -> str:
    return path if isinstance(path, str) else ".".join(path["path"])


def name_of(spec: dict) -> str:
    if spec.get("alias"):
        return spec["alias"]
    if spec.get("property") is None:
        return "count" if spec["func"] == "Count" else spec["func"].lower()
    return f"{spec['func'].lower()}_{path_text(spec['property'])}"


def finite(c: Column) -> Column:
    """Null in place of a value that is no finite number."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def aggregate(spec: dict, find: Callable[[object], Property | None]) -> Column:
    """One aggregate, named.  Count counts rows; Sum is 0.0 and Avg null without numbers."""
    func, path = spec["func"], spec.get("property")
    if func == "Count":
        return F.count(F.lit(1)).alias(name_of(spec))
    if func not in ("Sum", "Avg", "Min", "Max"):
        raise InvalidCommand(f"unknown aggregate '{func}'")
    if path is None:
        raise InvalidCommand(f"{func} needs a property")
    found = find(path)
    number = F.lit(None).cast("double") if found is None else found.number()
    if func == "Sum":
        out = finite(F.coalesce(F.sum(number), F.lit(0.0)))
    elif func == "Avg":
        out = finite(F.avg(number))
    else:
        pick = F.min if func == "Min" else F.max
        if found is None:
            out = pick(F.lit(None).cast("string"))
        elif found.type is None:  # JSON: numbers if there are any, else texts
            number, text = (found.as_kind(k) for k in (NUMBER, TEXT))
            out = F.coalesce(pick(number).cast("string"), pick(text))
        else:
            out = pick(found.column)
    return out.alias(name_of(spec))

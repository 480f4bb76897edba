"""Spans of pattern matches in SQL functions alone (no Python on the executors).

A span is a struct (kind, start, end, value); start and end count code points,
end exclusive.  Positions come from the pieces between matches: one split and one
extraction, both by the same left-to-right search, and a running sum of their
lengths.  Running sums, maxima and minima are taken by doubling steps, so n spans
cost n log n, never n * n; texts are cut by way of blocks of ``BLOCK`` characters,
never from their start for each span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string>"
PLACE = "struct<kind:string,start:int,end:int>"
BLOCK = 1024


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(array: str, fold: Callable[[str, str], str]) -> str:
    """The running fold of an array of numbers by an associative operation."""
    earlier = "held[at - shiftleft(1, step)]"
    return f"""aggregate(sequence(0, 30), {array}, (held, step) ->
      if(shiftleft(1, step) >= size(held), held, transform(held, (own, at) -> if(at >= shiftleft(1, step), {fold(earlier, "own")}, own))))"""


def sums(array: str) -> str:
    return running(array, lambda a, b: f"{a} + {b}")


def maxima(array: str) -> str:
    return running(array, lambda a, b: f"greatest({a}, {b})")


def minima_ahead(array: str) -> str:
    """The least of each element and those after it."""
    return f"reverse({running(f'reverse({array})', lambda a, b: f'least({a}, {b})')})"


def located(kind: str, pattern: str, text: str = "text", guard: str | None = None) -> Column:
    """All leftmost non-overlapping matches of a Java pattern; ``guard`` is a substring that every match has."""
    p = quoted(pattern)
    ends = sums("zip_with(slice(gaps, 1, size(found)), found, (gap, value) -> char_length(gap) + char_length(value))")
    spans = f"zip_with(found, {ends}, (value, last) -> named_struct('kind', {quoted(kind)}, 'start', last - char_length(value), 'end', last, 'value', value))"
    spans = let("found", f"regexp_extract_all({text}, {p}, 0)", let("gaps", f"split({text}, {p}, -1)", spans))
    test = f"{text} rlike {p}"
    if guard:
        test = f"contains({text}, {quoted(guard)}) and {test}"
    return F.expr(f"if({test}, {spans}, cast(array() as array<{SPAN}>))")


def ordered(spans: Column, kinds: list[str]) -> Column:
    """By start, then kind as listed."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def touching(spans: str, others: str) -> str:
    """For each span, in order of start: (span, touched), touched if it overlaps one of the others."""
    merged = f"""array_sort(concat(
      transform({others}, x -> named_struct('start', x.start, 'own', 0, 'end', x.end, 'place', -1)),
      transform({spans}, (x, i) -> named_struct('start', x.start, 'own', 1, 'end', x.end, 'place', i))))"""
    # of the others that start no later the furthest end, and the next start of one that starts later
    reach = maxima("transform(merged, x -> if(x.own = 0, x.end, 0))")
    ahead = minima_ahead("transform(merged, x -> if(x.own = 0, x.start, 2147483647))")
    marked = f"transform(filter(transform(merged, (x, i) -> named_struct('x', x, 'touched', reach[i] > x.start or ahead[i] < x.end)), y -> y.x.own = 1), y -> named_struct('span', {spans}[y.x.place], 'touched', y.touched))"
    return let("merged", merged, let("reach", reach, let("ahead", ahead, marked)))


def apart(spans: str, others: str) -> str:
    """The spans that overlap none of the others, in order of start."""
    return f"if(size({spans}) = 0 or size({others}) = 0, {spans}, transform(filter({touching(spans, others)}, x -> not x.touched), x -> x.span))"


def blocks(text: str) -> str:
    """A text in pieces of BLOCK characters, for ``cut``."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def cut(pieces: str, start: str, end: str) -> str:
    """The characters from start to end (exclusive, both within the text) of a text in blocks."""
    first, last = f"cast({start} div {BLOCK} as int)", f"cast(({end} - 1) div {BLOCK} as int)"
    low = f"greatest({start} - k * {BLOCK}, 0)"
    piece = f"substring({pieces}[k], {low} + 1, least({end} - k * {BLOCK}, {BLOCK}) - {low})"
    return f"if({end} <= {start}, '', array_join(transform(sequence({first}, {last}), k -> {piece}), ''))"


def masked(text: str, spans: str, mask: str = "[secret]") -> Column:
    """The text with each span's characters replaced by ``mask``; overlapping spans are merged.  ``spans`` by start."""
    # stretches between masks; a span that starts inside an earlier one adds no mask
    free = f"filter(transform({spans}, (x, i) -> named_struct('from', if(i = 0, 0, far[i - 1]), 'to', x.start)), x -> x.to >= x.from)"
    body = f"concat(array_join(transform({free}, x -> concat({cut('pieces', 'x.from', 'x.to')}, {quoted(mask)})), ''), {cut('pieces', 'far[size(far) - 1]', f'char_length({text})')})"
    whole = let("pieces", blocks(text), let("far", maxima(f"transform({spans}, x -> x.end)"), body))
    return F.expr(f"if(size({spans}) = 0, {text}, {whole})")


def replaced(docs: DataFrame, spans_of: Callable[[DataFrame], DataFrame], mask: str, text_col: str, length_col: str | None) -> DataFrame:
    """``docs`` with the spans _all, which ``spans_of`` adds to rows with ``text``, masked in its texts; its columns as they were.

    ``length_col``, if there is one, becomes the new length where the text changed; a null text stays null.
    """
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    rows = spans_of(plain.withColumn("text", F.coalesce(F.col(f"c{at}").cast("string"), F.lit(""))))
    changed = F.size("_all") > 0
    rows = rows.withColumn("_masked", masked("text", "_all", mask))
    out = []
    for k, name in enumerate(names):
        value = F.col(f"c{k}")
        if k == at:
            value = F.when(changed, F.col("_masked")).otherwise(value)
        elif name == length_col:
            value = F.when(changed, F.length("_masked").cast(docs.schema[k].dataType)).otherwise(value)
        out.append(value.alias(name))
    return rows.select(*out)

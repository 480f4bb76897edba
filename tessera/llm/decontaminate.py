"""Benchmark decontamination by pigeonhole edit matching.

Method.  A benchmark item of n words may differ from a passage by at most
k = floor(rate * n) word edits.  It is split into k + 1 pieces; any passage
within k edits has at least one piece unchanged.  Pieces are found by rolling
hashes over word numbers (a hash coincidence only adds a candidate), and each
candidate window is verified with Myers' bit-parallel edit distance over words,
run side by side for many candidates (64-bit, items up to 64 words) or on
Python integers (longer items).  No match within the budget is lost.

Words are lower-cased runs of letters, digits and non-ASCII characters.  The
benchmark is sent to the tasks in blocks of bounded size; with more blocks the
texts pass through once a block, never through a join, and are settled between
blocks, so that a task and the driver hold one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, discard, materialize, picked
from tessera.llm.licenses import TABLE

#: Allowed word edits as a share of an item's words; items under MIN_WORDS must match exactly.
EDIT_RATE, MIN_WORDS = 0.2, 8
#: Words of benchmark items in one block at most (about 100 bytes each in a task).
BLOCK_WORDS = 500_000
#: Candidates that are verified at a time.
CANDIDATES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()


def budget(n: int, rate: float = EDIT_RATE) -> int:
    return int(n * rate) if n >= MIN_WORDS else 0


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + ids[k : len(ids) - n + 1 + k]
    return h


def distance_of(pattern: list, window: list) -> int:
    """Least edit distance of the pattern to any part of the window, by Myers' method on integers."""
    m = len(pattern)
    masks: dict = {}
    for j, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << j
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, m
    for w in window:
        eq = masks.get(w, 0)
        cross = (((eq & up) + up) ^ up) | eq
        right_up, right_down = down | (full & ~(cross | up)), up & cross
        score += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = right_up << 1 & full, right_down << 1 & full
        across = eq | down
        up, down = right_down | (full & ~(across | right_up)), right_up & across
        best = min(best, score)
    return best


def distances(patterns: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The same for many candidates at once; patterns (c, up to 64) padded with -1, windows (c, w) padded with -2."""
    weights = ONE << np.arange(patterns.shape[1], dtype=np.uint64)
    top = ONE << (sizes - 1).astype(np.uint64)
    full = top | (top - ONE)
    up, down = full.copy(), np.zeros_like(full)
    score = sizes.astype(np.int64).copy()
    best = score.copy()
    for t in range(windows.shape[1]):
        w = windows[:, t]
        eq = np.where(patterns == w[:, None], weights, np.uint64(0)).sum(1, dtype=np.uint64)
        cross = (((eq & up) + up) ^ up) | eq
        right_up, right_down = down | (full & ~(cross | up)), up & cross
        score += ((right_up & top) != 0).astype(np.int64) - ((right_down & top) != 0)
        right_up, right_down = right_up << ONE & full, right_down << ONE & full
        across = eq | down
        up, down = right_down | (full & ~(across | right_up)), right_up & across
        best = np.where(w == -2, best, np.minimum(best, score))
    return best


class Matcher:
    """Pieces of a block of items: [(item id, words)]."""

    def __init__(self, items: list[tuple[int, list[bytes]]], rate: float = EDIT_RATE):
        items = [(i, w) for i, w in items if w]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        self.ids = [i for i, _ in items]
        self.words = [[number.setdefault(w, len(number) + 1) for w in words] for _, words in items]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.budgets = np.array([budget(len(w), rate) for w in self.words], np.int64)
        self.padded = np.full((len(items), 64), -1, np.int64)
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, words in enumerate(self.words):
            if len(words) <= 64:
                self.padded[k, : len(words)] = words
            cuts = np.linspace(0, len(words), int(self.budgets[k]) + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    h = int(rolled(np.array(words[a:b], np.uint64), b - a)[0])
                    pieces.setdefault(int(b - a), {}).setdefault(h, []).append((k, int(a)))
        self.tables = []
        for n, table in sorted(pieces.items()):
            hashes = np.array(sorted(table), np.uint64)
            counts = np.array([len(table[int(h)]) for h in hashes])
            flat = np.array([p for h in hashes for p in table[int(h)]], np.int64).reshape(-1, 2)
            coarse = np.zeros(1 << 16, bool)
            coarse[(hashes >> np.uint64(48)).astype(int)] = True
            self.tables.append((n, hashes, np.concatenate(([0], np.cumsum(counts))), flat, coarse))

    def match(self, texts: list[list[bytes]]) -> list[tuple[int, int, int]]:
        """(text, item, distance) of every item within its budget of some passage of a text; least distance each."""
        get = self.vocabulary.get
        sizes = np.array([len(t) for t in texts], np.int64)
        # one separator between texts; 0 is any word that no item has
        ids = np.fromiter((n for t in texts for n in ([get(w, 0) for w in t] + [0])), np.int64, int(sizes.sum()) + len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        plain = ids.view(np.uint64)
        best: dict[tuple[int, int], int] = {}
        for n, hashes, offsets, flat, coarse in self.tables:
            h = rolled(plain, n)
            at = np.nonzero(coarse[(h >> np.uint64(48)).astype(np.int64)])[0]
            row = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            hit = hashes[row] == h[at]
            at, row = at[hit], row[hit]
            # a piece may stand in many items and at many places: its candidates come in bounded parts
            ends = np.cumsum(offsets[row + 1] - offsets[row])
            for first in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
                number = np.arange(first, min(first + CANDIDATES, int(ends[-1])))
                hit = np.searchsorted(ends, number, side="right")
                pick = offsets[row[hit]] + number - (ends[hit] - (offsets[row[hit] + 1] - offsets[row[hit]]))
                item, offset = flat[pick].T
                text = np.searchsorted(begins, at[hit], side="right") - 1
                self.verify(np.unique(np.stack([item, at[hit] - offset, text], 1), axis=0), ids, begins, best)
        return [(t, self.ids[i], d) for (t, i), d in sorted(best.items())]

    def verify(self, cases: np.ndarray, ids: np.ndarray, begins: np.ndarray, best: dict[tuple[int, int], int]) -> None:
        """Takes the least distance of each (text, item) within the item's budget from cases (item, start, text) to ``best``."""
        for part in range(0, len(cases), 4096):
            item, start, text = cases[part : part + 4096].T
            k, n = self.budgets[item], self.sizes[item]
            low = np.maximum(start - k, begins[text])
            high = np.minimum(start + n + k, begins[text + 1] - 1)
            short = n <= 64
            got = np.zeros(len(item), np.int64)
            if short.any():
                s = np.nonzero(short)[0]
                width = int((high - low)[s].max())
                grid = low[s][:, None] + np.arange(width)
                window = np.where(grid < high[s][:, None], ids[np.minimum(grid, len(ids) - 1)], -2)
                got[s] = distances(self.padded[item[s]], n[s], window)
            for c in np.nonzero(~short)[0]:
                got[c] = distance_of(self.words[item[c]], ids[low[c] : high[c]].tolist())
            for c in np.nonzero(got <= k)[0]:
                key = (int(text[c]), int(item[c]))
                best[key] = min(best.get(key, 1 << 30), int(got[c]))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int):
    """Blocks of (item id, words), each of ``size`` words at most unless one item has more."""
    block, held = [], 0
    for item, text in picked(benchmark, id_col, text_col).toLocalIterator():
        words = words_of(text)
        if block and held + len(words) > size:
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words)
    if block:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = EDIT_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, contaminated, n_items, item_ids (ascending, comma-joined), least_distance (null without items).

    Null and empty texts are clean; items without words match nothing; repeated
    rows, items and null ids stay as they are (a null item id is shown as -1).
    Empty tables give an empty or an all-clean result.
    """
    return matched(picked(docs, id_col, text_col), "text", benchmark, rate, item_id_col, item_text_col, block_words).select(
        "doc_id",
        (F.size("_hits") > 0).alias("contaminated"),
        F.size("_hits").cast("long").alias("n_items"),
        F.concat_ws(",", F.transform(F.array_sort(F.transform("_hits", lambda h: h["item"])), lambda x: x.cast("string"))).alias("item_ids"),
        F.array_min(F.transform("_hits", lambda h: h["distance"])).alias("least_distance"),
    )


def matched(rows: DataFrame, text_name: str, benchmark: DataFrame, rate, item_id_col, item_text_col, block_words) -> DataFrame:
    """``rows`` with a column _hits of (item, distance); all other columns as they were."""
    spark = rows.sparkSession
    bound_batches(spark)
    hit = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int64())]))
    out = rows.withColumn("_hits", F.expr("cast(array() as array<struct<item:bigint,distance:bigint>>)"))
    schema = out.schema
    at = out.columns.index(text_name)
    held, settled = None, None
    for block in blocks(benchmark, item_id_col, item_text_col, block_words):
        if held is not None:
            before, settled = settled, materialize(out, "hits")
            out = settled
            held.destroy()
            if before is not None:
                discard(before)
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            matcher = Matcher(held.value, rate)
            for batch in batches:
                hits = batch.column(batch.num_columns - 1).to_pylist()
                texts = [words_of(t or "") for t in batch.column(at).to_pylist()]
                for text, item, distance in matcher.match(texts) if texts else ():
                    hits[text].append({"item": -1 if item is None else item, "distance": distance})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, hit)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; its columns as they were (whatever their names).

    Rows with a null or empty text stay, repeated rows and null ids stay or go like any; an empty benchmark or table takes nothing.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index(text_col)}"
    found = matched(plain, text, benchmark, rate, item_id_col, item_text_col, BLOCK_WORDS)
    return found.where(F.size("_hits") == 0).drop("_hits").toDF(*names)

"""SimHash near-duplicates, linked exactly by vantage-point trees.

Method.  Every text gets a 64-bit SimHash over its 3-word shingles.  Only
*distinct* fingerprints are compared, so copies never meet as pairs.  Two
fingerprints within ``radius`` bits agree in one of radius + 1 blocks of bits,
so one vantage-point tree is kept for each block: a node splits the fingerprints
by the Hamming distance of their block to a vantage point, and leaves are
shards.  As the block is equal, a pair that a tree must find never crosses its
boundaries, so every fingerprint has one shard a tree.  Where a block no longer
splits (many fingerprints share it), the node goes on with all bits and the full
radius: a fingerprint then also visits, as a guest, the shards whose boundary
its ball overlaps by the triangle bound.  A shard compares its home fingerprints
with each other and with its guests (full distance), by a vantage-point tree of
its own that prunes by the same bounds, and emits only a spanning star for each
local component.  Components are then found by contraction on DataFrames.

Scale.  Nothing grows on the driver: the trees are fitted on at most ``sample``
fingerprints.  Shuffled are radius + 1 rows of 17 bytes a distinct fingerprint and
the edges, never texts.  Shards hold about ``shard_rows`` fingerprints as long as
a block has values to tell them apart (65,536 for radius 3), more beyond; inside a
shard the work for a fingerprint is what the tree's bounds leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, first_row, identified, map_texts, materialize, spread_join, without_copies

#: Fingerprints that the shard tree is fitted on, at most.
TREE_SAMPLE = 1 << 15
#: Distinct fingerprints that a shard should be home to.
SHARD_ROWS = 1024
SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles, repeats counted; 0 without words."""
    return of_words(text.encode("utf-8", "surrogatepass").lower().split(), words)


def of_words(w: list[bytes], words: int = 3) -> int:
    """The fingerprint of a text that is split already."""
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    join = b" ".join
    grams = [h(join(g), SEED) for g in zip(*(w[i:] for i in range(words)))] if len(w) >= words else [h(join(w), SEED)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        part = np.array(grams[at : at + (1 << 16)], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """The columns of every row but ``text``, and fp, the fingerprint as a signed long."""

    def make():
        def work(texts):
            return [(int(np.uint64(fingerprint(t, words)).astype(np.int64)),) for t in texts]

        return work

    return map_texts(docs, make, "fp long")


# -- the shard tree ---------------------------------------------------------

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def masks(blocks: int) -> list[np.uint64]:
    """The bits of each of some blocks of a fingerprint, as even as can be."""
    return [np.uint64(sum(1 << b for b in range(64) if b * blocks // 64 == k)) for k in range(blocks)]


def grow(sample: np.ndarray, mask: np.uint64, radius: int, full_radius: int, depth: int, rng, enough: int = 1) -> dict | None:
    """A node of the tree, or None for a leaf (``depth`` levels down, or at ``enough`` of the sample).  ``radius`` holds for distances under ``mask``."""
    if depth == 0 or len(sample) <= enough:
        return None
    best = None
    for point in sample[rng.integers(0, len(sample), 5)]:
        d = np.bitwise_count((sample ^ point) & mask).astype(int)
        for mu in {int(np.median(d)), int(np.median(d)) - 1}:
            left = int((d <= mu).sum())
            if 0 < left < len(sample):
                touched = int((d <= mu + radius).sum() + (d > mu - radius).sum())
                cost = touched + abs(2 * left - len(sample))
                if best is None or cost < best[0]:
                    best = (cost, point, mu, d)
    if best is None:
        if mask == FULL:
            return None
        return grow(sample, FULL, full_radius, full_radius, depth, rng, enough)
    _, point, mu, d = best
    return {
        "point": point,
        "mask": mask,
        "mu": mu,
        "radius": radius,
        "left": grow(sample[d <= mu], mask, radius, full_radius, depth - 1, rng, enough),
        "right": grow(sample[d > mu], mask, radius, full_radius, depth - 1, rng, enough),
    }


def route(node: dict | None, fps: np.ndarray, rows: np.ndarray, home: np.ndarray, shard: int, out: list) -> None:
    """Appends (rows, home, shard) of each leaf that the rows belong to or whose region their balls touch.

    A guest comes only from the near side of a boundary: of a pair that a
    boundary parts, the left one visits the right, which is enough to meet.
    """
    if not len(rows):
        return
    if node is None:
        out.append((rows, home, shard))
        return
    d = np.bitwise_count((fps[rows] ^ node["point"]) & node["mask"]).astype(int)
    mu, r = node["mu"], node["radius"]
    left = np.where(home, d <= mu, d <= mu + r)
    right = np.where(home, d > mu - r, d > mu - r)
    route(node["left"], fps, rows[left], home[left], 2 * shard, out)
    route(node["right"], fps, rows[right], home[right] & (d[right] > mu), 2 * shard + 1, out)


def routed(fps: DataFrame, trees: list[dict | None]) -> DataFrame:
    """(shard, fp, home): one home row for each tree and fingerprint, and its guest rows."""

    def run(batches):
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for tree, root in enumerate(trees):
                out: list = []
                # the path of a leaf, with a leading 1 bit, and the tree
                route(root, values, np.arange(len(values)), np.ones(len(values), bool), 1, out)
                for rows, home, shard in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), shard * len(trees) + tree, np.int64)), pa.array(values[rows].view(np.int64)), pa.array(home)],
                        names=["shard", "fp", "home"],
                    )

    return fps.mapInArrow(run, "shard long, fp long, home boolean")


class Forest:
    """Union-find over array positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                self.parent = q
                return q
            p = q

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.roots()
            x, y = p[a], p[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            live = low != high
            if not live.any():
                return
            a, b = a[live], b[live]
            np.minimum.at(self.parent, high[live], low[live])


def link(values: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest, leaf: int = 2048, agree=None) -> None:
    """Joins in ``forest`` all pairs within ``radius`` of positions ``a`` x ``b`` (that also ``agree``); a vantage-point tree down to leaves."""
    work = [(a, b)]
    while work:
        a, b = work.pop()
        if not len(a) or not len(b):
            continue
        if len(a) > leaf:
            point = values[a[len(a) // 2]]
            da, db = (np.bitwise_count(values[x] ^ point).astype(int) for x in (a, b))
            mu = int(np.median(da))
            inside = da <= mu
            if 0 < inside.sum() < len(a):
                parts = [(a[inside], b[db <= mu + radius]), (a[~inside], b[db > mu - radius])]
                if all(len(y) < len(b) for _, y in parts) or sum(len(x) * len(y) for x, y in parts) < 0.9 * len(a) * len(b):
                    work += parts
                    continue
        step = max(1, (1 << 21) // len(b))
        for at in range(0, len(a), step):
            rows = a[at : at + step]
            i, j = np.nonzero(np.bitwise_count(values[rows][:, None] ^ values[b][None, :]) <= radius)
            i, j = rows[i], b[j]
            apart = i != j if agree is None else (i != j) & agree(i, j)
            forest.join(i[apart], j[apart])


def shard_edges(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b): for each component found in a shard, its fingerprints to the first of them."""

    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        order = np.argsort(fps, kind="stable")
        fps, home = fps[order], home[order]
        forest = Forest(len(fps))
        link(fps, np.nonzero(home)[0], np.arange(len(fps)), radius, forest)
        root = forest.roots()
        far = root != np.arange(len(fps))
        return pa.table({"a": fps[far].view(np.int64), "b": fps[root[far]].view(np.int64)})

    return shards.groupBy("shard").applyInArrow(run, "a long, b long")


# -- components -------------------------------------------------------------


def contract(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root names its component.

    Each round sends every node to the least node next to it and replaces the
    edges by those between the images.  Fingerprints are random, so the count
    of nodes falls by a constant factor a round.  Hubs are safe: minima are
    combined before the shuffle, and the joins are plain equi-joins that
    adaptive execution splits.
    """
    edges = materialize(edges.distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "step")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        after = (
            edges.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        old, edges = edges, materialize(after, "edges")
        discard(old)
        maps.append(step)
    else:
        raise RuntimeError("components did not settle")
    discard(edges)
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    found = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("to").alias("_to"))
        found = found.join(nxt, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    found = materialize(found, "roots")
    for step in maps:
        discard(step)
    return found


def firsts(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, n, first) of each of ``nodes`` (key, n, one): first is the first row of its component under ``roots`` (node, root)."""
    least = roots.join(nodes, roots["node"] == nodes[key]).groupBy("root").agg(F.min("one").alias("of_root"))
    named = roots.join(least, "root").select(F.col("node").alias(key), "of_root")
    return materialize(nodes.join(named, key, "left").select(key, "n", F.coalesce("of_root", "one").alias("first")), "firsts")


def tree_edges(fps: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS, sample: int = TREE_SAMPLE) -> DataFrame:
    """(a, b) of the settled table ``fps`` of distinct fingerprints: spanning stars of what the trees' shards link within ``radius`` bits."""
    count = fps.count()
    rows = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    some = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, count) / shard_rows))))
    rng = np.random.default_rng(SEED)
    blocks = radius + 1
    trees = [grow(some, mask, radius // blocks, radius, depth, rng) for mask in masks(blocks)] if depth else [None]
    return shard_edges(routed(fps, trees), radius)


def components(fps: DataFrame, radius: int = 3, **tree) -> DataFrame:
    """(fp, n, first) of each distinct fingerprint; fps has (doc_id, mark, fp). n rows have it; first is the first row reachable."""
    nodes = materialize(fps.groupBy("fp").agg(first_row().alias("one"), F.count("*").alias("n")), "nodes")
    return firsts(nodes, contract(tree_edges(nodes.select("fp"), radius, **tree)), "fp")


def linked(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, **tree) -> DataFrame:
    """(doc_id, mark, fp, first) of each row."""
    fps = materialize(fingerprints(identified(docs, id_col, text_col), words), "fingerprints")
    return spread_join(fps, components(fps, radius, **tree), "fp", fps.count())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, **tree
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Rows without words (null, empty, white space) have fingerprint zero and are
    linked with each other like any equal fingerprints.  Repeated rows and
    repeated ids stay rows of their own and share a component.  A null id is
    never a component's name unless the component has no other.  An empty table
    gives an empty result.
    """
    return linked(docs, id_col, text_col, words, radius, **tree).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, **tree) -> DataFrame:
    """``docs`` with one row (least id, rows without id last) of each group of linked fingerprints; its columns as they were.

    Rows go by id and text together: a row never goes for another one that shares its id.  Of rows that
    repeat id and text one stays.  All rows without words are one group.  An empty table gives an empty result.
    """
    rows = materialize(linked(docs, id_col, text_col, words, radius, **tree), "linked")
    return without_copies(docs, rows, id_col, text_col)

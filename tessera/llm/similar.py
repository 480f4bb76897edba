"""Near copies by SimHash and vantage-point trees, verified on their five-word shingle sets, and what fingerprints can't reach.

Candidates.  Texts whose 64-bit SimHashes (op7's, over three-word shingles) are within
3 bits, found by op7's vantage-point trees without loss.  Most pairs of similarity 0.8
lie farther apart, where a tree prunes nothing; for those a shingle set also has
``BANDS`` bands of ``ROWS`` minima under seeded hash functions, and texts that share a
band are candidates too.  Whatever the edit (words, a block cut, appended or replaced),
a pair of similarity s shares none with probability (1 - s**5)**24: 7e-5 at 0.8, 8e-7
at 0.85; it is lost only if its fingerprints are apart as well.  A fingerprint and a
band send each of their texts to the least key only, and contraction gives the
candidate groups.

Verification.  A candidate group may be too wide and links nothing by itself.  The
shingle sets of its members meet in a task, each distinct word sequence once, and a
pair is linked only at ``LEAST`` or more.  From a member the search goes to all members
that are not in its component yet, so a group of alike copies takes about one comparison
a member, not one a pair; a wide group without links takes all pairs.  A group of m
word sequences is dealt by hash into blocks of about 8 * sqrt(m), ``BLOCK_ROWS`` at most
and a sixteenth of it at least, and a task gets one pair of blocks: so a task's share is
bounded, more machines take a large group faster, and no pair is lost; the blocks' links
are then contracted.  (A large group's sets are sent once for each of its blocks.)
Word sequences are told apart by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, first_row, identified, map_texts, materialize, sized_join, spread_join, without_copies
from tessera.llm.simhash import SEED, contract, firsts, of_words, tree_edges

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
#: Word sequences of a group in one block, at most.
BLOCK_ROWS = 8192


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def sequence(w: list[bytes]) -> int:
    """Signed 64-bit hash of a word sequence; 0 without words."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(w), SEED)).astype(np.int64)) if w else 0


def shingles(w: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of all words if they are fewer."""
    h, join = xxhash.xxh3_64_intdigest, b" ".join
    if len(w) < SHINGLE:
        return np.array([h(join(w), SEED)] if w else [], np.uint64)
    return np.unique(np.array([h(join(g), SEED) for g in zip(*(w[i:] for i in range(SHINGLE)))], np.uint64))


#: Multipliers (odd) and summands of the 32-bit hash functions.
BY, PLUS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32) | np.array([1, 0], np.uint32)[:, None, None]


def bands(grams: np.ndarray) -> list[int]:
    """A signed 64-bit hash of each band; none without shingles."""
    if not len(grams):
        return []
    grams = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(grams), 256):
        part = grams[at : at + 256] * BY
        part += PLUS
        least = np.minimum(least, part.min(1))
    return [xxhash.xxh3_64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def components(sets: list[np.ndarray]) -> np.ndarray:
    """The component of each set under Jaccard similarity ``LEAST``, named by its first position."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    inside = np.zeros(len(names), bool)
    found = np.full(n, -1, np.int64)
    rest = np.arange(n)
    while len(rest):
        start, rest = rest[0], rest[1:]
        found[start] = start
        queue = [start]
        while queue and len(rest):
            at = queue.pop()
            near = rest[LEAST * np.maximum(sizes[rest], sizes[at]) <= np.minimum(sizes[rest], sizes[at])]
            if not len(near):
                continue
            own = ids[ends[at] - sizes[at] : ends[at]]
            inside[own] = True
            shared = np.array([np.count_nonzero(inside[ids[ends[j] - sizes[j] : ends[j]]]) for j in near])
            inside[own] = False
            # 5 shared >= 4 union, in whole numbers
            linked = near[5 * shared >= 4 * (sizes[near] + sizes[at] - shared)]
            found[linked] = start
            queue += linked.tolist()
            rest = rest[found[rest] < 0]
    return found


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, mark, key, fp, bands) of each row of (doc_id, text, mark); fp is the fingerprint as a signed long."""

    def make():
        def work(batch):
            split = [words(t) for t in batch]
            return [(sequence(w), int(np.uint64(of_words(w)).astype(np.int64)), bands(shingles(w))) for w in split]

        return work

    return map_texts(texts, make, "key long, fp long, bands array<long>")


def fingerprint_edges(nodes: DataFrame, **tree) -> DataFrame:
    """(a, b): keys of ``nodes`` (key, fp) that equal fingerprints or the vantage-point trees link."""
    hubs = materialize(nodes.groupBy("fp").agg(F.min("key").alias("hub")), "fingerprints")
    same = nodes.join(hubs, "fp").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    near = tree_edges(hubs.select("fp"), **tree).join(hubs.toDF("a", "x"), "a").join(hubs.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(near)


def shingle_sets(members: DataFrame) -> DataFrame:
    """(root, key, blocks, shingles) of (doc_id, mark, text, root, key, blocks); a task gives a key once, however often its row repeats."""
    bound_batches(members.sparkSession)
    columns = [members.columns.index(c) for c in ("root", "key", "blocks", "text")]

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            root, key, blocks, text = (batch.column(k) for k in columns)
            fresh = [k for k, x in enumerate(key.to_pylist()) if not (x in met or met.add(x))]
            some = pa.array(fresh, pa.int64())
            split = [words(text[k].as_py()) for k in fresh]
            sets = [shingles(w).tobytes() for w in split]
            yield pa.RecordBatch.from_arrays([root.take(some), key.take(some), blocks.take(some), pa.array(sets, pa.binary())], names=["root", "key", "blocks", "shingles"])

    return members.mapInArrow(run, "root long, key long, blocks int, shingles binary")


def verified(members: DataFrame) -> DataFrame:
    """(a, b): keys of verified components, each with the component's first, of each pair of blocks of each group."""

    def run(table: pa.Table) -> pa.Table:
        keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
        held = table.column("shingles").take(pa.array(first))
        found = components([np.frombuffer(s.as_buffer(), np.uint64) for s in held])
        far = found != np.arange(len(keys))
        return pa.table({"a": keys[far], "b": keys[found[far]]})

    block = F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")
    sets = shingle_sets(members).withColumn("block", block)
    dealt = sets.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pair = F.struct(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return dealt.select("root", pair.alias("pair"), "key", "shingles").groupBy("root", "pair").applyInArrow(run, "a long, b long")


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, **tree) -> DataFrame:
    """(doc_id, mark, first) of each row; first is the first row (no_id, doc_id, mark) of its group."""
    texts = identified(docs, id_col, text_col)
    rows = materialize(signatures(texts), "signatures")
    ids = rows.select("doc_id", "mark", "key")
    nodes = materialize(rows.groupBy("key").agg(first_row().alias("one"), F.count("*").alias("n"), F.first("fp").alias("fp")), "nodes")
    # one row stands for all with its word sequence
    shared = rows.groupBy("key").agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("band"))
    hubs = shared.groupBy("band").agg(F.min("key").alias("hub"))
    edges = shared.join(hubs, "band").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    roots = contract(edges.unionByName(fingerprint_edges(nodes.select("key", "fp"), **tree)))
    n = F.count("*")
    size = F.greatest(F.lit(max(1, block_rows // 16)), F.least(F.lit(block_rows), 8 * F.sqrt(n)))
    sizes = roots.groupBy("root").agg(F.ceil(n / size).cast("int").alias("blocks"))
    wanted = materialize(
        nodes.join(roots.join(sizes, "root"), nodes["key"] == roots["node"]).select("root", "key", "blocks", F.col("one.mark").alias("_mark"), F.col("one.doc_id").alias("_id")), "wanted"
    )
    members = sized_join(texts, wanted, [texts["mark"] == wanted["_mark"], texts["doc_id"].eqNullSafe(wanted["_id"])], "inner")
    found = firsts(nodes, contract(verified(members)), "key")
    return spread_join(ids, found, "key", ids.count())


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, component_id) of each row; component_id is the least id of its group of near copies.

    All rows without words are one group.  Repeated rows share a group; a null id
    names a group only if it has no other.  An empty table gives an empty result.
    """
    return similar_rows(docs, id_col, text_col, **how).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row (least id, rows without id last) of each group of near copies; its columns as they were.

    Rows go by id and text together: a row never goes for another one that shares its id.  Of rows that
    repeat id and text one stays.  All rows without words are one group.  An empty table gives an empty result.
    """
    rows = materialize(similar_rows(docs, id_col, text_col, **how), "similar")
    return without_copies(docs, rows, id_col, text_col)

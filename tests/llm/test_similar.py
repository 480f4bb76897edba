"""The pipeline's near copies against brute force over five-word shingle sets."""

import random

import pytest

from tessera.llm import pipeline_stages, simhash, similar


def five(text):
    w = tuple((text or "").lower().split())
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) > 4 else {w}


def similarity(a, b):
    return len(a & b) / len(a | b)


def kept_by_brute_force(rows):
    """One row of each group: the least id, rows without id last; rows are told apart by id and text."""
    rows = list(dict.fromkeys(rows))
    sets, root = [five(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((None if none else d for none, d in least.values()), key=repr)


def kept(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r["doc_id"] for r in similar.keep_one(frame, **how).collect()), key=repr)


def base(small):
    return [t for _, t in small[1] if t and 150 <= len(t.split()) <= 1500]


def test_alike_texts_below_the_bound_stay(spark, small):
    """Evenly scattered edits at similarity 0.7 to 0.8 are no near copies."""
    rows = []
    for k, t in enumerate(base(small)[:60]):
        w = t.split()
        edited = ["changed" if i % 32 == 16 else x for i, x in enumerate(w)]
        if 0.7 <= similarity(five(t), five(" ".join(edited))) < 0.8:
            rows += [(2 * k, t), (2 * k + 1, " ".join(edited))]
    assert len(rows) > 40
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_block_edits(spark, small):
    """Cut, appended and replaced passages, and scattered words, on both sides of the bound."""
    rng = random.Random(3)
    rows = []
    for k, t in enumerate(base(small)[:60]):
        w = t.split()
        n = len(w)
        new = [rng.choice(["stone", "river", "seven", "walks", "under", "light"]) + str(rng.randrange(99)) for _ in range(n)]
        mid = n // 2
        edits = [
            w[: n - n * 15 // 100], w + new[: n * 15 // 100], w + new[: n // 10], w[:mid] + new[: n * 8 // 100] + w[mid + n * 8 // 100 :], w[: n * 3 // 4], [*w[:9], "changed", *w[10:]],
        ]
        rows.append((1000 + k, t))
        rows.append((2000 + k, " ".join(edits[k % len(edits)])))
    rows += small[1]
    want = kept_by_brute_force(rows)
    assert kept(spark, rows) == want
    assert kept(spark, rows, block_rows=1) == want  # every group in blocks


def test_edges_of_the_table(spark, odd, empty):
    rows = [(5, "a b c"), (4, "A  b\nc"), (3, "a b d"), (9, None), (8, ""), (7, " \n"), (None, "q w e r t y"), (None, "nothing else is alike"), (6, "Q w e r t y")]
    rows += [(11, f"hot id text number {k} of many") for k in range(5)]
    rows += [(12, "repeated row of one id"), (12, "repeated row of one id"), (12, "another text of this id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((r["doc_id"], r["text"]) for r in similar.keep_one(frame).collect()), key=repr)
    assert [d for d, _ in found] == [11] * 5 + [12, 12, 3, 4, 6, 7, None]
    assert similar.keep_one(frame.where("false")).count() == 0
    assert similar.keep_one(empty).columns == empty.columns
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == [-11, 1, 2, 5, 6, 7, 9, None]


@pytest.mark.parametrize("keep", [similar.keep_one, simhash.keep_one])
def test_a_shared_id_loses_no_text(spark, keep):
    """A row never goes because another one with its id went."""
    a, b = "one two three four five six seven eight", "some other words that nobody else has here"
    rows = spark.createDataFrame([(3, a), (7, a), (7, b), (8, b), (None, a), (None, a)], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, keep(rows).collect())) == [(3, a), (7, b)]
    none = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted(map(tuple, keep(none).collect())) == [(None, a), (None, b)]


def test_fingerprints_find_near_copies(spark):
    """The pipeline's stage links what SimHash finds: these near copies have one fingerprint, and share no band of minima."""
    cycle = ["w49879", "w55488", "w76948", "w79838", "w25018", "w42631", "w87339", "w59382", "w24292"] * 12
    a, b = " ".join(["a4689", *cycle]), " ".join([*cycle, "b4689"])
    assert 0.8 <= similarity(five(a), five(b)) < 0.85 and simhash.fingerprint(a) == simhash.fingerprint(b)
    assert not set(similar.bands(similar.shingles(similar.words(a)))) & set(similar.bands(similar.shingles(similar.words(b))))
    rows = [(1, a), (2, b), (3, "some other words that nobody else has here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pipeline_stages.keep_one_of_each_group(spark, frame, "").collect()
    assert sorted(r["doc_id"] for r in found) == kept_by_brute_force(rows) == [1, 3]


def test_trees_join_candidates(spark, small):
    """Fingerprints within 3 bits are candidates whatever the shards; what is linked keeps to similarity 0.8."""
    rows = []
    for k, t in enumerate(base(small)[:40]):
        w = t.split()
        rows += [(2 * k, t), (2 * k + 1, " ".join([*w[:9], "changed", *w[10:]]))]
    fps = [simhash.fingerprint(t) for _, t in rows]
    near = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert any(fps[i] != fps[j] for i, j in near)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "key long, fp long")
    for how in ({}, {"shard_rows": 4, "sample": 32}):
        roots = {r["node"]: r["root"] for r in simhash.contract(similar.fingerprint_edges(nodes, **how)).collect()}
        assert all(i in roots and roots[i] == roots.get(j) for i, j in near)
        assert kept(spark, rows, **how) == kept_by_brute_force(rows)

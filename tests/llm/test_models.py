"""Fitted and approximate operators, the mix, and the pipeline."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, mixing, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def labelled(spark, label):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, {r["doc_id"]: r[label] for r in labels.collect()}


def test_quality(spark, odd, empty):
    docs, labels, truth = labelled(spark, "quality")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    test = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([p == y for _, p, y in test]) > 0.98
    good, bad = [s for s, _, y in test if y], [s for s, _, y in test if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99
    model = quality.fit([], {})
    assert {r["score"] for r in quality.score(odd, model).collect()} <= {0.5}
    assert quality.score(empty, model).count() == 0
    assert quality.quality(odd, labels.limit(0)).count() == odd.count()


def test_attention_gradient():
    """The hand-written gradient moves the loss: a bag is bad if one of its passages is."""
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "words", "here"]) for _ in range(64))
    bad = lambda: " ".join(rng.choice(["the***", "of%%%", "and$$$", "words&&&"]) for _ in range(64))
    rows = []
    for k in range(160):
        parts = [good() for _ in range(4)]
        if k % 2:
            parts[rng.randrange(4)] = bad()
        rows.append((" ".join(parts), int(k % 2 == 0)))
    model = quality.fit(rows[:120], {0: 60, 1: 60}, epochs=40)
    scores = quality.predict(model, quality.Encoder(), [t for t, _ in rows[120:]])
    assert np.mean((scores > 0.5) == np.array([y for _, y in rows[120:]])) > 0.95


def test_toxicity(spark, odd, empty):
    docs, labels, truth = labelled(spark, "toxic")
    rows = toxicity.toxicity(docs, labels).collect()
    test = [(r["toxic"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    hit = sum(t and y for t, y in test)
    assert hit / sum(t for t, _ in test) > 0.9 and hit / sum(y for _, y in test) > 0.85
    assert all(0 <= r["severity"] <= 3 and r["severity"] >= r["p_toxic"] - 1e-9 for r in rows)
    model = toxicity.train(docs, labels)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.toxicity(odd, labels.limit(0)).where("toxic").count() == 0


def test_ordinal_grades():
    """Given grades are kept apart in order."""
    rng = random.Random(2)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"])
    rows = []
    for k in range(300):
        g = k % 3
        rows.append((" ".join([word() for _ in range(40 - 6 * g)] + ["awful"] * (6 * g)), g))
    model = toxicity.fit(rows, Counter(g for _, g in rows))
    scores = model.word_scores()
    severity = [[model.grades(t, scores).sum() for t, y in rows if y == g] for g in range(3)]
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    assert max(severity[0]) < np.mean(severity[1]) < min(severity[2])


def sellers(pattern, words):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j - 1] + (p != w), row[j] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("n", [1, 7, 8, 20, 63, 64, 65, 90])
def test_edit_matching(n):
    rng = random.Random(n)
    words = [b"w%d" % i for i in range(40)]
    for _ in range(8):
        items = [(k, [rng.choice(words) for _ in range(n)]) for k in range(3)]
        docs = [[]]
        for _ in range(4):
            w = [rng.choice(words) for _ in range(rng.randrange(30))] + list(rng.choice(items)[1]) + [rng.choice(words) for _ in range(rng.randrange(30))]
            for _ in range(rng.randrange(max(2, n // 3))):
                i, what = rng.randrange(len(w)), rng.random()
                if what < 0.4:
                    w[i] = rng.choice(words)
                elif what < 0.7:
                    w.insert(i, rng.choice(words))
                elif len(w) > 1:
                    w.pop(i)
            docs.append(w)
        want = {(t, k, d) for t, w in enumerate(docs) for k, p in items if (d := sellers(p, w)) <= decontaminate.budget(n)}
        assert set(decontaminate.Matcher(items).match(docs)) == want


def test_contamination(spark, small, odd, empty):
    folder, docs = small
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [(r["item_id"], decontaminate.words_of(r["text"])) for r in bench.collect()]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    want = {}
    for d, t in docs:
        w = decontaminate.words_of(t)
        want[d] = [i for i, p in items if sellers(p, w) <= decontaminate.budget(len(p))] if len(w) < 2500 else None
    for size in (500_000, 200):  # one block, and many
        got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(frame, bench, block_words=size).collect()}
        assert all(got[d] == ",".join(map(str, sorted(w))) for d, w in want.items() if w is not None)
    item = " ".join(w.decode() for w in items[0][1])
    rows = spark.createDataFrame([(1, f"Before. {item.upper()}! after"), (2, "clean text"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.without_contaminated(rows, bench).orderBy("doc_id").collect()] == [2, 3]
    none = spark.createDataFrame([(1, None), (2, " ")], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("contaminated").count() == 0
    assert decontaminate.contamination(odd, none.limit(0)).count() == odd.count() and decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.without_contaminated(odd, bench).columns == odd.columns


def filled(sizes, weights, cap):
    """Water-filling by rounds: clamp, share the excess by weight, until none is above."""
    total, limit = sum(sizes), [cap * s for s in sizes]
    share, capped = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(x for x, c in zip(limit, capped) if c)
        free = sum(w for w, c in zip(weights, capped) if not c)
        share = [x if c else rest * w / free if free else 0.0 for x, w, c in zip(limit, weights, capped)]
        over = [not c and s > x for s, x, c in zip(share, limit, capped)]
        if not any(over):
            return share
        capped = [c or o for c, o in zip(capped, over)]


def test_mixing(spark, odd, empty):
    rng = random.Random(3)
    rows = []
    for k, source in enumerate(["hot", "b", "a", "ü", "Z", None, "tiny", "nil"]):
        for _ in range([3000, 300, 200, 400, 500, 100, 1, 5][k]):
            rows.append((len(rows), " ".join("w" * rng.randrange(1, 4) for _ in range(0 if source == "nil" else rng.choice([1, 5, 20, 200])))[:2000], source))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(frame).collect()
    names = sorted({r["source"] for r in got if r["source"] is not None}) + [None]
    size = {s: sum(r["size"] for r in got if r["source"] == s) for s in names}
    want = filled([size[s] for s in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))], 3)
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in names}
    for s, w in zip(names, want, strict=True):
        assert next(r["target"] for r in got if r["source"] == s) == pytest.approx(w)
        assert abs(taken[s] - w) <= max(0.03 * w, 200)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and r["source_size"] == size[r["source"]] for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()), key=repr)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_mixing_sql(spark, small):
    folder, _ = small
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = c.execute(queries.oracle_sql()["op10_mixing"])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(dict(zip(names, r, strict=True)).items()) for r in cursor.fetchall())
    got = sorted(tuple((n, r[n]) for n in names) for r in queries.queries()["op10_mixing"](spark, folder).collect())
    assert got == want


def test_pipeline(spark, small, tmp_path):
    """Each stage on what the one before kept; decisions take effect and clean documents stay."""
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns, name
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = out
    assert 0.6 * before < docs.count() < before
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(docs.columns)

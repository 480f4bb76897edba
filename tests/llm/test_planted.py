"""Planted cases, time bounds, and fitted operators against plain re-computations."""

import math
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import licenses, mixing, pii, quality, repetition, secrets, toxicity

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
PLAIN = "the house stood near a river and nobody had seen the old bridge before winter came over the hills again".split()


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def frame_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def check_digit(number):
    d = [int(c) for c in number][::-1]
    return str(-(sum(sum(divmod(2 * x, 10)) for x in d[::2]) + sum(d[1::2])) % 10)


def pii_case(rng, kind):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = digits(15)
    card += check_digit(card)
    wrong = card[:-1] + str((int(card[-1]) + rng.randrange(1, 9)) % 10)
    phone = f"1 ({rng.randrange(200, 999)}) 555-{digits(4)}"
    return {
        "base phone": f"+{phone}", "base card": card, "base mail": f"{rng.choice(PLAIN)}.{digits(2)}@mail.example.com", "base ip": f"{rng.randrange(1, 255)}.{rng.randrange(255)}.{rng.randrange(255)}.7",
        "like phone": phone, "like cards": f"{card} {card}", "like mail": f"{rng.choice(PLAIN)} (at) mail (dot) example.com",
        "no luhn": wrong, "no hex": "".join(rng.choice("abcdef") + digits(9) + rng.choice("abcdef") for _ in range(4)), "no date": f"{1900 + rng.randrange(120)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)} 1{rng.randrange(9)}:20:30",
        "no number": f"{digits(9)} pieces",
    }[kind]


def test_planted_pii(spark):
    """Like spans that the base patterns miss are found; numbers that fail the check digit and pieces of digests are not."""
    rng = random.Random(4)
    kinds = ["base phone"] * 5 + ["base card"] * 5 + ["base mail"] * 5 + ["base ip"] * 2 + ["like phone", "like cards", "like mail"] + ["no luhn"] * 5 + ["no hex"] * 3 + ["no date"] * 3 + ["no number"] * 3
    cases = [(kinds[k % len(kinds)], *(rng.choice(PLAIN) for _ in range(4))) for k in range(20 * len(kinds))]
    texts, planted = [], []
    for kind, *w in cases:
        span = pii_case(rng, kind)
        texts.append(f"{w[0]} {w[1]} {span} {w[2]} {w[3]}")
        planted.append((len(w[0]) + len(w[1]) + 2, len(w[0]) + len(w[1]) + 2 + len(span)))
    found = by_id(pii.pii_scan(frame_of(spark, texts)))
    hits = {i for i, r in found.items() if r["n_more"]}
    like = {i for i, (kind, *_) in enumerate(cases) if kind.startswith("like")}
    assert len(hits & like) >= 0.9 * len(like) and len(hits & like) >= 0.9 * len(hits)
    for i in hits & like:
        for s in found[i]["spans"].split(","):
            _, a, b = s.split(":")
            assert planted[i][0] <= int(a) < int(b) <= planted[i][1]
    for i, r in found.items():
        if cases[i][0].startswith("no"):
            assert not r["has_pii"], texts[i]


def test_best_candidates_stay(spark):
    spans = [(0, 10, 1.0), (5, 8, 3.0), (9, 20, 2.0), (30, 40, 1.0), (39, 50, 1.0), (60, 61, 0.5)]
    rows = spark.createDataFrame([(spans,), ([],), (None,)], "s array<struct<start:int,end:int,score:double>>")
    got = [r[0] and sorted((x["start"], x["end"]) for x in r[0]) for r in rows.selectExpr(f"if(s is null, null, {pii.best_apart('s')}) AS kept").collect()]
    assert got == [[(5, 8), (9, 20), (30, 40), (60, 61)], [], None]


def test_calibration():
    """The cut is the lowest score whose pooled share of positives is high enough, with support."""
    assert pii.calibrated([(0.0, 0, 50), (1.0, 1, 50), (2.0, 45, 50), (3.0, 50, 50)]) == 2.0
    assert pii.calibrated([(0.0, 0, 50), (1.0, 10, 10), (2.0, 0, 40), (3.0, 50, 50)]) == 3.0
    assert pii.calibrated([(0.0, 0, 50), (3.0, 2, 2)]) is None
    assert pii.calibrated([]) is None


def test_planted_secrets(spark, small):
    rng = random.Random(6)
    plain = [t for _, t in small[1] if t and 50 < len(t.split()) < 400 and not re.search("password|token|secret|[0-9a-f]{20}", t, re.I)][:120]
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts, want = [], {}
    for k, t in enumerate(plain):
        w = t.split()
        if k % 3 == 0:
            w.insert(len(w) // 2, f'token = "{key(LETTERS, 32)}"')
        if k % 3 == 1:
            want[k] = key([LETTERS, LETTERS[:52], LETTERS[26:52], LETTERS[26:]][k % 4], [20, 24, 32, 40][k % 4])
            w.insert(len(w) // 2, want[k])
        texts.append(" ".join(w))
    found = by_id(secrets.secret_scan(frame_of(spark, texts)))
    assert sum(found[k]["n_random"] == 1 for k in want) >= 0.9 * len(want)
    assert sum(found[k]["n_random"] for k in found if k not in want) == 0
    assert all(found[k]["has_secret"] == (found[k]["spans"] != "") for k in found)


def test_time_grows_with_the_spans(spark):
    """Texts of megabytes with a span every few words."""
    piece = "see 10.20.30.40 and token = Abcdefgh12345 or call +1 (310) 555-4510 "
    model = pii.train(frame_of(spark, [piece] * 20))
    keys = {"ratios": [], "least": {}}
    rows = frame_of(spark, [piece * 40_000, piece * 40_000])
    for scan, count in ((lambda: pii.pii_scan(rows, model), "n_phone"), (lambda: secrets.secret_scan(rows, keys), "n_assign")):
        began = time.time()
        assert {r[count] for r in scan().collect()} == {40_000}
        assert time.time() - began < 100
    for hide, left in ((lambda: pii.redact(rows, model), "call [private] "), (lambda: secrets.mask(rows, model=keys), "and [secret] or")):
        began = time.time()
        assert {r["text"].count(left) for r in hide().collect()} == {40_000}
        assert time.time() - began < 100


def test_redact(spark, odd, empty):
    rows = spark.createDataFrame([(1, "mail a.b@example.com or ñ 10.1.2.3, x", 44), (2, None, None), (3, "fine", 99), (3, "fine", 99)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, pii.redact(rows).collect()))
    assert got == [(1, "mail [private] or ñ [private], x", 32), (2, None, None), (3, "fine", 99), (3, "fine", 99)]
    for hide in (pii.redact, secrets.mask):
        assert hide(odd).columns == odd.columns and len(hide(odd).collect()) == odd.count()
        assert hide(empty).count() == 0
    for scan in (pii.pii_scan, secrets.secret_scan):
        found = scan(odd).collect()
        assert len(found) == odd.count() and sum(r["doc_id"] == 7 for r in found) == 2 and sum(r["doc_id"] is None for r in found) == 1
        assert scan(empty).collect() == []


def test_stages_on_odd_tables(spark, odd, empty, small):
    """Nulls, repeats, clashing names and empty tables pass through every stage."""
    folder, _ = small
    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if k < 4:
                assert out.columns == docs.columns
            assert out.count() == (8 if k == 1 else docs.count()) if docs is odd else out.count() == 0
    mixed = mixing.mixed(odd)
    assert {"doc_id", "text", "docs_size", "docs_target", "copies", "size", "target"} <= set(mixed.columns)
    want = sorted(map(tuple, mixing.mix(odd).select("doc_id", "source", "size", "taken").collect()), key=repr)
    assert sorted(map(tuple, mixed.select("doc_id", "source", "size", "taken").collect()), key=repr) == want


def test_run_again(spark, small):
    """A run of a name that was finished is read, stage by stage."""
    folder, _ = small
    first = sorted(map(tuple, corpus_pipeline.run(spark, folder, "again").collect()), key=repr)
    began = time.time()
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder, "again").collect()), key=repr) == first
    assert time.time() - began < 10


# -- fitted operators --


def test_attention_by_hand(small):
    rng = np.random.default_rng(3)
    d = quality.FORMS + quality.SHAPES + 5
    shapes = {"w": (d, quality.HIDDEN), "wb": (quality.HIDDEN,), "v": (quality.HIDDEN, quality.GATES), "u": (quality.HIDDEN, quality.GATES), "a": (quality.GATES,), "c": (quality.HIDDEN,), "b": (1,)}
    model = quality.Model(rng.normal(size=d), rng.uniform(0.5, 2, d), {k: rng.normal(size=s) for k, s in shapes.items()})
    texts = [t or "" for _, t in small[1][:40]] + ["", "x", "word " * 1000]
    p, encoder = model.layers, quality.Encoder()
    for t, y in zip(texts, quality.predict(model, encoder, texts), strict=True):
        x = (encoder.encode(t) - model.mean) / model.scale
        assert len(x) == max(1, -(-(len(t.split()) - quality.PASSAGE // 4 + 1) // quality.PASSAGE))
        weights, states = [], []
        for row in x:
            h = [math.tanh(sum(row[i] * p["w"][i][j] for i in range(d)) + p["wb"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * p["v"][i][j] for i in range(quality.HIDDEN))) / (1 + math.exp(-sum(h[i] * p["u"][i][j] for i in range(quality.HIDDEN)))) for j in range(quality.GATES)]
            weights.append(math.exp(sum(g * a for g, a in zip(gate, p["a"], strict=True))))
            states.append(h)
        z = [sum(w * h[j] for w, h in zip(weights, states, strict=True)) / sum(weights) for j in range(quality.HIDDEN)]
        assert y == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["c"], strict=True)) - p["b"][0])), abs=1e-6)


def test_severity_by_hand(spark):
    model = toxicity.Model({b"awful": 1.5, b"awfu*": 0.25, b"stup*": 2.0, b"stupid*": 0.5, b"good": -1.0}, [0.5, 1.5, 3.0])
    texts = ["Awful, awfully STUPIDEST thing", "good good awful", "", None, "nothing of it here", "stup stupi"]
    found = by_id(toxicity.score(frame_of(spark, texts), model))
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        features = [f for w in words for f in [w] + [w[:n] + "*" for n in (4, 5, 6, 7, 8) if len(w) > n]]
        x = sum(model.weights.get(f.encode(), 0.0) for f in features) / math.sqrt(max(1, len(words)))
        p = [1 / (1 + math.exp(c - x)) for c in model.cuts]
        got = found[k]
        assert (got["severity"], got["p_toxic"]) == pytest.approx((sum(p), p[0]))
        shares = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        assert got["grade"] == shares.index(max(shares)) and got["toxic"] == (p[0] >= toxicity.THRESHOLD)


def test_coverage_by_hand():
    rng = random.Random(8)
    for _ in range(150):
        words = [rng.choice(["a", "bb", "ccc", "ü"]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", "\n"]) for w in words)
        m = repetition.measure(text)
        for n in repetition.NGRAM_LIMITS:
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
            assert m["coverage"][n] == pytest.approx(sum(len(words[j]) for j in inside) / max(1, sum(map(len, words))))
        lines = [x for x in text.split("\n") if x.strip()]
        again = [x for i, x in enumerate(lines) if x in lines[:i]]
        assert m["line_coverage"] == pytest.approx(sum(map(len, again)) / max(1, sum(map(len, lines))))


def test_licence_chains_by_hand():
    """Matching statistics against a search of all templates, and chains against the runs laid out by hand."""
    rng = random.Random(2)
    templates = [(f"t{k}", " ".join(rng.choice("abcde") for _ in range(rng.randrange(4, 14)))) for k in range(4)]
    scanner = licenses.Scanner(templates, [])
    lists = [t.encode().split() for _, t in templates]
    for _ in range(100):
        words = [rng.choice("abcdex").encode() for _ in range(40)]
        got = {end: length for end, length, _ in scanner.runs(words)}
        for end in range(1, len(words) + 1):
            best = max((n for n in range(end + 1) if n == 0 or any(words[end - n : end] == t[i : i + n] for t in lists for i in range(len(t) - n + 1))), default=0)
            assert got.get(end, 0) == best
    text = " ".join(f"w{k}" for k in range(40))
    scanner = licenses.Scanner([("forty", text)], [])
    w = text.split()
    gap = ["x"] * licenses.MAX_GAP
    spans = scanner.scan(" ".join(["y", *w[:10], *gap, *w[10:30], "x", *w[30:33], *w[33:]]))["spans"]
    assert spans == [("forty", 1, 1 + 40 + len(gap) + 1, 1.0)]
    spans = scanner.scan(" ".join([*w[:10], *gap, "x", *w[10:30]]))["spans"]  # too far apart: two chains
    assert spans == [("forty", 0, 10, 0.25), ("forty", 11 + len(gap), 31 + len(gap), 0.5)]
    spans = scanner.scan(" ".join([*w[20:30], *w[:10]]))["spans"]  # out of order: two chains
    assert [s[3] for s in spans] == [0.25, 0.25]

"""The operators with a fixed base result, against plain re-computations."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from tessera.llm import licenses, pii, queries, repetition, secrets, simhash, tokens

SPACE = r"[^\x20\x09-\x0D]+"


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def made(seed, pieces, count, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(most))) for _ in range(count)]


def frame_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


# -- personal data and secrets --


def spans(kind, pattern, text, fine, flags=0):
    return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if fine(m)]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def digits(s):
    return sum(c.isdigit() for c in s)


def pii_base(t):
    return [
        spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, lambda m: True),
        spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        spans("card", r"[0-9]([\x20-]?[0-9])+", t, lambda m: 14 <= digits(m[0]) <= 19 and luhn(m[0])),
        spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", t, lambda m: 10 <= digits(m[0]) <= 15),
    ]


def secret_base(t):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    return [
        spans("assign", assign, t, lambda m: len(m[2]) >= 8, re.I | re.A),
        spans("access", "AKIA[A-Z0-9]+", t, lambda m: len(m[0]) >= 16),
        spans("hex", "[0-9a-f]+", t, lambda m: len(m[0]) >= 32),
    ]


def digest(kinds):
    listed = sorted((a, rank, kind, b) for rank, found in enumerate(kinds) for kind, a, b in found)
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in listed).encode()).hexdigest()


PII_PIECES = ["a", "b.c", "@", ".", "com", "x_", "é", "😀", " ", "  ", "-", "1", "12", "255", "256", ".1", "4111111111111111", "4111 1111 1111 1111", "+1 (310) 555-4510", "+", "(", ")", "\n", "call ", "me (at) mail (dot) com", "192.168.1.1"]
SECRET_PIECES = ["password", "Token", "api_key", "apikey", "SECRET", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "f", "deadbeef", "é", "😀", "\n", "Z9", "hunter22", ".", "/", "aGVsbG8gd29ybGQhIQ8xZ", "getElementByIdentifierName", "_", "-"]
LONG = ["a" * 50_000, "1" * 50_000, "a@b" + ".c" * 20_000, "1 " * 20_000, "+" + "1-" * 20_000, "0123456789abcdef" * 2000, "token=" + "A1b" * 10_000, None, ""]


@pytest.mark.parametrize(
    ("scan", "base", "pieces", "columns"),
    [
        (pii.pii_scan, pii_base, PII_PIECES, ["n_email", "n_ip", "n_card", "n_phone"]),
        (secrets.secret_scan, secret_base, SECRET_PIECES, ["n_assign", "n_access", "n_hex"]),
    ],
)
def test_spans(spark, small, scan, base, pieces, columns):
    texts = [*made(1, pieces, 1500, 14), *LONG, *(t for _, t in small[1])]
    found = by_id(scan(frame_of(spark, texts)))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        want, got = base(t or ""), found[i]
        assert [got[c] for c in columns] == [len(k) for k in want] and got["base_sha256"] == digest(want), t
        listed = [s for s in got["spans"].split(",") if s]
        assert set(listed) >= {f"{k}:{a}:{b}" for kind in want for k, a, b in kind}  # base spans stay
        starts = [int(s.split(":")[1]) for s in listed]
        assert starts == sorted(starts)


def test_added_spans(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    blobs = ["".join(rng.choice(letters) for _ in range(44)) for _ in range(30)]
    dated = ["release-notes-2024-03-01-final"]
    plain = ["getElementByIdentifierName", "internationalization_of_words", "some-long-hyphenated-identifier"]
    texts = [f"value password = {b} end" for b in blobs[:20]] + [f"see {p} and item-{k}, {p} of 2024-01-{k:02d}" for k, p in enumerate(plain * 20)] + [f"blob {b} here" for b in blobs[20:]] + [f"see {d} too" for d in dated]
    found = by_id(secrets.secret_scan(frame_of(spark, texts)))
    assert all(found[i]["n_random"] == 0 for i in range(80))
    assert sum(found[i]["n_random"] for i in range(80, 90)) >= 9
    assert found[90]["n_random"] == 0
    texts = [f"call +1 (310) 555-45{k:02d} now" for k in range(60)] + [f"in {1900 + k} there were 12345{k:02d} things" for k in range(60)] + [f"call 1 (310) 555-45{k:02d} now" for k in range(20)]
    found = by_id(pii.pii_scan(frame_of(spark, texts)))
    assert sum(found[i]["n_more"] for i in range(120, 140)) >= 18  # like phones that the base pattern misses
    assert sum(found[i]["n_more"] for i in range(60, 120)) == 0


def test_mask(spark, odd):
    rows = spark.createDataFrame([(1, "a token = 0123456789abcdef0123456789abcdef b", 44), (2, None, None), (3, "fine", 99)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.mask(rows).orderBy("doc_id").collect()] == [(1, "a [secret] b", 12), (2, None, None), (3, "fine", 99)]
    kept = secrets.mask(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_native_plans(spark, odd):
    for scan in (pii.pii_scan, secrets.secret_scan):
        plan = scan(odd)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# -- repetition --


def repetition_base(t):
    w = re.findall(SPACE, t)
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for i in range(len(w) - 2):
        if seen[(w[i], w[i + 1], w[i + 2])] > 1:
            inside |= {i, i + 1, i + 2}
    lines, again = set(), 0
    for line in t.split("\n"):
        if re.search(SPACE, line):
            again += line in lines
            lines.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside)]


def test_repetition(spark, small, odd, empty):
    texts = [*made(2, ["a ", "b ", "ü\t", "\n", "a b c ", "# ", "\x0b", "\x85", " "], 400, 40), None, *(t for _, t in small[1])]
    found = by_id(repetition.repetition_rules(frame_of(spark, texts)))
    for i, t in enumerate(texts):
        got, want = found[i], repetition_base(t or "")
        assert [got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got["base_failed"] == failed and not (failed and got["kept"])
    passage = " ".join(f"w{k}" for k in range(100))
    m = repetition.measure(" ".join(f"v{k}" for k in range(100)) + f" {passage} {passage}")
    assert m["coverage"][10] == pytest.approx(sum(len(w) for w in passage.split()) * 2 / m["word_chars"])
    assert repetition.verdict(m) == (True, False)
    assert repetition.verdict(repetition.measure(passage)) == (False, True)
    assert repetition.repetition_rules(odd).count() == odd.count() and repetition.repetition_rules(empty).count() == 0


# -- licences --


def licenses_base(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return [len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))]


def test_licenses(spark, small, odd, empty):
    pieces = ["mit ", "License ", "gnu ", "general-", "public ", "apache\n", "CC ", "by", " the ", "under ", "licensed ", "é ", "x "]
    texts = [*made(4, pieces, 1500, 14), None, *(t for _, t in small[1])]
    found = by_id(licenses.license_scan(frame_of(spark, texts)))
    for i, t in enumerate(texts):
        got = found[i]
        assert [got[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")] == licenses_base(t or "")
        assert 0 <= got["score"] <= 1 and set(got["base_labels"].split(",")) <= set(got["labels"].split(","))
    scanner = licenses.Scanner()
    for label, text in licenses.TEMPLATES:
        words = text.split()
        cut = words[: len(words) // 2] + ["something", "else"] + words[len(words) // 2 + 1 :]
        assert label in scanner.scan(" ".join(["before", *words, "after"]).upper())["labels"].split(",")
        if len(words) > 20:  # a changed word or two leave the two halves' runs, which chain
            assert label in scanner.scan(" ".join(cut))["labels"].split(",")
    assert scanner.scan(" ".join(sorted(set(licenses.TEMPLATES[0][1].split()))))["labels"] == ""
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(empty).count() == 0


def test_matching_statistics():
    rng = random.Random(9)
    for _ in range(60):
        templates = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        auto = licenses.Automaton(templates)
        has = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        ends = lambda run: {(k, b) for k, t in enumerate(templates) for b in range(len(run), len(t) + 1) if tuple(t[b - len(run) : b]) == run}  # noqa: E731, B023
        for run in has:
            state = 0
            for x in run:
                state = auto.next[state][x]
            assert auto.ends[state] == ends(run)


# -- near copies --


def fingerprint_base(t):
    w = re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_base(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[find(i)] for i in range(len(prints))]


def check_simhash(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame, **how).collect()), key=repr)
    prints = [(d, fingerprint_base(t or "")) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, components_base(prints), strict=True)), key=repr)
    assert got == want


def test_simhash(spark, small, texts, empty):
    check_simhash(spark, small[1])
    check_simhash(spark, small[1], shard_rows=8, sample=64)  # many shards and guests
    check_simhash(spark, texts, shard_rows=2)
    assert simhash.near_duplicates(empty).count() == 0


def test_dense_cluster(spark):
    """Fingerprints in chains and balls, so that shards overlap and components need rounds."""
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(20):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << b
    fps = sorted(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, fp long, mark long")
    want = dict(zip(range(len(fps)), components_base(list(enumerate(fps))), strict=True))
    for how in ({}, {"shard_rows": 16, "sample": 200}):
        found = simhash.components(frame, **how).join(frame, "fp").select("doc_id", "first.doc_id").collect()
        assert {r[0]: r[1] for r in found} == want


def test_keep_one(spark, odd):
    text = "one two three four five six seven"
    rows = spark.createDataFrame([(5, text, 1), (3, text, 2), (9, "other words in here", 3), (4, text, 4)], "doc_id long, text string, fp long")
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 9]
    assert simhash.keep_one(odd).columns == odd.columns


# -- tokens --


def test_tokens(spark, small, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    texts = [*made(6, ["a", " ", "  ", "\n", "\t", "▁", "é", " ", "ﬁ", "<s>", "</s>", "中", "😀", "the", ".", "0", "<0x0A>", "\r"], 1500, 12), None, "y" * 5000, *(t for _, t in small[1])]
    found = by_id(tokens.token_counts(frame_of(spark, texts), limit=100))
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert tokens.token_counts(odd).count() == odd.count() and tokens.token_counts(empty).count() == 0


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))

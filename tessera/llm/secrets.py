"""Secret scans by character Markov models, in SQL functions alone.

Base patterns (assignments, access keys, long hex) give their spans.  Beyond
them every token of eight or more key-like characters is scored by two
first-order character models, one of random strings and one of ordinary
identifiers: the sum of log P(next | char) under the first less that under the
second.  A token whose sum reaches its length's threshold is a span of kind
``random``; nothing but the ratio decides.

Training.  Both models are trained from labelled samples of a bounded share of
the texts (half at most): random are the values of base secrets, ordinary the
numbers and the recurring words and identifiers that overlap none.  Pair counts (one row a pair of characters, at
most 2 * 67 * 67) are all that reaches the driver.  A pair's probability is
smoothed towards its second character's, and both models are mixed with the
uniform one: random strings may come from alphabets that the samples lack, and a
pair that ordinary words never had is no proof.  Without samples no token scores.

Thresholds.  The scores of the tokens of all other texts that overlap no base span
are counted by class of length.  Those that reach ``LEAST_SUM`` (odds of a million)
and are proven ordinary, as numbers or because they recur after different tokens
(copies of a text repeat its secrets, but after the same ones), set the class's
threshold: the least whole number that at most ``FALSE_SHARE`` of its tokens reach
so, and at least ``LEAST_SUM``.
What remains out of reach: tokens under eight characters, random strings that
are short or look like words.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import picked
from tessera.llm.native import apart, located, masked, ordered, quoted, replaced, written

KINDS = ["assign", "access", "hex"]

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"  # 16 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Fewest characters of a scored token, as of an assigned value.
SHORTEST = 8
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
#: Ordinary words, numbers and identifiers for training.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{5,}+"
NUMBER = r"^[0-9+/_=-]+$"
#: Counts that a character's whole distribution weighs against a pair's own.
PRIOR = 10.0
#: Share of the uniform model in the models of random strings and of ordinary identifiers.
UNIFORM = {1: 0.5, 0: 0.05}
#: Distinct texts in the training sample, in expectation.
TRAIN_ROWS = 4000
#: Least log-likelihood ratio of a span.
LEAST_SUM = 14
#: Share of a class's tokens that are proven ordinary and may reach the threshold, and the least lengths of the classes.
FALSE_SHARE, LENGTHS = 0.0001, (8, 12, 16, 20, 24, 32, 48)
#: Ratios are held in this many parts of a nat.
PARTS = 10_000
NONE = len(ALPHABET)


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds _assign, _access, _hex (spans of the base kinds, failing matches dropped) and _base, all of them by start."""
    value = f"char_length(regexp_extract(x.value, {quoted(ASSIGN)}, 2)) >= 8"
    return (
        rows.withColumn("_assign", located("assign", ASSIGN)).withColumn("_access", located("access", ACCESS, guard="AKIA")).withColumn("_hex", located("hex", HEX))
        .withColumn("_assign", F.expr(f"filter(_assign, x -> {value})"))
        .withColumn("_base", ordered(F.concat("_assign", "_access", "_hex"), KINDS))
    )


def log_probabilities(pairs: dict[str, int], uniform: float) -> dict[str, float]:
    """log P(b | a) of each pair ab of the alphabet."""
    whole = {b: 1.0 for b in ALPHABET}
    first = dict.fromkeys(ALPHABET, 0.0)
    for p, n in pairs.items():
        whole[p[1]] += n
        first[p[0]] += n
    total = sum(whole.values())

    def chance(a: str, b: str) -> float:
        own = (pairs.get(a + b, 0) + PRIOR * whole[b] / total) / (first[a] + PRIOR)
        return math.log((1 - uniform) * own + uniform / len(ALPHABET))

    return {a + b: chance(a, b) for a in ALPHABET for b in ALPHABET}


def class_of(length: str) -> str:
    """SQL: the class of a token's length."""
    return "case " + " ".join(f"when {length} >= {n} then {n}" for n in reversed(LENGTHS)) + " end"


def labelled(spans: DataFrame, pattern: str) -> DataFrame:
    """(random, value): the values of base secrets (1) and the tokens of a pattern that overlap none (0)."""
    secret = F.concat(
        F.transform(F.col("_assign"), lambda x: F.regexp_extract(x["value"], ASSIGN, 2)), F.transform("_access", lambda x: x["value"]), F.transform("_hex", lambda x: x["value"])
    )
    plain = F.regexp_extract_all(masked("text", "_base", " "), F.lit(pattern), F.lit(0))
    samples = F.array(F.struct(F.lit(1).alias("random"), secret.alias("values")), F.struct(F.lit(0).alias("random"), plain.alias("values")))
    return spans.select(F.explode(samples).alias("s")).select("s.random", F.explode("s.values").alias("value"))


def fitted(rows: DataFrame) -> list[int]:
    """The ratio of each pair of characters in parts of a nat, from the sampled texts; copies count once."""
    found = labelled(base_spans(rows.select("text").dropDuplicates(["text"])), WORD).groupBy("random", "value").agg(F.count("*").alias("n"))
    # ordinary words recur; a token that occurs once may be a random string, unless it is a number
    words = found.where((F.col("random") == 1) | (F.col("n") > 1) | F.col("value").rlike(NUMBER))
    pairs = words.select("random", "n", F.explode(F.expr("transform(sequence(1, char_length(value) - 1), i -> substring(value, i, 2))")).alias("pair"))
    counts: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        if r["pair"][0] in ALPHABET and r["pair"][1] in ALPHABET:
            counts[r["random"]][r["pair"]] = r["n"]
    if not counts[0] or not counts[1]:
        return []
    random, ordinary = (log_probabilities(counts[kind], UNIFORM[kind]) for kind in (1, 0))
    return [round(PARTS * (random[a + b] - ordinary[a + b])) for a in ALPHABET for b in ALPHABET]


def thresholds(rows: DataFrame, ratios: list[int]) -> dict[int, int]:
    """The threshold of each class of length, from the tokens of all rows given that overlap no base span."""
    least = dict.fromkeys(LENGTHS, LEAST_SUM)
    if not ratios:
        return least
    rest = base_spans(rows).select(masked("text", "_base", " ").alias("rest"))
    tokens = rest.select(F.regexp_extract_all("rest", F.lit(TOKEN), F.lit(0)).alias("values"))
    tokens = tokens.select(F.posexplode("values").alias("at", "value"), F.col("values")).select("value", F.expr("if(at = 0, '', values[at - 1])").alias("before"))
    sums = F.greatest(F.expr(f"floor({ratio('value', ratios)} / {PARTS})"), F.lit(LEAST_SUM - 1))
    kinds = tokens.select(F.expr(class_of("char_length(value)")).alias("class"), sums.alias("sum"), F.when(sums >= LEAST_SUM, F.col("value")).alias("value"), F.xxhash64("before").alias("before"))
    each = kinds.groupBy("class", "sum", "value").agg(F.count("*").alias("n"), (F.min("before") < F.max("before")).alias("recurs"))
    proven = F.when(F.col("recurs") | F.col("value").rlike(NUMBER), F.col("n")).otherwise(0)
    found = each.groupBy("class", "sum").agg(F.sum("n").alias("n"), F.sum(proven).alias("ordinary")).collect()
    for n in LENGTHS:
        mine = [r for r in found if r["class"] == n]
        allowed, above = FALSE_SHARE * sum(r["n"] for r in mine), 0
        for r in sorted(mine, key=lambda r: -r["sum"]):
            above += r["ordinary"] if r["sum"] >= LEAST_SUM else 0
            if above > allowed:
                least[n] = r["sum"] + 1
                break
    return least


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """{"ratios": one number for each pair of characters (none without samples), "least": the thresholds}."""
    rows = picked(docs, id_col, text_col)
    count = rows.count()
    share = min(0.5, train_rows / count) if count else 0.5
    # by the text's hash: the same rows whatever their order or partitions
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40))
    ratios = fitted(rows.where(part))
    return {"ratios": ratios, "least": thresholds(rows.where(~part), ratios)}


def ratio(value: str, ratios: list[int]) -> str:
    """SQL: the log-likelihood ratio of a token in parts of a nat; linear in its length.

    The fold holds the sum and, in its lowest seven bits, the last character's number.
    """
    size = len(ALPHABET)
    numbers = ",".join(str(ALPHABET.index(chr(c)) if chr(c) in ALPHABET else NONE) for c in range(128))
    scores = ",".join(str(128 * ratios[a * size + b]) if a < size and b < size else "0" for a in range(size + 1) for b in range(size + 1))
    codes = f"transform(split({value}, ''), c -> cast(split('{numbers}', ',') as array<bigint>)[least(ascii(c), 127)])"
    step = f"held - (held & 127) + cast(split('{scores}', ',') as array<bigint>)[cast((held & 127) * {size + 1} + code as int)] + code"
    return f"shiftright(aggregate({codes}, {NONE}L, (held, code) -> {step}), 7)"


def with_spans(rows: DataFrame, model: dict) -> DataFrame:
    """Adds _assign, _access, _hex, _random, and _base and _all by start, then kind, to rows with ``text``."""
    rows = base_spans(rows)
    if not model["ratios"]:
        return rows.withColumn("_random", F.expr("slice(_hex, 1, 0)")).withColumn("_all", F.col("_base"))
    least = "case " + " ".join(f"when char_length(value) >= {n} then {PARTS * model['least'][n]}" for n in reversed(LENGTHS)) + " end"
    high = f"{ratio('value', model['ratios'])} >= {least}"
    # places are worked out only where a token scores high
    some = F.expr(f"exists(regexp_extract_all(text, {quoted(TOKEN)}, 0), value -> {high})")
    rows = rows.withColumn("_token", F.when(some, located("random", TOKEN)).otherwise(F.expr("slice(_hex, 1, 0)")))
    rows = rows.withColumn("_token", F.expr(f"filter(_token, x -> transform(array(x.value), value -> {high})[0])"))
    rows = rows.withColumn("_random", F.expr(apart("_token", "_base")))
    return rows.withColumn("_all", ordered(F.concat("_assign", "_access", "_hex", "_random"), [*KINDS, "random"]))


def secret_scan(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, counts of the base kinds, n_random, has_secret, base_sha256 and spans (kind:start:end by start, then kind).

    Null and empty texts have no spans; the hash is then that of the empty string.  Repeated rows and null ids stay as they are.
    An empty table gives an empty result.
    """
    model = model or train(docs, id_col, text_col)
    return with_spans(picked(docs, id_col, text_col), model).select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.size("_random").cast("long").alias("n_random"),
        (F.size("_all") > 0).alias("has_secret"),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.col("_all")).alias("spans"),
    )


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", model: dict | None = None) -> DataFrame:
    """``docs`` with every secret replaced by [secret]; its columns as they were.

    ``length_col``, if there is one, becomes the new length where the text changed.  A null text stays null,
    an empty one empty; repeated rows and null ids stay as they are; an empty table gives an empty result.
    """
    model = model or train(docs, id_col, text_col)
    return replaced(docs, lambda rows: with_spans(rows, model), "[secret]", text_col, length_col)

"""Personal data by candidate gradient boosting, in SQL functions alone.

Base patterns (email, ip, card, phone) give their spans.  High-recall
generators propose further, overlapping spans: written-out addresses, runs of
digits with separators and runs of digits alone, of any length.  A candidate has
format features (count of digits, separators, check digit, at sign) and context
features (a telling word before it, letters touching it).  All features are
small integers, so training data is one row for each combination that occurs;
boosted regression trees on logistic loss are fitted to those counts and become
one SQL expression.

Training.  The candidates of all texts are labelled by the base patterns:
positive if they overlap a valid base span.  The plus sign and the exact lengths
that define the base patterns are left out of the features, so the trees carry
over to like spans that the patterns miss, while numbers that fail the check
digit or stand inside words and digests are the negatives.

Calibration.  The trees are fitted to one half of the texts (by a hash of the
text).  On the other half an isotonic regression, for each generator, turns
scores into the share of candidates that are right; a generator's cut is its
lowest score with a share of ``PRECISION`` or more, measured on the candidates at
that score.  Without such a score it adds nothing.  (Like spans that the base
patterns miss count as wrong, so true precision is higher.)  Of overlapping
candidates the best score stays.  Base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, picked
from tessera.llm.native import PLACE, apart, blocks, cut, let, located, maxima, ordered, quoted, replaced, touching, written

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, with look-behinds and possessive repeats in place of the
# plain form: the same leftmost matches, found in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: Generators of candidates.
GENERATORS = {
    "written": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)++",
    "spaced": r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "solid": r"(?<![0-9])[0-9]{7,}+",
}

PRECISION, LEAST_SUPPORT = 0.6, 5
TREES, DEPTH, RATE = 24, 3, 0.3
CONTEXT_CHARS = 24
CONTEXT = r"(?i)(?:phone|tel|call|fax|mobile|card|visa|iban|account|ssn|ip|host|mail|contact|kontakt|correo|courriel)[^A-Za-z]*$"

#: Features of a candidate, each a small integer, as SQL over x (kind, start, end, value) and the text; how an
#: address is written out is none, as only the plain way has labels.
FEATURES = {
    "digits": "case when x.d < 7 then 0 when x.d < 10 then 1 when x.d < 12 then 2 when x.d < 14 then 3 when x.d < 20 then 4 else 5 end",
    "parens": r"if(x.kind = 'written', 0, cast(x.value rlike '\\(' as int))",
    "dots": r"if(x.kind = 'written', 0, least(3, char_length(x.value) - char_length(replace(x.value, '.', ''))))",
    "hyphens": "if(x.kind = 'written', 0, least(2, char_length(x.value) - char_length(replace(x.value, '-', ''))))",
    "spaces": "if(x.kind = 'written', 0, least(3, char_length(x.value) - char_length(replace(x.value, ' ', ''))))",
    "check": "cast(x.d between 12 and 19 and luhn_check(regexp_replace(x.value, '[^0-9]', '')) as int)",
    "written": "cast(x.kind = 'written' as int)",
    "context": f"cast(x.before rlike {quoted(CONTEXT)} as int)",
    "inside": "cast(x.before rlike '[A-Za-z0-9_]$' or x.after rlike '^[A-Za-z0-9_]' as int)",
}


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds _email, _ip, _card, _phone: spans of the base kinds, failing matches dropped."""
    digits = "char_length(regexp_replace(x.value, '[^0-9]', ''))"
    parts = quoted("^" + r"\.".join([PART] * 4) + "$")
    return (
        rows.withColumn("_email", located("email", EMAIL, guard="@"))
        .withColumn("_ip", located("ip", IP)).withColumn("_card", located("card", CARD)).withColumn("_phone", located("phone", PHONE, guard="+"))
        .withColumn("_ip", F.expr(f"filter(_ip, x -> x.value rlike {parts})"))
        .withColumn("_card", F.expr("filter(_card, x -> luhn_check(regexp_replace(x.value, '[\\\\x20-]', '')))"))
        .withColumn("_phone", F.expr(f"filter(_phone, x -> {digits} between 10 and 15)"))
        .withColumn("_base", F.concat(*[f"_{k}" for k in KINDS]))
    )


def candidates(rows: DataFrame) -> DataFrame:
    """Adds _found by start: candidate spans (kind: their generator) with their features f and whether they overlap a base span."""
    context = (
        f"named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'value', x.value, 'd', char_length(regexp_replace(x.value, '[^0-9]', '')), "
        f"'before', {cut('pieces', f'greatest(0, x.start - {CONTEXT_CHARS})', 'x.start')}, 'after', {cut('pieces', 'x.end', 'least(x.end + 1, size)')})"
    )
    features = ", ".join(f"'{k}', {v}" for k, v in FEATURES.items())
    for kind, pattern in GENERATORS.items():
        rows = rows.withColumn(f"_{kind}", located(kind, pattern))
    described = let("pieces", blocks("text"), let("size", "char_length(text)", f"transform(_raw, x -> {context})"))
    featured = f"transform(_described, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'f', named_struct({features})))"
    labelled = f"transform({touching('_featured', '_base')}, x -> named_struct('kind', x.span.kind, 'start', x.span.start, 'end', x.span.end, 'f', x.span.f, 'touched', x.touched))"
    return (
        rows.withColumn("_raw", F.concat(*[f"_{kind}" for kind in GENERATORS]))
        .withColumn("_described", F.expr(f"if(size(_raw) = 0, null, {described})"))
        .withColumn("_featured", F.expr(featured))
        .withColumn("_found", F.expr(f"if(size(_raw) = 0, null, {labelled})"))
    )


def scanned(rows: DataFrame) -> DataFrame:
    """Rows with ``text``, their base spans and their candidates (null for none)."""
    return candidates(base_spans(rows))


# -- boosted trees over feature combinations (driver; as many rows as there are combinations) --


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def grown(cells: list[dict], depth: int) -> dict:
    """A regression tree on the cells' gradients g and curvatures h."""
    g, h = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    leaf = {"value": RATE * g / (h + 1.0)}
    if depth == 0 or len(cells) < 2:
        return leaf
    best = None
    for name in FEATURES:
        for cut in sorted({c[name] for c in cells})[:-1]:
            left = [c for c in cells if c[name] <= cut]
            lg, lh = sum(c["g"] for c in left), sum(c["h"] for c in left)
            gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = (gain, name, cut)
    if best is None:
        return leaf
    _, name, cut = best
    return {
        "name": name,
        "cut": cut,
        "left": grown([c for c in cells if c[name] <= cut], depth - 1),
        "right": grown([c for c in cells if c[name] > cut], depth - 1),
    }


def value_of(tree: dict, cell: dict) -> float:
    while "name" in tree:
        tree = tree["left"] if cell[tree["name"]] <= tree["cut"] else tree["right"]
    return tree["value"]


def sql_of(tree: dict) -> str:
    if "name" not in tree:
        return f"{tree['value']:.15f}D"
    return f"if(x.f.{tree['name']} <= {tree['cut']}, {sql_of(tree['left'])}, {sql_of(tree['right'])})"


def fit(cells: list[dict]) -> dict:
    """Trees from the cells of the first half, cuts from those of the second; a cell has kind, half, features, n and positive counts."""
    mine = [c for c in cells if c["half"] == 0]
    n, positive = sum(c["n"] for c in mine), sum(c["positive"] for c in mine)
    start = math.log((positive + 1) / (n - positive + 1))
    mine = [c | {"score": start} for c in mine]
    trees = []
    for _ in range(TREES if mine else 0):
        for c in mine:
            p = sigmoid(c["score"])
            c["g"], c["h"] = c["positive"] - c["n"] * p, c["n"] * p * (1 - p)
        trees.append(grown(mine, DEPTH))
        for c in mine:
            c["score"] += value_of(trees[-1], c)
    model = {"trees": trees, "start": start, "least": {}}
    for kind in GENERATORS:
        points = [(score_of(model, c), c["positive"], c["n"]) for c in cells if c["half"] == 1 and c["kind"] == kind]
        model["least"][kind] = calibrated(points)
    return model


def score_of(model: dict, cell: dict) -> float:
    return model["start"] + sum(value_of(t, cell) for t in model["trees"])


def calibrated(points: list[tuple[float, int, int]]) -> float | None:
    """The lowest score (of score, positive, n) where an isotonic regression of the share of positives reaches PRECISION; None without."""
    pools: list[list] = []  # [lowest score, positive, n], shares not falling
    for score, positive, n in sorted(points):
        if pools and score - pools[-1][3] < 1e-9:
            pools[-1][1:] = [pools[-1][1] + positive, pools[-1][2] + n, score]
        else:
            pools.append([score, positive, n, score])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, p, m, top = pools.pop()
            pools[-1][1:] = [pools[-1][1] + p, pools[-1][2] + m, top]
    # a pool of a few candidates proves little: it needs the support of those above it
    supported, above = [], 0
    for pool in reversed(pools):
        above += pool[2]
        if pool[1] >= PRECISION * pool[2] and above >= LEAST_SUPPORT:
            supported.append(pool[0])
    return min(supported, default=None)


def train_on(found: DataFrame) -> dict:
    """The model from rows with _found and half (0 or 1): one row a combination of features reaches the driver."""
    seen = found.where("_found is not null").select("half", F.explode("_found").alias("x")).select("half", "x.kind", "x.f", F.col("x.touched").cast("int").alias("positive"))
    cells = seen.groupBy("kind", "half", "f").agg(F.count("*").alias("n"), F.sum("positive").alias("positive"))
    return fit([r.asDict() for r in cells.select("kind", "half", "f.*", "n", "positive").orderBy("kind", "half", *FEATURES).collect()])


def half() -> object:
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    return train_on(scanned(picked(docs, id_col, text_col)).select("_found", half()))


def score(model: dict) -> str:
    """The trees' sum for a candidate x, as SQL."""
    return " + ".join([f"{model['start']:.15f}D", *(sql_of(t) for t in model["trees"])])


def best_apart(spans: str) -> str:
    """Spans (start, end, score) without overlaps, taken by falling score; each cluster of overlapping spans on its own."""
    picked_of = f"""aggregate(array_sort(transform(near, x -> named_struct('cost', -x.score, 'start', x.start, 'end', x.end))), cast(array() as array<{PLACE}>),
      (kept, x) -> if(exists(kept, y -> x.start < y.end and y.start < x.end), kept, concat(kept, array(named_struct('kind', 'candidate', 'start', x.start, 'end', x.end)))))"""
    clusters = f"transform(heads, (head, i) -> {let('near', 'slice(line, head + 1, coalesce(get(heads, i + 1), size(line)) - head)', picked_of)})"
    heads = "filter(sequence(0, size(line) - 1), i -> i = 0 or line[i].start >= far[i - 1])"
    body = let("line", f"array_sort({spans})", let("far", maxima("transform(line, x -> x.end)"), let("heads", heads, f"flatten({clusters})")))
    return f"if(size({spans}) = 0, cast(array() as array<{PLACE}>), {body})"


def chosen(rows: DataFrame, model: dict) -> DataFrame:
    """Adds _more (spans that the trees select) and _base and _all by start, then kind, to scanned rows."""
    cuts = [f"when '{k}' then {v - 1e-9:.15f}D" for k, v in model["least"].items() if v is not None]
    if cuts:
        good = f"filter(_found, x -> not x.touched and ({score(model)}) >= case x.kind {' '.join(cuts)} end)"
        high = f"transform({good}, x -> named_struct('start', x.start, 'end', x.end, 'score', {score(model)}))"
        rows = rows.withColumn("_high", F.expr(f"if(_found is null, null, {high})"))
        rows = rows.withColumn("_more", F.expr(f"if(_high is null, cast(array() as array<{PLACE}>), {best_apart('_high')})"))
    else:
        rows = rows.withColumn("_more", F.expr(f"cast(array() as array<{PLACE}>)"))
    places = F.transform("_base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.withColumn("_all", ordered(F.concat(places, "_more"), [*KINDS, "candidate"])).withColumn("_base", ordered(F.col("_base"), KINDS))


def pii_scan(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, counts of the base kinds, n_more (spans added by the trees), has_pii, base_sha256 and spans (kind:start:end by start, then kind).

    Null and empty texts have no spans; the hash is then that of the empty string.  Repeated rows and null ids stay as they are.
    An empty table gives an empty result.  Texts are scanned once: spans and candidates are settled, fitted to and selected from.
    """
    places = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias(c)
    found = scanned(picked(docs, id_col, text_col)).select("doc_id", half(), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], places("_base"), "_found")
    if model is None:
        found = materialize(found, "pii")
        model = train_on(found)
    return chosen(found, model).select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.size("_more").cast("long").alias("n_more"),
        (F.size("_all") > 0).alias("has_pii"),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.col("_all")).alias("spans"),
    )


def redact(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every selected span replaced by [private]; its columns as they were.

    ``length_col``, if there is one, becomes the new length where the text changed.  A null text stays null,
    an empty one empty; repeated rows and null ids stay as they are; an empty table gives an empty result.
    """
    model = model or train(docs, id_col, text_col)
    return replaced(docs, lambda rows: chosen(scanned(rows), model), "[private]", text_col, length_col)

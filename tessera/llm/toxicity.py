"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings; a feature counts c / sqrt(n) in a text
of n words, so that one insult weighs much in a short text and an occasional
look-alike little in a long one.  The model is P(grade >= k) = s(x . w - t_k)
with one weight vector for all thresholds t_1 < t_2 < ...; the expected severity
is the sum of these probabilities over k.

Labels may hold ordered grades.  Where they hold only 0 and 1, the toxic
training rows are graded 1 to 3 by terciles of their share of marker words
(features much likelier in toxic rows), so that severity orders them.

As x is linear in the words, a word's features sum to one number: scoring is
one lookup a word in a table that each task fills as it meets words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import bound_batches, map_texts, picked
from tessera.llm.decontaminate import words_of
from tessera.llm.labelled import labelled_sample

#: Bounds of the training sample: rows and characters a grade.
PER_CLASS, CHARS = 2500, 8_000_000
#: Features kept, fewest toxic rows with a feature, and lengths of the word beginnings in bytes.
FEATURES, MIN_ROWS, BEGINNINGS = 4000, 4, (4, 5, 6, 7, 8)
THRESHOLD = 0.35
CACHE_SIZE = 1 << 18


def features_of(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: dict[bytes, float]
    cuts: list[float]

    def word_scores(self) -> dict[bytes, float]:
        weights = self.weights

        class Scores(dict):
            def __missing__(self, word):
                if len(self) >= CACHE_SIZE:
                    self.clear()
                score = self[word] = sum(weights.get(f, 0.0) for f in features_of(word))
                return score

        return Scores()

    def grades(self, text: str, scores: dict[bytes, float]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        words = words_of(text)
        x = sum([scores[w] for w in words]) / np.sqrt(len(words)) if words else 0.0
        return sigmoid(x - np.array(self.cuts))


def counted(text: str, known) -> dict[bytes, int]:
    """Counts of a text's features that are in ``known`` (all for None)."""
    out: dict[bytes, int] = {}
    for word, n in Counter(words_of(text)).items():
        for f in features_of(word):
            if known is None or f in known:
                out[f] = out.get(f, 0) + n
    return out


def select(sample: list[tuple[str, int]]) -> tuple[list[bytes], np.ndarray]:
    """Features by the size of their log odds ratio against its standard error, and these scores.

    Only counts of rows are held: first of the toxic rows, then, for the features that enough of them have, of the others.
    """
    a: dict[bytes, int] = {}
    na = nb = 0
    for text, grade in sample:
        if grade > 0:
            na += 1
            for f in counted(text, None):
                a[f] = a.get(f, 0) + 1
    a = {f: n for f, n in a.items() if n >= MIN_ROWS}
    b = dict.fromkeys(a, 0)
    for text, grade in sample:
        if grade <= 0:
            nb += 1
            for f in counted(text, b):
                b[f] += 1
    names = sorted(a)
    if not names:
        return [], np.zeros(0)
    x, y = np.array([a[f] for f in names]) + 0.5, np.array([b[f] for f in names]) + 0.5
    odds = np.log(x / (na + 1 - x)) - np.log(y / (nb + 1 - y))
    z = odds / np.sqrt(1 / x + 1 / (na + 1 - x) + 1 / y + 1 / (nb + 1 - y))
    order = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    return [names[i] for i in order], z[order]


def fit(sample: list[tuple[str, int]], counts: dict[int, int], steps: int = 400, ridge: float = 5e-5) -> Model:
    """Weights and cuts by full-batch Adam; rows weigh so that grades have their shares among all labels."""
    if len({g for _, g in sample}) < 2:
        return Model({}, [0.0 if any(g for _, g in sample) else 30.0])
    grade = np.array([g for _, g in sample])
    toxic = grade > 0
    names, z = select(sample)
    column = {f: k for k, f in enumerate(names)}
    rows = range(len(sample))
    entries: list[list[int]] = [[], [], []]
    for k, (text, _) in enumerate(sample):
        for f, n in counted(text, column).items():
            entries[0].append(k)
            entries[1].append(column[f])
            entries[2].append(n)
    r, c, v = (np.array(e, np.int64) for e in entries)
    size = np.array([max(1, len(words_of(t))) for t, _ in sample], float)
    x = v / np.sqrt(size)[r] if len(r) else np.zeros(0)
    share = np.array([counts.get(int(g), 1) for g in grade]) / np.array([np.sum(grade == g) for g in grade])
    if grade.max() == 1:  # only 0 and 1: grades by terciles of marker share
        markers = z > 4
        dense = np.bincount(r, v * markers[c], len(rows)) / size if len(r) else np.zeros(len(rows))
        cut = np.quantile(dense[toxic], [1 / 3, 2 / 3])
        grade = np.where(toxic, 1 + (dense > cut[0]) + (dense > cut[1]), 0)
    top = int(grade.max())
    w, cuts = np.zeros(len(names)), np.linspace(1.0, 4.0, top)
    weight = share / share.sum()
    params = np.concatenate([w, [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, s = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[: len(names)], np.exp(params[len(names) + 1 :])
        cuts = params[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(r, x * w[c], len(rows)) if len(r) else np.zeros(len(rows))
        p = sigmoid(eta[:, None] - cuts)
        # d log P(grade) / d eta of a cumulative logit: 1 - P(>= grade) - P(>= grade + 1)
        ext = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
        hi, lo = ext[np.arange(len(p)), grade], ext[np.arange(len(p)), grade + 1]
        d_eta = 1 - hi - lo
        prob = np.maximum(hi - lo, 1e-9)
        d_cut = np.zeros_like(p)  # of log P by each cut
        k = np.arange(len(p))
        dens = lambda q: q * (1 - q)
        low = grade >= 1
        d_cut[k[low], grade[low] - 1] -= dens(hi[low]) / prob[low]
        up = grade < top
        d_cut[k[up], grade[up]] += dens(lo[up]) / prob[up]
        g_w = -np.bincount(c, x * (weight * d_eta)[r], len(names)) + ridge * w if len(r) else ridge * w
        g_cut = -(weight[:, None] * d_cut).sum(0)
        g_gap = np.array([g_cut[j + 1 :].sum() for j in range(top - 1)]) * gaps if top > 1 else np.zeros(0)
        g = np.concatenate([g_w, [g_cut.sum()], g_gap])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        rate = 0.3 if step < steps * 0.7 else 0.05
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-10)
    w = params[: len(names)]
    cuts = params[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(params[len(names) + 1 :]))])
    return Model({f: float(q) for f, q in zip(names, w, strict=True) if abs(q) > 1e-4}, [float(t) for t in cuts])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", **columns) -> Model:
    return fit(*labelled_sample(docs, labels, label, PER_CLASS, CHARS, **columns))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, severity (expected grade), p_toxic (of grade 1 or more), grade (likeliest), toxic.

    A text without words (null, empty, white space) gets the severity of no evidence. Repeated rows and null ids stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def make():
        model = held.value
        scores = model.word_scores()

        def work(texts):
            out = []
            for t in texts:
                p = model.grades(t, scores)
                each = -np.diff(np.concatenate([[1.0], p, [0.0]]))
                out.append((float(p.sum()), float(p[0]), int(each.argmax()), bool(p[0] >= threshold)))
            return out

        return work

    return map_texts(picked(docs, id_col, text_col), make, "severity double, p_toxic double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns) -> DataFrame:
    return score(docs, train(docs, labels), threshold, **columns)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the toxic rows; its columns as they were (whatever their names).  No shuffle.

    A null, empty or wordless text has no evidence and stays; repeated rows and null ids stay or go like any; an empty table stays empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = held.value
        scores = model.word_scores()
        for batch in batches:
            fine = [model.grades(t or "", scores)[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

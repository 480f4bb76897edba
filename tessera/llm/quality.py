"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the
whole text is encoded: means of word-form features (length, case, marks,
digits, 16 hashed word shapes) and its repetition (distinct words, words equal
to the one before, word triples the text had earlier), then one learned tanh
layer.  Gated attention, softmax of w . (tanh(V h) * s(U h)), weighs a
document's passages; the weighted sum is scored by a logistic layer.  All
weights are learned together from document labels alone.

Labels come from a bounded sample of rows outside the held-out fold
(crc32 of the id modulo 4 is 2).  Label, language, source and id are no inputs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, picked
from tessera.llm.labelled import held_out, labelled_sample

PASSAGE = 64
#: Bounds of the training sample: rows and characters a label.
PER_CLASS, CHARS = 3000, 8_000_000
SHAPES, FORMS = 16, 10
HIDDEN, GATES = 24, 12
THRESHOLD = 0.7
CACHE_SIZE = 1 << 17
MARKS = frozenset(b"#*$%&|<>@^~_=\\{}[]")

# One byte a character: u and l for upper and lower letters, d for digits, marks and white space as they are.
# Of a longer UTF-8 sequence the first byte goes; each other byte counts as a letter, upper where Latin capitals have it.
FIRST_BYTES = bytes(range(0xC0, 0x100))
KINDS = bytes(
    ord("u") if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else ord("l") if 0x61 <= b <= 0x7A or b >= 0x9F else ord("d") if 0x30 <= b <= 0x39 else b
    for b in range(256)
)


def word_form(kinds: bytes) -> np.ndarray:
    """Features of a word from the kinds of its characters."""
    n = len(kinds)
    shape = bytes(k for i, k in enumerate(kinds[:64]) if not i or k != kinds[i - 1])
    upper, lower = kinds.count(b"u"), kinds.count(b"l")
    out = np.zeros(FORMS + SHAPES, np.float32)
    out[:FORMS] = (
        min(n, 40) / 10,
        any(k in MARKS for k in kinds),
        b"!" in kinds,
        n > 1 and upper > 0 and not lower,
        not upper and not lower,
        kinds.count(b"d") / n,
        lower > 0,
        kinds.startswith(b"u"),
        kinds.endswith((b".", b",", b";", b":", b"?")),
        min(n, 400) / 40 if n > 40 else 0.0,
    )
    out[FORMS + zlib.crc32(shape[:8]) % SHAPES] = 1
    return out


class Encoder:
    """Passage features of texts; remembers word forms between texts."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.forms = np.zeros((1024, FORMS + SHAPES), np.float32)

    def row(self, kinds: bytes) -> int:
        k = self.rows.get(kinds)
        if k is None:
            k = self.rows[kinds] = len(self.rows)
            if k >= len(self.forms):
                self.forms = np.concatenate([self.forms, np.zeros_like(self.forms)])
            self.forms[k] = word_form(kinds)
        return k

    def encode(self, text: str) -> np.ndarray:
        """(passages, features); one all-zero passage for a text without words."""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        if not n:
            return np.zeros((1, FORMS + SHAPES + 5), np.float32)
        if len(self.rows) > CACHE_SIZE:
            self.rows.clear()
        row = self.row
        forms = [row(kinds) for kinds in raw.translate(KINDS, FIRST_BYTES).split()]
        ids = np.fromiter(map(hash, words), np.int64, n)
        starts = np.arange(0, n, PASSAGE)
        if len(starts) > 1 and n - starts[-1] < PASSAGE // 4:
            starts = starts[:-1]  # a short rest joins the passage before
        sizes = np.diff(np.append(starts, n)).astype(np.float32)
        sums = np.add.reduceat(self.forms[forms], starts)
        same = np.zeros(n, np.float32)
        same[1:] = ids[1:] == ids[:-1]
        seen = np.zeros(n, np.float32)
        if n > 2:
            triple = (ids[:-2] * 1000003 + ids[1:-1]) * 1000003 + ids[2:]
            _, first = np.unique(triple, return_index=True)
            seen[2:] = 1
            seen[first + 2] = 0
        passage = np.minimum(np.arange(n) // PASSAGE, len(starts) - 1)
        _, distinct = np.unique(ids * 1000003 + passage, return_index=True)
        extra = np.stack([
            np.bincount(passage[distinct], minlength=len(starts)) / sizes,
            np.add.reduceat(same, starts) / sizes,
            np.add.reduceat(seen, starts) / sizes,
            np.minimum(sizes / PASSAGE, 1.0),
            np.ones(len(starts)),
        ], 1)
        return np.concatenate([sums / sizes[:, None], extra], 1).astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray, count: int) -> dict[str, np.ndarray]:
        """x: passages of ``count`` bags; bags: the ascending bag of each, none empty."""
        p = self.layers
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["wb"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        starts = np.searchsorted(bags, np.arange(count))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bags])
        alpha = e / np.add.reduceat(e, starts)[bags]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "y": sigmoid(z @ p["c"] + p["b"][0]), "starts": starts}


def fit(sample: list[tuple[str, int]], counts: dict[int, int], epochs: int = 60, seed: int = 7) -> Model:
    encoder, rng = Encoder(), np.random.default_rng(seed)
    bags = [encoder.encode(t) for t, _ in sample]
    d = FORMS + SHAPES + 5
    init = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    p = {"w": init(d, HIDDEN), "wb": np.zeros(HIDDEN), "v": init(HIDDEN, GATES), "u": init(HIDDEN, GATES),
         "a": rng.normal(0, 0.3, GATES), "c": np.zeros(HIDDEN), "b": np.zeros(1)}
    if not bags:
        return Model(np.zeros(d), np.ones(d), p)
    flat = np.concatenate(bags)
    model = Model(flat.mean(0), flat.std(0) + 0.05, p)
    y = np.array([min(1, g) for _, g in sample], float)
    n0, n1 = counts.get(0, 0), sum(n for g, n in counts.items() if g > 0)
    weight = np.where(y > 0, n1 / max(1, (y > 0).sum()), n0 / max(1, (y == 0).sum()))
    weight /= weight.mean()
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            x = np.concatenate([bags[i] for i in some])
            bag = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
            f = model.forward(x, bag, len(some))
            dl = (f["y"] - y[some]) * weight[some] / len(some)
            dz = dl[:, None] * p["c"]
            dh = f["alpha"][:, None] * dz[bag]
            da = (dz[bag] * f["h"]).sum(1)
            de = f["alpha"] * (da - np.add.reduceat(f["alpha"] * da, f["starts"])[bag])
            dtg = de[:, None] * p["a"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = dh + dt @ p["v"].T + dg @ p["u"].T
            dx = dh * (1 - f["h"] ** 2)
            grads = {"c": f["z"].T @ dl, "b": np.array([dl.sum()]), "a": (f["t"] * f["g"]).T @ de, "v": f["h"].T @ dt,
                     "u": f["h"].T @ dg, "w": f["x"].T @ dx, "wb": dx.sum(0)}
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k, g in grads.items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def predict(model: Model, encoder: Encoder, texts: list[str]) -> np.ndarray:
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 256):
        bags = [encoder.encode(t) for t in texts[at : at + 256]]
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        out.append(model.forward(np.concatenate(bags), bag, len(bags))["y"])
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", **columns) -> Model:
    return fit(*labelled_sample(docs, labels, label, PER_CLASS, CHARS, **columns))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    A text without words (null, empty, white space) is one passage without features and scored like any.
    Repeated rows and null ids (never held out) stay as they are; without labels all scores are 0.5.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def make():
        model, encoder = held.value, Encoder()

        def work(texts):
            return [(float(y), int(y >= threshold)) for y in predict(model, encoder, texts)]

        return work

    found = map_texts(picked(docs, id_col, text_col), make, "score double, predicted int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns) -> DataFrame:
    return score(docs, train(docs, labels), threshold, **columns)

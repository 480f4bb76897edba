"""Quality rules by repetition coverage.

Method.  Rolling polynomial hashes (numpy, arithmetic modulo 2^64 over per-text
word numbers) of several n-gram lengths find the n-grams that occur twice or
more in a text; coverage is the share of word characters inside at least one
such n-gram, and the share of line characters inside repeated lines.  Word
numbers are exact, and windows with equal hashes are compared with the first
of them, so a coincidence of hashes cannot add coverage.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import map_texts, picked

SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Largest allowed share of characters inside repeated n-grams, by length (fixed values, from published web-corpus rules).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest allowed share of characters inside repeated lines.
LINE_LIMIT = 0.20
#: Fewest words, and the largest share of words in repeated 3-word windows, in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each window of n word numbers."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + ids[k : len(ids) - n + 1 + k]
    return h


def repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """Marks the words inside an n-word window that the text has twice or more."""
    out = np.zeros(len(ids) + 1, np.int64)
    if len(ids) > n:
        h = windows(ids, n)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            starts = np.nonzero(np.concatenate(([True], ~same)))[0]
            first = order[np.repeat(starts, np.diff(np.append(starts, len(order))))]
            again = first != order
            rows, firsts = order[again], first[again]
            true = np.ones(len(rows), bool)
            for k in range(n):
                true &= ids[rows + k] == ids[firsts + k]
            if not true.all():  # a coincidence of hashes: exact comparison of all windows
                seen: dict[bytes, int] = {}
                flat = np.lib.stride_tricks.sliding_window_view(ids, n)
                pairs = [(i, seen.setdefault(w.tobytes(), i)) for i, w in enumerate(flat)]
                rows, firsts = np.array([p for p in pairs if p[0] != p[1]] or np.zeros((0, 2)), np.int64).T
                true = np.ones(len(rows), bool)
            hit = np.unique(np.concatenate((rows[true], firsts[true])))
            out[hit] += 1
            out[hit + n] -= 1
    return np.cumsum(out[:-1]) > 0


def measure(text: str) -> dict:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = np.array([len(w) for w in words], np.int64)
    if not raw.isascii():
        chars = np.array([len(w.decode("utf-8", "surrogatepass")) for w in words], np.int64)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    total = int(chars.sum())
    lines: set[str] = set()
    n_dup = dup_chars = line_chars = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.encode("utf-8", "surrogatepass").split():
                line_chars += len(line)
                if line in lines:
                    n_dup += 1
                    dup_chars += len(line)
                else:
                    lines.add(line)
    cover = {n: float(chars[repeated(ids, n)].sum() / total) if len(words) > n else 0.0 for n in NGRAM_LIMITS}
    return {
        "n_words": len(words),
        "word_chars": total,
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": n_dup,
        "n_repeat_words": int(repeated(ids, 3).sum()),
        "line_coverage": dup_chars / line_chars if line_chars else 0.0,
        "coverage": cover,
    }


def verdict(m: dict) -> tuple[bool, bool]:
    failed = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]
    kept = not failed and m["line_coverage"] <= LINE_LIMIT and all(m["coverage"][n] / x <= 1 for n, x in NGRAM_LIMITS.items())
    return failed, kept


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the base counts, base_failed, kept, the line coverage and the worst n-gram coverage against its limit.

    A text without words (null, empty, white space) has zero counts and fails. Repeated rows and null ids stay as they are.
    """

    def make():
        def work(texts):
            out = []
            for t in texts:
                m = measure(t)
                failed, kept = verdict(m)
                worst = max(m["coverage"][n] / x for n, x in NGRAM_LIMITS.items())
                out.append((m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], failed, kept, m["line_coverage"], worst))
            return out

        return work

    return map_texts(
        picked(docs, id_col, text_col),
        make,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, ngram_coverage_of_limit double",
    )


def oracle() -> str:
    """The same in DuckDB."""
    lengths = [3, *NGRAM_LIMITS]
    limits = ", ".join(f"({n}, {x}::DOUBLE)" for n, x in NGRAM_LIMITS.items())
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), grams AS (
  SELECT row, n, i, length(words[i]) AS chars, CASE WHEN i + n - 1 <= len(words) THEN array_to_string(words[i:i + n - 1], ' ') END AS gram
  FROM split, (SELECT unnest({lengths}) AS n), unnest(range(1, len(words) + 1)) AS t(i)
), counted AS (
  SELECT row, n, i, chars, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY row, n, gram) > 1 THEN i END AS hit FROM grams
), near AS (
  SELECT row, n, chars, i - max(hit) OVER (PARTITION BY row, n ORDER BY i ROWS UNBOUNDED PRECEDING) < n AS inside FROM counted
), covered AS (
  SELECT row, n, count(*) FILTER (inside) AS words_inside, coalesce(sum(chars) FILTER (inside), 0)::BIGINT AS chars_inside, sum(chars)::BIGINT AS chars FROM near GROUP BY ALL
), worst AS (
  SELECT row, max(chars_inside::DOUBLE / chars / x) AS worst FROM covered JOIN (VALUES {limits}) AS l(n, x) USING (n) GROUP BY row
), lines AS (
  SELECT row, line, count(*) AS k FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), repeats AS (
  SELECT row, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * length(line))::DOUBLE / sum(k * length(line)) AS line_coverage FROM lines GROUP BY row
), all_rows AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(c.chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.words_inside, 0) AS n_repeat_words, coalesce(line_coverage, 0) AS line_coverage, coalesce(worst, 0) AS worst
  FROM split LEFT JOIN (SELECT * FROM covered WHERE n = 3) c USING (row) LEFT JOIN repeats USING (row) LEFT JOIN worst USING (row)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM all_rows
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND line_coverage <= {LINE_LIMIT} AND worst <= 1 AS kept,
  line_coverage, worst AS ngram_coverage_of_limit FROM judged
"""

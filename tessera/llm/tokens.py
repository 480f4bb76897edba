"""Token counts by a map-side two-tier lookup.

A SentencePiece BPE never merges across a boundary that no vocabulary piece
spans.  Where no piece has a space mark after another character and none has a
line feed, a text's count is the sum over its pre-tokens (a run of spaces with
the characters up to the next space or line feed) plus one per line feed.
``Counter`` checks these conditions on the loaded vocabulary and encodes whole
texts where they do not hold.

Tier 1 is a broadcast table of the lengths of frequent pre-tokens: at most
``table_size`` entries, taken from a bounded sample of texts (it affects speed
only, never a count).  Tier 2 is a cache in each Python worker, filled by
encoding what tier 1 misses.  Pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter as Tally

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, map_texts, picked

#: Entries of the broadcast table at most; with LONGEST this bounds it to a few MB.
TABLE_SIZE = 1 << 15
#: Pre-tokens over this many characters are encoded each time, neither tabled nor cached.
LONGEST = 48
#: Entries of a worker's cache before it starts anew.
CACHE_SIZE = 1 << 18
#: Share of rows and bytes of text that the table is drawn from, at most this many rows in expectation.
SAMPLE_ROWS = 2000
#: Pre-tokens that each task proposes for the table.
PROPOSED = 4096

RUN = re.compile(r" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    def __init__(self, model_file: str | None = None, table: dict[str, int] | None = None):
        """``model_file`` is a path on the machine that counts; None: where the vocabulary package has it there."""
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file or default_model())
        self.table = table or {}
        self.cache: dict[str, int] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        encoded = lambda s: self.sp.encode(s, out_type=str, num_threads=1)
        self.splits = (
            not any(re.search("[^▁]▁", p) or "\n" in p for p in pieces)
            and encoded("a  b\nc") == ["▁a", "▁", "▁b", "<0x0A>", "c"]  # spaces kept, a mark put first
            and encoded("ﬁ é ") == [*encoded("ﬁ"), *encoded("é ")]  # no normalisation
            and encoded("") == []
        )

    def encode(self, text: str) -> int:
        return len(self.sp.encode(text, num_threads=1))

    def miss(self, key: str) -> int:
        """key: a space and what follows it in the line, or a line feed and what follows up to a space."""
        n = 1 if key == " " else self.encode(key[1:]) if key[0] == " " else self.encode(key) - 1
        if len(key) <= LONGEST:
            if len(self.cache) >= CACHE_SIZE:
                self.cache.clear()
            self.cache[key] = n
        return n

    @staticmethod
    def pretokens(text: str) -> list[str]:
        """The keys of a text that is not empty; a line feed starts a key that counts the line feed too."""
        out: list[str] = []
        for k, line in enumerate(text.replace("▁", " ").split("\n")):
            parts = (" " + line if not k else line).split(" ")
            if k:
                out.append("\n" + parts[0])
            if "" in parts[1:]:
                out += RUN.findall((" " + line if not k else line)[len(parts[0]) :])
            else:
                out += [" " + p for p in parts[1:]]
        return out

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return self.encode(text)
        total, first, second, miss = 0, self.table.get, self.cache.get, self.miss
        for key in self.pretokens(text):
            n = first(key) or second(key)
            total += n if n is not None else miss(key)
        return total


def frequent(rows: DataFrame, model_file: str | None, sample_rows: int = SAMPLE_ROWS, size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of frequent pre-tokens of a sample of the texts; each task proposes at most PROPOSED, of which ``size`` stay."""
    count = rows.count()
    if not count:
        return {}
    bound_batches(rows.sparkSession)

    def propose(batches):
        seen: Tally = Tally()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(k for k in Counter.pretokens(text) if len(k) <= LONGEST)
            if len(seen) > 50 * PROPOSED:
                seen = Tally(dict(seen.most_common(10 * PROPOSED)))
        top = seen.most_common(PROPOSED)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["key", "n"])

    sampled = rows.select("text").where(F.rand(17) < min(1.0, sample_rows / count))
    top = (
        sampled.mapInArrow(propose, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "key").limit(size).collect()
    )
    counter = Counter(model_file)
    return {r["key"]: counter.miss(r["key"]) for r in top} if counter.splits else {}


def token_counts(
    docs: DataFrame, model_file: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row: doc_id, n_bytes (UTF-8), n_tokens (no begin, end or added tokens), over_limit (n_tokens > limit).

    Null and empty texts have 0 of both. Repeated rows and null ids stay as they are; an empty table gives an empty result.
    """
    rows = picked(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent(rows, model_file))

    def make():
        counter = Counter(model_file, table.value)

        def work(texts):
            out = []
            for t in texts:
                n = counter.count(t)
                out.append((len(t.encode("utf-8", "surrogatepass")), n, n > limit))
            return out

        return work

    return map_texts(rows, make, "n_bytes long, n_tokens long, over_limit boolean")

"""Licence scans by a generalised suffix automaton of template words.

Method.  All templates (and the base phrases) go into one generalised suffix
automaton over words.  A text streams through it once; the automaton gives the
matching statistics: at each word the longest run ending there that some
template contains.  Maximal long runs are chained, in text and template order,
into covered template spans; a template's label is given where the chain covers
enough of it.  Base phrases are read off the same automaton: a phrase ends at a
word if its state is on the suffix-link path and the run is long enough.

State is the automaton alone (its size is bounded by the templates'); a text
costs time in proportion to its length.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame

from tessera.llm.common import map_texts, picked

# Base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Licence wordings, quoted from the public licence texts and their usual notices.
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0"),
    ("apache-notice", "licensed under the apache license version 2.0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-work", "this work is licensed under the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit-notice", "released under the mit license"),
]

#: Fewest words of a run that enters a chain, most text words between two runs of a chain, and the share of a template that gives its label.
MIN_RUN, MAX_GAP, MIN_COVER = 4, 12, 0.75

TABLE = bytes(
    (b + 32) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of characters other than ASCII ones outside 0-9 and a-z."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton over integer words."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            state = 0
            for at, word in enumerate(sequence):
                state = self.extend(state, word)
                self.ends[state].add((k, at + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def new(self, length: int, source: int | None = None) -> int:
        self.next.append({} if source is None else dict(self.next[source]))
        self.link.append(-1 if source is None else self.link[source])
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def split(self, state: int, word: int) -> int:
        """The state for ``state``'s longest run with ``word``, parted from longer runs that shared it."""
        goal = self.next[state][word]
        if self.length[goal] == self.length[state] + 1:
            return goal
        copy = self.new(self.length[state] + 1, goal)
        self.link[goal] = copy
        while state >= 0 and self.next[state].get(word) == goal:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self.split(last, word)
        state = self.new(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        self.link[state] = 0 if last < 0 else self.split(last, word)
        return state


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        named = [*((label, text) for text, label in phrases), *templates]
        texts = [words_of(text) for _, text in named]
        self.vocabulary: dict[bytes, int] = {}
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in texts]
        self.labels = [label for label, _ in named]
        self.sizes = [len(s) for s in sequences]
        self.n_phrases = len(phrases)
        self.auto = Automaton(sequences)
        # phrases whose state lies on a state's suffix-link path: (words, phrase)
        own = defaultdict(list)
        for k in range(self.n_phrases):
            state = 0
            for w in sequences[k]:
                state = self.auto.next[state][w]
            own[state].append((self.sizes[k], k))
        self.phrases_at: list[list[tuple[int, int]]] = []
        for state in range(len(self.auto.length)):
            found, up = [], state
            while up > 0:
                found += own.get(up, [])
                up = self.auto.link[up]
            self.phrases_at.append(found)

    def runs(self, words: list[bytes]):
        """Matching statistics: yields (end, length, state) after each word that some template has."""
        get, step, link, size = self.vocabulary.get, self.auto.next, self.auto.link, self.auto.length
        state = length = 0
        for at, word in enumerate(map(get, words), 1):
            if word is None:
                state = length = 0
                continue
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step[state].get(word)
            if to is None:
                continue
            state, length = to, length + 1
            yield at, length, state

    def scan(self, text: str) -> dict:
        words = words_of(text)
        base: list[tuple[int, int]] = []
        maximal: list[tuple[int, int, int]] = []
        held: tuple[int, int, int] | None = None
        for end, length, state in self.runs(words):
            for n, k in self.phrases_at[state]:
                if length >= n:
                    base.append((end - n, k))
            if held and not (end == held[0] + 1 and length == held[1] + 1) and held[1] >= MIN_RUN:
                maximal.append(held)
            held = (end, length, state)
        if held and held[1] >= MIN_RUN:
            maximal.append(held)
        spans = self.chains(maximal)
        covered = max([s[3] for s in spans], default=0.0)
        starts = [b[0] for b in base]
        base_labels = {self.labels[k] for _, k in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | {s[0] for s in spans if s[3] >= MIN_COVER})),
            "score": 1.0 if base else covered,
            "spans": spans,
        }

    def chains(self, maximal: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, covered share) of each chain of runs; linear in the runs and their template places."""
        done: list[tuple[int, int, int, int]] = []
        live: dict[int, tuple[int, int, int, int]] = {}  # template: text start, text end, template end, words covered
        for end, length, state in maximal:
            for k, place in sorted(self.auto.ends[state]):
                if k < self.n_phrases:
                    continue
                start, template_start = end - length, place - length
                chain = live.get(k)
                overlap = max(0, chain[1] - start, chain[2] - template_start) if chain else 0
                if chain and start - chain[1] <= MAX_GAP and place > chain[2] and end > chain[1] and overlap < length:
                    live[k] = (chain[0], end, place, chain[3] + length - overlap)
                elif chain is None or start >= chain[1] or length > chain[3]:
                    if chain:
                        done.append((k, *chain[:2], chain[3]))
                    live[k] = (start, end, place, length)
        done += [(k, *chain[:2], chain[3]) for k, chain in live.items()]
        return [(self.labels[k], a, b, min(1.0, n / self.sizes[k])) for k, a, b, n in sorted(done, key=lambda x: (x[1], x[0]))]


def license_scan(docs: DataFrame, templates=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: word and base counts, labels, score and the covered spans (label:first:end:share, comma-joined).

    Null and empty texts have no words, no labels and score 0.  Repeated rows and null ids stay as they are.
    """
    templates = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(templates)

        def work(texts):
            out = []
            for t in texts:
                r = scanner.scan(t)
                spans = ",".join(f"{label}:{a}:{b}:{share:.3f}" for label, a, b, share in r["spans"])
                out.append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], spans))
            return out

        return work

    return map_texts(
        picked(docs, id_col, text_col),
        make,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string",
    )

"""Licence scan with a generalised suffix automaton over the words of licence templates.

The automaton accepts every word run of every template. Streaming a text through it gives, at each word,
the length of the longest run that ends there and occurs in some template (the matching statistics). Long
matches are placed in their templates, chained in order with bounded gaps, and a template counts as found
where a chain covers enough of it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidecast.llm.common import Held, Remembered, blob, kept, mapped

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Well-known passages of public licences, by label.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        "licensed under the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in "
        "compliance with the license you may obtain a copy of the license at",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        "licensed under the gnu general public license",
    ],
    "cc-by-nc": ["creative commons attribution noncommercial", "licensed under cc by nc"],
    "cc-by": ["this work is licensed under a creative commons attribution"],
}

# Separators become blanks and capitals small letters, so that words can be split off.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Suffix automaton of several sequences; each state knows its longest run and one place per sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # sequence -> ends of the state's runs in it
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, []).append(at + 1)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, ends in self.ends[state].items():
                if self.link[state] > 0:
                    above = self.ends[self.link[state]].setdefault(number, [])
                    above.extend(e for e in ends if e not in above)

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _redirect(self, state: int, word: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another sequence has this run already
            if self.length[known] == self.length[last] + 1:
                return known
            copy = self._copy(known, self.length[last] + 1)
            self.link[known] = copy
            self._redirect(last, word, known, copy)
            return copy
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.ends.append({})
        new, state = len(self.next) - 1, last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            if self.length[target] == self.length[state] + 1:
                self.link[new] = target
            else:
                copy = self._copy(target, self.length[state] + 1)
                self.link[target] = self.link[new] = copy
                self._redirect(state, word, target, copy)
        return new

    def statistics(self, sequence: list[int]):
        """(length, state) after every word: the longest run ending there that some template holds."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            yield length, state


class Scanner:
    """Finds phrases and templates in word lists."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], least: int, gap: int, cover: float):
        self.least, self.gap, self.cover = least, gap, cover
        self.phrases = [(words(p.encode()), label) for p, label in phrases.items()]
        listed = [(words(t.encode()), label) for label, texts in templates.items() for t in texts]
        self.labels = [label for _, label in self.phrases] + [label for _, label in listed]
        sequences = [w for w, _ in self.phrases] + [w for w, _ in listed]
        self.numbers: dict[bytes, int] = {}
        for sequence in sequences:
            for word in sequence:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton([[self.numbers[w] for w in s] for s in sequences])
        # a phrase ends where its own state is the state or lies above it
        own: dict[int, list[int]] = {}
        for phrase, (sequence, _) in enumerate(self.phrases):
            state = 0
            for word in sequence:
                state = self.automaton.next[state][self.numbers[word]]
            own.setdefault(state, []).append(phrase)
        self.here, self.above = own, {}
        for state in sorted(range(len(self.automaton.next)), key=lambda s: self.automaton.length[s]):
            up = self.automaton.link[state]
            found = [*self.above.get(up, ()), *own.get(up, ())] if up >= 0 else []
            if found:
                self.above[state] = found
        self.known = Remembered(lambda w: self.numbers.get(w, 0), 300_000)
        self.shortest = min([len(w) for w, _ in self.phrases] + [least])

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """(words, phrase places (start, phrase), spans (start, end, template, share covered))."""
        found = words(text)
        ids = np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))
        # only runs of template words can match; neighbouring runs are streamed one by one
        border = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
        begins, ends = border[::2], border[1::2]
        long = ends - begins >= self.shortest
        places, matches = [], []
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            run = ids[begin:end].tolist()
            seen = list(self.automaton.statistics(run))
            for i, (length, state) in enumerate(seen):
                at = begin + i + 1
                for phrase in self.above.get(state, ()):
                    places.append((at - self.sizes[phrase], phrase))
                for phrase in self.here.get(state, ()):
                    if length >= self.sizes[phrase]:
                        places.append((at - self.sizes[phrase], phrase))
                maximal = i + 1 == len(seen) or seen[i + 1][0] <= length
                if maximal and length >= self.least:
                    for template, stops in self.automaton.ends[state].items():
                        if template >= len(self.phrases):
                            matches += [(template, at - length, stop - length, length) for stop in stops]
        return len(found), sorted(places), self.chained(matches)

    def chained(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Join matches of a template that follow each other in text and template; keep well covered chains."""
        spans, open_ = [], {}
        for template, start, place, length in sorted(matches):
            chain = open_.get(template)
            if chain and start <= chain[1] + self.gap and place >= chain[2] - self.gap and place + length > chain[2]:
                fresh = min(length, place + length - chain[2])
                chain[1], chain[2], chain[3] = start + length, place + length, chain[3] + fresh
                continue
            if chain:
                spans.append((template, chain))
            open_[template] = [start, start + length, place + length, length]
        spans += list(open_.items())
        made = [(c[0], c[1], t, min(1.0, c[3] / self.sizes[t])) for t, c in spans]
        return sorted(s for s in made if s[3] >= self.cover)


def scanner_of(held: Held) -> Scanner:
    return kept("scanner", held, lambda: Scanner(**json.loads(held.raw)))


def scan(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES,
    least: int = 4, gap: int = 6, cover: float = 0.6,
) -> DataFrame:
    """(id, n_words, places, spans) per row.

    `places` lists where a phrase's words stand consecutively: (start, label), words from 0. `spans` lists
    covered template spans: (start, end, label, covered). Null and empty texts have no words and empty
    lists; repeated rows are scanned each; other columns are ignored; an empty table stays empty. The
    templates are a fixed list that travels with the task. Matches shorter than `least` words do not
    count, a chain may skip `gap` words, and must cover the share `cover` of its template.
    """
    held = Held(json.dumps({
        "phrases": phrases, "templates": templates, "least": least, "gap": gap, "cover": cover,
    }).encode())
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))

    def run(batches):
        for batch in batches:
            own = scanner_of(held)
            sizes, places, spans = [], [], []
            for value in batch.column(1).to_pylist():
                n, found, covered = own.scan(value)
                sizes.append(n)
                places.append([{"start": s, "label": own.labels[p]} for s, p in found])
                spans.append([{"start": a, "end": b, "label": own.labels[t], "covered": c} for a, b, t, c in covered])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(spans, span)],
                [id_column, "n_words", "places", "spans"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, blob(text)).transform(
        mapped, run,
        f"`{id_column}` {kind}, n_words bigint, places array<struct<start:bigint,label:string>>, "
        "spans array<struct<start:bigint,end:bigint,label:string,covered:double>>",
    )

"""Operator 4: licence scans with a generalised suffix automaton of licence words.

The automaton holds all word sequences of the templates. A file's words stream through it;
the state and length after each word are its matching statistics (the longest run of words
ending there that stands in some template). Matches of ``MIN_WORDS`` and more that can't be
extended are chained per template, in text order and template order with bounded gaps, and
a chain that covers enough of its template makes a span with the template's label. The
three base phrases are strings of the automaton too: one stands wherever its state is on
the suffix path of the current match.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import prepare, table, text_bytes

#: Phrases and labels of the contract.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices, grants and openings of public licence texts, lower-cased without marks, with the labels that their spans give.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
)
#: Shortest match that enters a chain, most words skipped between two, least covered share of a span's template.
MIN_WORDS = 4
MAX_GAP = 8
MIN_COVER = 0.75
#: Bytes of text whose words are held at a time.
BLOCK = 1 << 20

_WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        #: string number -> end places of the state's strings there
        self.ends: list[dict[int, set[int]]] = [{}]

    def _state(self, length: int, link: int, next_: dict) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.len.append(length)
        self.ends.append({})
        return len(self.len) - 1

    def _split(self, p: int, c, q: int) -> int:
        """State for the strings of q that extend p by c."""
        if self.len[p] + 1 == self.len[q]:
            return q
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, number: int, symbols) -> None:
        last = 0
        for place, c in enumerate(symbols):
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
            else:
                new, p = self._state(self.len[last] + 1, 0, {}), last
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p != -1:
                    self.link[new] = self._split(p, c, self.next[p][c])
                last = new
            self.ends[last].setdefault(number, set()).add(place)

    def finish(self) -> None:
        """Spread end places to all suffixes."""
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            up = self.ends[self.link[s]]
            for number, places in self.ends[s].items():
                up.setdefault(number, set()).update(places)

    def step(self, state: int, length: int, c) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base = [(tuple(p.encode().split()), label) for p, label in base]
        self.templates = [(tuple(t.encode().split()), label) for t, label in templates]
        self.sam = SuffixAutomaton()
        for i, (words, _) in enumerate(self.templates + self.base):
            self.sam.add(i, words)
        self.sam.finish()
        self.words = {w for words, _ in self.templates + self.base for w in words}
        phrase_at: dict[int, list[tuple[int, int]]] = {}
        for k, (words, _) in enumerate(self.base):
            state = 0
            for w in words:
                state = self.sam.next[state][w]
            phrase_at.setdefault(state, []).append((k, len(words)))
        #: per state: (phrase, words) of the phrases on its suffix path
        self.phrases: list[list[tuple[int, int]]] = []
        for s in range(len(self.sam.len)):
            out, p = [], s
            while p > 0:
                out += phrase_at.get(p, [])
                p = self.sam.link[p]
            self.phrases.append(out)

    def _words(self, text: bytes) -> Iterator[list[bytes]]:
        at = 0
        while at < len(text):
            to = at + BLOCK
            while to < len(text) and _WORD_BYTES[text[to]] != 32:
                to += 1
            yield text[at:to].translate(_WORD_BYTES).split()
            at = to

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """(words, base places as (phrase, first word), spans as (label, first word, last word, cover))."""
        step, known, phrases = self.sam.step, self.words, self.phrases
        n, state, length, before = 0, 0, 0, -2
        places: list[tuple[int, int]] = []
        found: list[tuple[int, int, int]] = []  # last word, length, state of matches that can't grow
        for block in self._words(text):
            for i, w in enumerate(block, n):
                if w not in known:
                    continue
                if i != before + 1:
                    if length >= MIN_WORDS:
                        found.append((before, length, state))
                    state = length = 0
                old, had = state, length
                state, length = step(state, length, w)
                if length <= had and had >= MIN_WORDS:
                    found.append((i - 1, had, old))
                before = i
                for k, size in phrases[state]:
                    if length >= size:
                        places.append((k, i - size + 1))
            n += len(block)
        if length >= MIN_WORDS:
            found.append((before, length, state))
        return n, places, self._chain(found)

    def _chain(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans per template: the chains that cover most, no two overlapping in the text.

        A match stands at every place that its words have in the template; a chain's matches
        ascend in text and template with bounded gaps, and each goes on from the predecessor
        that covers most.
        """
        spans = []
        per: dict[int, list[tuple[int, int, int, int]]] = {}
        for last, length, state in found:
            for number, ends in self.sam.ends[state].items():
                if number < len(self.templates):
                    per.setdefault(number, []).extend((last - length + 1, last, end - length + 1, end) for end in sorted(ends))
        for number, rows in per.items():
            words, label = self.templates[number]
            chains: list[tuple[int, int, int, int]] = []  # covered, first word, last word, end in the template
            for lo, hi, t_lo, t_hi in rows:
                best = (hi - lo + 1, lo)
                for covered, first, last, at in reversed(chains):
                    if last < lo - 1 - MAX_GAP:
                        break
                    if last < hi and at < t_hi and t_lo > at - (hi - lo + 1):
                        best = max(best, (covered + t_hi - max(at, t_lo - 1), first), key=lambda c: (c[0], -c[1]))
                chains.append((*best, hi, t_hi))
            taken: list[tuple[int, int]] = []
            for covered, first, last, _ in sorted(chains, key=lambda c: (-c[0], c[1], c[2])):
                if covered < MIN_COVER * len(words):
                    break
                k = bisect.bisect_left(taken, (first, 0))
                if (k and taken[k - 1][1] >= first) or (k < len(taken) and taken[k][0] <= last):
                    continue
                taken.insert(k, (first, last))
                spans.append((label, first, last, min(1.0, covered / len(words))))
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def _run(templates, base, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, places, spans = scanner.scan(body.as_py())
                labels = {scanner.base[k][1] for k, _ in places}
                starts = [s for _, s in places]
                score = max([c for *_, c in spans] + [0.5] * bool(places), default=0.0)
                rows.append((
                    doc_id, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(labels | {s[0] for s in spans})), score, [{"label": a, "first": b, "last": c, "cover": d} for a, b, c, d in spans] if with_spans else [],
                ))
            kinds = (pa.int64(),) * 5 + (pa.string(),) * 2 + (pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))
            cols = list(zip(*rows)) or [()] * len(kinds)
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE, with_spans: bool = True) -> DataFrame:
    """One row per document: word and base counts, labels, score and the template spans.

    The score is the largest covered share of a template, 0.5 at least where a base phrase
    stands, else 0. Null and empty texts have no words, no labels and score 0. Identifiers
    may be null or repeated: every row is scanned alone. Very long texts stream block by
    block, and other columns, whatever their names, aren't read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(
        _run(templates, base, with_spans),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, cover: double>>",
    )


def base_places(text: str, base=BASE) -> list[tuple[int, int]]:
    """Brute force for tests: (phrase, first word) of every base place."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [(k, i) for k, (p, _) in enumerate(base) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), with_spans=False).drop("spans")

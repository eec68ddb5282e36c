"""Licence scan with a generalised suffix automaton of licence templates.

The templates' words form one automaton (a few thousand states, broadcast inside
the task's closure). A file's words stream through it: the state after each word
gives the matching statistic, the length of the longest suffix of what was read
that occurs in some template. Maximal matches of ``MIN_MATCH`` words or more are
chained, in order of both the file and the template, into covered spans; a
template covered by ``MIN_COVER`` of its words, or by one match of ``LONG_MATCH``,
labels the file, unless another licence's template is covered further in the same place. The base phrases are looked for besides, and their labels always stay.

One narrow ``mapInArrow``; texts are scanned whole.

Defined results: null counts as empty; an empty text has no words, no labels
(empty strings) and score 0; overlapping base places all count; repeated rows are
treated alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import named, tidy

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIN_MATCH = 4
LONG_MATCH = 12
MIN_COVER = 0.5
MAX_GAP = 40
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: Public licence notices, as their authors word them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """Of several word sequences at once. Each state knows one end place per template."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for k, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(k, at)
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            for k, at in self.ends[s].items():
                known = self.ends[self.link[s]]
                known[k] = min(known.get(k, at), at)

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(arcs)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, p: int, w: int) -> int:
        if w in self.next[p]:
            q = self.next[p][w]
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.labels = [label for label, _ in templates]
        split = [words_of(text) for _, text in templates]
        self.ids = {w: k for k, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.sizes = list(map(len, split))
        self.automaton = SuffixAutomaton([[self.ids[w] for w in ws] for ws in split])
        shortest = min(MIN_MATCH, *self.sizes)
        self.runs = re.compile(rb"\x01{%d,}" % shortest)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """Maximal matches (first word, words, state), in order of the file."""
        known = self.ids
        out = []
        step = self.automaton.step
        # A match never leaves a run of words that templates use: only such runs are streamed.
        for run in self.runs.finditer(bytes(map(known.__contains__, words))):
            state = length = 0
            for at in range(run.start(), run.end()):
                was = (at - length, length, state)
                state, length = step(state, length, known[words[at]])
                if length <= was[1] and was[1] >= MIN_MATCH:
                    out.append(was)
            if length >= MIN_MATCH:
                out.append((run.end() - length, length, state))
        return out

    def covered(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float, int]]:
        """Chains of matches: (template, first word, word after, share of the template, longest match)."""
        chains: list[tuple[int, int, int, float, int]] = []
        running: dict[int, list[int]] = {}  # template -> first, after, template words up to, covered, longest

        def end(k: int) -> None:
            first, after, _, words, longest = running.pop(k)
            chains.append((k, first, after, words / self.sizes[k], longest))

        for at, length, state in matches:
            for k, last in self.automaton.ends[state].items():
                r = running.get(k)
                if r and (at - r[1] > MAX_GAP or last <= r[2]):
                    end(k)
                    r = None
                if r is None:
                    running[k] = [at, at + length, last, length, length]
                else:
                    fresh = min(length, last - r[2], at + length - r[1])
                    running[k] = [r[0], at + length, last, r[3] + max(fresh, 0), max(r[4], length)]
        for k in list(running):
            end(k)
        return self.best([c for c in chains if c[3] >= MIN_COVER or c[4] >= LONG_MATCH])

    def best(self, spans: list[tuple[int, int, int, float, int]]) -> list[tuple[int, int, int, float, int]]:
        """Without spans that overlap one of another label whose template is covered further: licences share much of their wording."""
        spans = sorted(spans, key=lambda c: (c[1], c[2], c[0]))
        worse: set[int] = set()
        for i, (k, _, after, share, _) in enumerate(spans):
            for j in range(i + 1, len(spans)):
                if spans[j][1] >= after:
                    break
                if self.labels[spans[j][0]] != self.labels[k] and spans[j][3] != share:
                    worse.add(i if share < spans[j][3] else j)
        return [c for i, c in enumerate(spans) if i not in worse]

    def scan(self, text: str | None) -> dict:
        words = words_of(text or "")
        places: list[int] = []
        base: set[str] = set()
        if b"license" in (lowered := set(words)):
            for phrase, label in BASE:
                want = phrase.split()
                if set(want) <= lowered:
                    found = [k for k in range(len(words) - len(want) + 1) if words[k] == want[0] and words[k : k + len(want)] == want]
                    places += found
                    base |= {label} if found else set()
        spans = self.covered(self.matches(words))
        labels = base | {self.labels[k] for k, *_ in spans}
        score = max([1.0 if base else 0.0, *(min(1.0, share) for *_, share, _ in spans)])
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": score,
            "spans": [{"label": self.labels[k], "first": a, "after": b, "share": share} for k, a, b, share, _ in spans],
        }


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("share", pa.float64())]))),
    ]
)
DDL = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,after:bigint,share:double>>"


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: word count, base places and labels, all labels, score, covered spans."""
    slim = docs.select(named(id_col).alias("doc_id"), named(text).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            found = [scanner.scan(x.as_py()) for x in b.column("text")]
            arrays = [pa.array([f[n] for f in found], SCHEMA.field(n).type) for n in SCHEMA.names[1:]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *arrays], schema=SCHEMA)

    return slim.mapInArrow(tidy(rows), DDL)

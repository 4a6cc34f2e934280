"""License scans: template markup compiled to token automata.

A template is text with <<opt>>...<</opt>> (may be left out) and <<var:min-max>> (any min to max
words). Mandatory words must match exactly. Where a longer name begins at the same word, as
cc-by-nc-sa does where cc-by-nc stands, the shorter one gives no label, unless it is a base phrase.
Texts may be null or empty (no words, score 0); repeated rows each give a row.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame

from .common import named, renumbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}

# Label, strength of the evidence, template. The first three are the base phrases; then come
# references to a license by name, and wording of the licenses themselves.
AS_IS = "is provided <<opt>>by the <<var:1-8>><</opt>> as is"
TEMPLATES = [
    ("mit", 0.7, "under the mit license"),
    ("apache-2", 0.7, "apache license version 2"),
    ("cc-by-nc", 0.7, "cc by nc"),
    ("mit", 0.8, "<<opt>>is<</opt>> <<opt>>released<</opt>> <<opt>>licensed<</opt>> <<opt>>distributed<</opt>> under the terms of the mit license"),
    ("mit", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind"),
    ("apache-2", 0.9, "licensed under the apache license version 2 0"),
    ("apache-2", 1.0, "licensed under the apache license version 2 0 the license you may not use <<var:1-4>> except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", 1.0, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("cc-by", 0.9, "creative commons attribution <<opt>>4 0<</opt>> <<opt>>4<</opt>> international"),
    ("cc-by", 0.9, "creative commons attribution <<opt>>3 0<</opt>> <<opt>>2 0<</opt>> <<opt>>2 5<</opt>> <<opt>>unported<</opt>> <<opt>>generic<</opt>> license"),
    ("cc0", 0.9, "creative commons <<opt>>cc0<</opt>> <<opt>>zero<</opt>> <<opt>>1 0<</opt>> universal <<opt>>1 0<</opt>> public domain dedication"),
    ("bsd-2", 0.9, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software " + AS_IS),
    ("bsd-3", 1.0, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>>3<</opt>> neither the name of <<var:1-10>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", 1.0, "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", 1.0, "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<var:1-2>> of the license or at your option any later version"),
    ("mpl-2", 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", 1.0, "this is free and unencumbered software released into the public domain"),
    ("zlib", 1.0, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose"),
]
# Spellings of the parts of a name, names of the family, identifiers.
PARTS = {"nc": ("noncommercial", "non commercial"), "sa": ("sharealike", "share alike"), "nd": ("noderivatives", "no derivatives", "noderivs")}
GNU = {"gpl": "", "lgpl": "lesser", "agpl": "affero"}
SPDX = [
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"),
    ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("isc", "isc"), ("mpl-2", "mpl 2 0"), ("cc0", "cc0 1 0"), ("unlicense", "unlicense"), ("zlib", "zlib"),
    ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("cc-by-nd", "cc by nd 4 0"), ("cc-by-nc-sa", "cc by nc sa 4 0"), ("cc-by-nc-nd", "cc by nc nd 4 0"),
]
for kind in ("sa", "nc", "nd", "nc-sa", "nc-nd"):
    spelled = product(*(PARTS[x] for x in kind.split("-")))
    TEMPLATES += [(f"cc-by-{kind}", 0.9, "<<opt>>creative commons<</opt>> attribution " + " ".join(x)) for x in spelled]
    TEMPLATES += [(f"cc-by-{kind}", 0.7, "cc by " + kind.replace("-", " "))]
for label, word in GNU.items():
    TEMPLATES += [(label, 0.9, f"<<opt>>under the terms of<</opt>> <<opt>>the<</opt>> gnu {word} general public license <<opt>>version<</opt>>")]
TEMPLATES += [("lgpl", 0.9, "gnu library general public license")]
TEMPLATES += [(label, 0.8, f"spdx license identifier <<opt>><<var:1-5>> or<</opt>> <<opt>><<var:1-5>> and<</opt>> {x}") for label, x in SPDX]
N_BASE = 3
MARK = re.compile(r"<<(/?opt|var:\d+-\d+)>>")


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(UPPER))


class Automaton:
    """steps[s]: (word or None for any, next state); free[s]: states reached without a word."""

    def __init__(self, template: str):
        self.steps: list[list] = [[]]
        self.free: list[list] = [[]]
        opened, at = [], 0
        for n, part in enumerate(MARK.split(template)):
            if n % 2 == 0:
                for w in words(part):
                    at = self._then(at, w)
            elif part == "opt":
                opened.append(at)
            elif part == "/opt":
                self.free[opened.pop()].append(at)
            else:
                least, most = map(int, part[4:].split("-"))
                skips = []
                for k in range(most):
                    if k >= least:
                        skips.append(at)
                    at = self._then(at, None)
                for s in skips:
                    self.free[s].append(at)
        if opened:
            raise ValueError("an optional region is never closed")
        self.end = at
        self.start = self._closed({0})
        if self.end in self.start:
            raise ValueError("a template needs a mandatory word")
        self.first = {w for s in self.start for w, _ in self.steps[s]}

    def _then(self, at: int, word) -> int:
        self.steps.append([])
        self.free.append([])
        self.steps[at].append((word, len(self.steps) - 1))
        return len(self.steps) - 1

    def _closed(self, states: set) -> set:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def match(self, ws: list[str], i: int) -> int:
        """End of the longest match that starts at word i, or -1."""
        states, end = self.start, -1
        while states:
            if self.end in states:
                end = i
            if i >= len(ws):
                break
            w = ws[i]
            states = self._closed({t for s in states for x, t in self.steps[s] if x is None or x == w})
            i += 1
        return end


def begun(automata: list) -> dict:
    """Automata by the words that they can begin with; under None those that any word begins."""
    index: dict = {}
    for k, a in enumerate(automata):
        for w in a.first:
            index.setdefault(w, []).append(k)
    return index


def scan(text: str, automata: list, templates=TEMPLATES, index: dict | None = None):
    ws = words(text)
    index = begun(automata) if index is None else index
    anywhere = index.get(None, [])
    base, labels, base_labels, score = [], set(), set(), 0.0
    for i in range(len(ws)) if anywhere else [i for i, w in enumerate(ws) if w in index]:
        ends = [(k, automata[k].match(ws, i)) for k in index.get(ws[i], []) + anywhere]
        ends = [(k, end) for k, end in ends if end >= 0]
        for k, end in ends:
            label, strength, _ = templates[k]
            if k < N_BASE:
                base.append(i)
                base_labels.add(label)
            elif any(templates[o][0].startswith(label + "-") and at > end for o, at in ends):
                continue
            labels.add(label)
            score = max(score, strength)
    return len(ws), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


SCHEMA = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document; map only, no shuffle."""

    def run(frames):
        automata = [Automaton(t) for _, _, t in TEMPLATES]
        index = begun(automata)
        for f in frames:
            rows = [(d, *scan(t, automata, TEMPLATES, index)) for d, t in zip(f["doc_id"], f["text"])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return renumbered(named(docs).mapInPandas(run, SCHEMA), docs)

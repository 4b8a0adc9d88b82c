"""License scans by template-markup matching.

A template is mandatory wording with optional regions `[[...]]` and replaceable regions `{{most}}` (up to so many words of
any kind). It is compiled into an automaton over words, with a skip arc around every optional region and counted
any-word arcs for the replaceable ones; a text is accepted where the mandatory words match one after another, exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import byte_texts, map_rows

#: Lower case; all but 0-9, a-z and bytes from 0x80 on separates words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# fixed values: phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: wording of public license notices, by label
TEMPLATES = [
    ("mit-notice", "[[this software is]] released under the [[terms of the]] mit license"),
    ("mit-notice", "licensed under the [[terms of the]] mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-2.0", "[[this {{3}} is]] licensed under the gnu general public license version 2"),
    ("gpl-3.0", "[[this {{3}} is]] licensed under the gnu general public license version 3"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1}} of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license [[version {{2}}]]"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-4.0", "licensed under [[a]] [[creative commons]] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under [[a]] [[creative commons]] cc by nc sa 4 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright [[c]] {{8}} all rights reserved"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd-2-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "[[3]] [[neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]] "
        "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "bsd-3-text",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "isc-full-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {{6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-notice",
        "[[this program]] {{4}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1}} of the license or at your option any later version "
        "{{4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
]


@dataclass
class Automaton:
    """step[i]: (word or None for any, next state, mandatory words up to it); skip[i]: states reached without a word."""

    label: str
    step: list[list[tuple[bytes | None, int]]]
    skip: list[list[int]]
    done: list[int]
    anchor: bytes

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for x in self.skip[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return states

    def starts(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w, _ in self.step[s] if w is not None}

    def match(self, words: list[bytes], at: int) -> tuple[int, float]:
        """The end of the longest accepted run from `at` (or -1), and the share of the mandatory words that was reached."""
        states, end, most, last, i = self.closure({0}), -1, 0, len(self.step) - 1, at
        while states:
            most = max(most, *(self.done[s] for s in states))
            if last in states:
                end = i
            if i == len(words):
                break
            states = self.closure({t for s in states for w, t in self.step[s] if w is None or w == words[i]})
            i += 1
        return end, most / self.done[last]


def compile_template(label: str, markup: str) -> Automaton:
    """States in reading order; an optional region gets a skip arc from its first to its last state."""
    step, skip, done, opened, mandatory = [[]], [[]], [0], [], []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup.lower()):
        here = len(step) - 1
        if token == "[[":
            opened.append(here)
            continue
        if token == "]]":
            skip[opened.pop()].append(here)
            continue
        for _ in range(count := int(token[2:-2]) if token[0] == "{" else 1):
            word = None if token[0] == "{" else token.encode()
            step[-1].append((word, len(step)))
            step.append([])
            skip.append([])
            done.append(done[-1] + (word is not None and not opened))
            if word is not None and not opened:
                mandatory.append(word)
        if token[0] == "{":
            for s in range(here, here + count):
                skip[s].append(here + count)
    if opened or not mandatory:
        raise ValueError(f"template {label}: regions must close, and some wording must be mandatory")
    return Automaton(label, step, skip, done, max(mandatory, key=len))


def scan(text: bytes | None, automata: list[tuple[Automaton, set[bytes]]], phrases: list[tuple[list[bytes], str]]) -> tuple:
    """n_words, phrase starts, phrase labels, template labels, spans (label, first word, past the last), score."""
    flat = (text or b"").translate(TABLE)
    words = flat.split()
    found, starts, spans, score, where = set(), [], [], 0.0, None
    for phrase, label in phrases:
        key = max(phrase, key=len)
        if key not in flat:
            continue
        for i, w in enumerate(words):
            if w == phrase[0] and words[i : i + len(phrase)] == phrase:
                starts.append(i)
                found.add(label)
    for a, first in automata:
        if a.anchor not in flat:
            continue
        if where is None:
            where = {}
            for i, w in enumerate(words):
                where.setdefault(w, []).append(i)
        if a.anchor not in where:
            continue
        past = 0
        for i in sorted(x for w in first for x in where.get(w, ())):
            if i < past:
                continue
            end, share = a.match(words, i)
            score = max(score, share)
            if end >= 0:
                spans.append((a.label, i, end))
                past = end
    return len(words), starts, found, {x[0] for x in spans}, spans, score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Scan every whole text for license phrases and templates.

    Returns the id, n_words, n_base (places of all phrases), first_word and last_word (smallest and largest start of a
    phrase), base_labels, labels (with those of accepted templates; both sorted and comma-joined), spans (label, first
    word, past the last word), and score: the largest share of a template's mandatory words that was met in order, 1
    where one is accepted; templates whose longest mandatory word is nowhere in the text are passed over and count 0. Null and empty texts have no words and no labels. Repeated rows are scanned alike. Templates
    that accept the same words all count. Columns other than id and text are not read. No shuffle.
    """
    automata = [(a, a.starts()) for a in (compile_template(*t) for t in templates or TEMPLATES)]
    wanted = [([w.encode() for w in p.split()], label) for p, label in (phrases or PHRASES).items()]

    def work(batch: pa.RecordBatch) -> dict:
        rows = [scan(t, automata, wanted) for t in byte_texts(batch.column(1))]
        return {
            id_col: batch.column(0), "n_words": [r[0] for r in rows], "n_base": [len(r[1]) for r in rows], "first_word": [min(r[1], default=None) for r in rows], "last_word": [max(r[1], default=None) for r in rows],
            "base_labels": [",".join(sorted(r[2])) for r in rows], "labels": [",".join(sorted(r[2] | r[3])) for r in rows], "spans": [[{"label": a, "first": b, "past": c} for a, b, c in r[4]] for r in rows], "score": [r[5] for r in rows],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, spans array<struct<label:string,first:long,past:long>>, score double")

"""License texts found by matching marked-up templates as token automata.

A template is text with two kinds of markup: ``<<optional>>...<</optional>>`` may be left out, and
``<<any:n>>`` stands for up to n words of the licensee's own (names, years, organisations). Words
outside markup are mandatory and must stand exactly in order. A template compiles into states,
one per word position; a state has its word's arc, empty moves over an optional part, and a
counted loop for a replaceable one. Matching follows all live states over the words of a text
from each place where the template's first words can stand.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters, so case, punctuation
and layout never matter. NULL text has no words. Rows are independent of each other: repeated rows and
ties get equal results, and an empty table gives an empty result. Texts are read whole.
"""

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.store import with_package

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARKUP = re.compile(r"<<(optional|/optional|any:\d+)>>")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}

#: Phrases and the labels they give.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Wording of public licenses, with markup. The label stands first.
TEMPLATES = (
    ("mit-grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)
        <</optional>>shall be included in all copies or substantial portions of the Software."""),
    ("mit-notice", "<<optional>>This <<any:3>> is<</optional>> released under the MIT license"),
    ("mit-notice", "licensed under the <<optional>>terms of the<</optional>> MIT license"),
    ("apache-2.0-notice", """Licensed under the Apache License<<optional>>,<</optional>> Version 2.0
        <<optional>>(the "License")<</optional>>"""),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        <<optional>>http<<any:1>>www.apache.org/licenses/LICENSE-2.0<</optional>> Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl-notice", """licensed under the <<optional>>terms of the<</optional>> GNU <<optional>>Affero<</optional>>
        <<optional>>Lesser<</optional>> General Public License"""),
    ("gpl-2.0", """licensed under the <<optional>>terms of the<</optional>> GNU General Public License
        <<optional>>as published by the Free Software Foundation<</optional>> version 2<<optional>>.0<</optional>>"""),
    ("gpl-3.0", """licensed under the <<optional>>terms of the<</optional>> GNU General Public License
        <<optional>>as published by the Free Software Foundation<</optional>> version 3<<optional>>.0<</optional>>"""),
    ("gpl-header", """This program is free software<<any:1>> you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation; either version <<any:2>> of the
        License, or (at your option) any later version."""),
    ("bsd-grant", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met"""),
    ("isc-grant", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies."""),
    ("mpl-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    ("cc-by-4.0", "licensed under <<any:4>> CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under <<any:4>> CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under <<any:4>> CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "licensed under <<any:4>> CC BY-ND 4.0"),
    ("cc0-1.0", "CC0 1.0 <<optional>>Universal<</optional>>"),
    ("rights-reserved", "All rights reserved"),
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(ASCII_LOWER))


class Automaton:
    """The states of one template; a state is an index into ``steps``.

    A step is ``("word", w)``, ``("skip", state)`` for the start of an optional part that may be
    jumped over, or ``("any", n)`` for up to n free words.
    """

    def __init__(self, label: str, template: str):
        self.label = label
        self.steps: list[list] = []
        open_parts: list[int] = []
        for i, piece in enumerate(MARKUP.split(template)):
            if i % 2 == 0:
                self.steps += [["word", w] for w in words_of(piece)]
            elif piece == "optional":
                open_parts.append(len(self.steps))
                self.steps.append(["skip", None])
            elif piece == "/optional":
                self.steps[open_parts.pop()][1] = len(self.steps)
            else:
                self.steps.append(["any", int(piece[4:])])
        if open_parts:
            raise ValueError(f"an optional part of {label} is not closed")
        self.first = self._first_words()

    def _moves(self, state: int, free: int) -> Iterator[tuple[int, int]]:
        """Live states reachable without a word: ``(state, free words left)``; ``free`` below 0 is all of them."""
        while state < len(self.steps):
            kind, value = self.steps[state]
            if kind == "word":
                break
            if kind == "skip":
                yield from self._moves(value, -1)
                state += 1
                continue
            left = value if free < 0 else free
            if left:
                yield (state, left)
            state, free = state + 1, -1
        yield (state, 0)

    def _first_words(self) -> frozenset[str]:
        """Words a match can begin with; free words cannot begin one."""
        found = {self.steps[s][1] for s, _ in self._moves(0, -1) if s < len(self.steps) and self.steps[s][0] == "word"}
        if not found:
            raise ValueError(f"{self.label} has no mandatory word")
        return frozenset(found)

    def match(self, words: Sequence[str], begin: int) -> int:
        """The end of the longest match that begins at ``begin``, or -1."""
        end, live = -1, set(self._moves(0, -1))
        for at in range(begin, len(words) + 1):
            if any(s == len(self.steps) for s, _ in live):
                end = at
            if at == len(words):
                break
            after: set[tuple[int, int]] = set()
            for state, left in live:
                if state == len(self.steps):
                    continue
                kind, value = self.steps[state]
                if kind == "word":
                    if value == words[at]:
                        after.update(self._moves(state + 1, -1))
                elif left > 1:
                    after.update(self._moves(state, left - 1))
                else:
                    after.update(self._moves(state + 1, -1))
            if not after:
                break
            live = after
        return end

    def anchor(self) -> str:
        """The longest run of mandatory words, which every accepted text holds."""
        runs, run, depth_ends = [], [], []
        for i, (kind, value) in enumerate(self.steps):
            depth_ends = [e for e in depth_ends if e > i]
            if kind == "skip":
                depth_ends.append(value)
            if kind == "word" and not depth_ends:
                run.append(value)
            else:
                runs.append(run)
                run = []
        return " ".join(max([*runs, run], key=len))


@lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[tuple[str, Automaton], ...]:
    automata = [Automaton(label, text) for label, text in templates]
    return tuple((f" {a.anchor()} ", a) for a in automata)


def scan(words: list[str], phrases, templates) -> tuple:
    """Base places, first and last of them, base labels, all labels, score."""
    joined = f" {' '.join(words)} "
    places, labels = [], set()
    for phrase, label in phrases:
        at = joined.find(f" {phrase} ")
        while at >= 0:
            places.append(joined.count(" ", 0, at + 1) - 1)
            labels.add(label)
            at = joined.find(f" {phrase} ", at + 1)
    found, covered = set(labels), 0
    for anchor, automaton in compiled(templates):
        if anchor not in joined:
            continue
        for begin, word in enumerate(words):
            if word in automaton.first:
                end = automaton.match(words, begin)
                if end >= 0:
                    found.add(automaton.label)
                    covered = max(covered, end - begin)
    # A matched template is sure from 20 words on; a phrase alone is half a proof.
    score = min(1.0, 0.5 + covered / 40) if covered else 0.5 if labels else 0.0
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(found)),
        score,
    )


RESULT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
    ]
)


def license_scan(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels`` and ``score`` from 0 (nothing) to 1 (a long template)."""
    phrases = tuple((" ".join(words_of(p)), label) for p, label in phrases)
    templates = tuple(map(tuple, templates))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows = [scan(words_of(t or ""), phrases, templates) for t in part.column(1).to_pylist()]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT)]
                schema = pa.schema([("id", part.schema.field(0).type), *RESULT])
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    kind = docs.schema[id].dataType.simpleString()
    schema = (
        f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double"
    )
    return (
        with_package(docs)
        .select(F.col(id).alias("id"), F.col(text).alias("text"))
        .mapInArrow(scanned, schema)
        .withColumnRenamed("id", id)
    )

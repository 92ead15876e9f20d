"""License notices by template markup.

Texts are lower-cased in A-Z and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, so punctuation, line
breaks and comment signs play no part. Templates are words with markup:

    [[ ... ]]        wording that may be left out
    {{name}}         a replaceable region of up to MAX_GAP words
    {{name:n}}       a replaceable region of up to n words
    (a|b c)          one of several wordings

All templates are compiled into one automaton over words. It accepts where the mandatory wording
stands exactly, whatever the optional and replaceable regions hold. Besides, plain phrases are
looked for; labels come from both.

NULL and empty texts have no words and no labels. Repeated rows are scanned alike; an empty
table gives an empty result.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_GAP = 12

#: Phrases whose words stand next to each other, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and wording of license notices, as published with the licenses.
TEMPLATES = (
    ("mit", "(licensed|released|distributed) under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files [[the software]] to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsd", "(licensed|released|distributed) under the [[terms of the]] [[{{variant:3}}]] bsd license"),
    ("apache", "licensed under the apache license [[version 2 0]]"),
    ("apache", "you may not use {{file:4}} except in compliance with the license [[you may obtain a copy of the license at]]"),
    ("gpl", "licensed under the [[terms of the]] [[gnu]] general public license [[version {{version:2}}]]"),
    ("gpl", "{{program}} is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("lgpl", "licensed under the [[terms of the]] [[gnu]] lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under [[a]] (cc|creative commons) (by|attribution) {{version:1}} 0 [[international]] [[license]]"),
    ("cc-by-nc", "licensed under [[a]] (cc by nc|creative commons attribution noncommercial) {{version:1}} 0 [[international]] [[license]]"),
    ("cc-by-sa", "licensed under [[a]] (cc by sa|creative commons attribution sharealike) {{version:1}} 0 [[international]] [[license]]"),
    ("all-rights-reserved", "all rights reserved"),
)

_TOKEN = re.compile(r"\[\[|\]\]|\{\{\w+(?::\d+)?\}\}|\([^()]*\)|[^\s\[\]{}()]+")


def parse(template: str) -> list:
    """Elements of a template: ("word", w), ("gap", n), ("any", [sequences]) and ("optional", [elements])."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(template):
        if token == "[[":
            stack.append([])
        elif token == "]]":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif token.startswith("{{"):
            size = token.strip("{}").partition(":")[2]
            stack[-1].append(("gap", int(size or MAX_GAP)))
        elif token.startswith("("):
            stack[-1].append(("any", [[("word", w) for w in x.split()] for x in token[1:-1].split("|")]))
        else:
            stack[-1].append(("word", token))
    if len(stack) != 1:
        raise ValueError(f"optional wording is not closed: {template}")
    return stack[0]


class Automaton:
    """A nondeterministic automaton over words for many templates."""

    def __init__(self, templates=TEMPLATES):
        self.step: list[dict[str, list[int]]] = []
        self.jump: list[list[int]] = []
        self.wild: list[list[int]] = []
        self.label: dict[int, str] = {}
        starts = []
        for label, text in templates:
            start = self._state()
            end = self._build(parse(text), start)
            self.label[end] = label
            starts.append(start)
        self.closed = [self._closure(s) for s in range(len(self.step))]
        begin = frozenset().union(*[self.closed[s] for s in starts])
        if any(s in self.label for s in begin):
            raise ValueError("a template without mandatory wording")
        # A leading gap would start everywhere: it is matched as if left out.
        self.first: dict[str, list[int]] = {}
        for s in begin:
            for word, targets in self.step[s].items():
                self.first.setdefault(word, []).extend(targets)
        self.begin_words = frozenset(self.first)

    def _state(self) -> int:
        self.step.append({})
        self.jump.append([])
        self.wild.append([])
        return len(self.step) - 1

    def _build(self, elements: list, at: int) -> int:
        for kind, value in elements:
            if kind == "word":
                new = self._state()
                self.step[at].setdefault(value, []).append(new)
                at = new
            elif kind == "gap":
                end = self._state()
                self.jump[at].append(end)
                for _ in range(value):
                    new = self._state()
                    self.wild[at].append(new)
                    self.jump[new].append(end)
                    at = new
                at = end
            else:
                end = self._state()
                ways = value if kind == "any" else [value, []]
                for way in ways:
                    self.jump[self._build(way, at)].append(end)
                at = end
        return at

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for other in self.jump[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return frozenset(seen)

    def labels(self, words: list[str]) -> set[str]:
        """Labels of all templates that stand somewhere in a text."""
        found: set[str] = set()
        active: set[int] = set()
        for word in words:
            new: set[int] = set()
            for state in active:
                for target in (*self.step[state].get(word, ()), *self.wild[state]):
                    new |= self.closed[target]
            if word in self.begin_words:
                for target in self.first[word]:
                    new |= self.closed[target]
            active = new
            for state in active:
                if state in self.label:
                    found.add(self.label[state])
        return found


def mandatory_words(elements: list) -> set[str]:
    return {value for kind, value in elements if kind == "word"}


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _scanner(templates, phrases):
    """Map function over (doc_id, text) batches."""
    # One long word of each template and phrase: a text that lacks it cannot hold the whole.
    keys = {max(mandatory_words(parse(text)), key=len).encode() for _, text in templates}
    keys |= {max(p.split(), key=len).encode() for p, _ in phrases}
    wanted = [(p.split(), label) for p, label in phrases]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        for batch in batches:
            out = []
            for value in batch.column("text"):
                text = (value.as_py() or "").encode().lower()
                inside = _INSIDE[np.frombuffer(text, np.uint8)]
                n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])
                spots, base, accepted = [], set(), set()
                if any(key in text for key in keys):
                    words = [w.decode() for w in WORD.findall(text)]
                    for phrase, label in wanted:
                        for at in (k for k, w in enumerate(words) if w == phrase[0]):
                            if words[at : at + len(phrase)] == phrase:
                                spots.append(at)
                                base.add(label)
                    accepted = automaton.labels(words)
                score = 1.0 if accepted else 0.5 if base else 0.0
                out.append((
                    n_words, len(spots), min(spots, default=None), max(spots, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | accepted)), score,
                ))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, kind) for x, kind in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return scan


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts all places of phrases, first_word and last_word are the smallest and largest word
    number where one starts. The score is 1 where a template is accepted, a half
    where only a phrase stands, else 0.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scanner(templates, phrases),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )


def as_regex(template: str) -> str:
    """The template as a regular expression over words that each end with a space; for checks in SQL."""
    def build(elements):
        out = ""
        for kind, value in elements:
            if kind == "word":
                out += re.escape(value) + " "
            elif kind == "gap":
                out += f"(?:[^ ]+ ){{0,{value}}}"
            elif kind == "any":
                out += "(?:" + "|".join(build(x) for x in value) + ")"
            else:
                out += f"(?:{build(value)})?"
        return out

    return " " + build(parse(template))

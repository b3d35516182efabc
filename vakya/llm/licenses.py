"""License scans: phrase places, and an exact set-similarity join with license notices.

Templates are token sets. Tokens are ordered by how many text blocks hold
them, rarest first, over all documents. A template is looked up by its prefix
in that order (length and positional filters follow), and every block
whose containment of the template reaches the threshold is found. Labels are
stricter: of templates so alike that one could pass for another, a block must hold the
tokens that tell them apart, and one that includes another stands for both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Conditions that a Creative Commons licence may add, by the letters of its name (fixed values).
CONDITIONS = {"": "", "-sa": "sharealike", "-nc": "noncommercial", "-nd": "noderivatives", "-nc-sa": "noncommercial sharealike", "-nc-nd": "noncommercial noderivatives"}
#: Opening words of public license notices.
TEMPLATES = {
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "gpl-2": "this work is licensed under the gnu general public license version 2",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "lgpl-2": "this work is licensed under the gnu lesser general public license version 2 1",
    "lgpl-3": "this work is licensed under the gnu lesser general public license version 3",
    "agpl-3": "this work is licensed under the gnu affero general public license version 3",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-1": "licensed under the apache license version 1 1",
    "apache-2": "licensed under the apache license version 2 0",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "released under the mit license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-1": "this source code form is subject to the terms of the mozilla public license v 1 1",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-notice": "this is free and unencumbered software released into the public domain",
    **{f"cc-by{k}-4": f"licensed under cc by {k.replace('-', ' ')} 4 0" for k in CONDITIONS},
    **{f"cc-by{k}-notice": f"this work is licensed under a creative commons attribution {x} 4 0 international license" for k, x in CONDITIONS.items()},
}
THRESHOLD = 0.8
#: A block is 64 words, and starts every 32: a stretch of 33 words lies in one whole.
STEP = 32
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of the ASCII-lower-cased text: runs of digits, letters and characters past ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _vocabulary(templates: dict[str, str]) -> set[bytes]:
    return {w for t in templates.values() for w in words(t)}


def _blocks(ws: list[bytes], vocabulary: set[bytes]) -> dict[int, set[bytes]]:
    """Block number -> the template words it holds; block b is words 32 b to 32 b + 63."""
    half: dict[int, set[bytes]] = {}
    for i, w in enumerate(ws):
        if w in vocabulary:
            half.setdefault(i // STEP, set()).add(w)
    out = {}
    for b in half.keys() | {b - 1 for b in half if b}:
        out[b] = half.get(b, set()) | half.get(b + 1, set())
    return out


class Index:
    """Prefix index over the templates, by the global order of their tokens."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.vocabulary = _vocabulary(templates)
        self.rank = {w: k for k, w in enumerate(sorted(self.vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = {name: sorted({self.rank[w] for w in words(t)}) for name, t in templates.items()}
        self.need = {name: max(1, math.ceil(threshold * len(t) - 1e-9)) for name, t in self.templates.items()}
        self.prefix: dict[int, list[tuple[str, int]]] = {}
        for name, t in self.templates.items():
            for i in range(len(t) - self.need[name] + 1):
                self.prefix.setdefault(t[i], []).append((name, i))
        self.keys = {w for w, k in self.rank.items() if k in self.prefix}
        # Siblings share enough tokens to be taken for one another: what tells a template from one of them must be there.
        sets = {name: set(t) for name, t in self.templates.items()}
        self.telling = {name: set() for name in sets}
        self.larger: dict[str, list[str]] = {name: [] for name in sets}
        for x, a in sets.items():
            for y, b in sets.items():
                if x != y and len(a & b) >= threshold * len(a) - 1e-9:
                    self.telling[x] |= a - b
                    if a < b:
                        self.larger[x].append(y)

    def match(self, block: set[bytes]) -> dict[str, float]:
        found: dict[str, float] = {}
        tokens = sorted(self.rank[w] for w in block)
        held = set(tokens)
        tried: set[str] = set()
        for at, k in enumerate(tokens):
            for name, i in self.prefix.get(k, ()):
                if name in tried:
                    continue
                tried.add(name)
                t, need = self.templates[name], self.need[name]
                # The first shared token in the order is this one: what follows it on both sides bounds the overlap.
                if len(tokens) < need or 1 + min(len(t) - i - 1, len(tokens) - at - 1) < need:
                    continue
                overlap = sum(x in held for x in t)
                if overlap >= need:
                    found[name] = overlap / len(t)
        return found

    def told(self, found: dict[str, float], block: set[bytes]) -> dict[str, float]:
        """Those of a block's matches that label it: not a sibling's, and not included in a larger one's."""
        held = {self.rank[w] for w in block}
        sure = {name: c for name, c in found.items() if self.telling[name] <= held}
        return {name: c for name, c in sure.items() if not any(y in sure for y in self.larger[name])}


def count_tokens(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """Number of blocks with each template word, over all documents; bounded by the templates' vocabulary."""
    vocabulary = _vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = {}
        for b in batches:
            for t in b.column(0):
                for block in _blocks(words(t.as_py()), vocabulary).values():
                    for w in block:
                        n[w] = n.get(w, 0) + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def phrase_places(ws: list[bytes], phrases: dict[str, str]) -> tuple[list[int], set[str]]:
    joined = b" " + b" ".join(ws) + b" "
    places, labels = [], set()
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        while at >= 0:
            places.append(at)
            labels.add(label)
            at = joined.find(needle, at + 1)
    starts, word, last = [], 0, 0
    for at in sorted(places):  # blanks before a place are words before it
        word += joined.count(b" ", last, at)
        last = at
        starts.append(word)
    return starts, labels


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: word count, phrase places, labels of both kinds and the best containment.

    Whole texts are scanned; a null text is empty and has score 0. ``spans``
    lists (template, first word of the block, containment) of every match.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    index = Index(templates, count_tokens(docs, templates), threshold)
    heads = {p.split()[0].encode() for p in phrases}

    def row(text: str | None) -> tuple:
        ws = words(text)
        seen = set(ws)
        starts, base = phrase_places(ws, phrases) if seen & heads else ([], set())
        best: dict[str, float] = {}
        spans = []
        if not seen.isdisjoint(index.keys):
            for b, block in sorted(_blocks(ws, index.vocabulary).items()):
                found = index.match(block)
                for name, c in index.told(found, block).items():
                    best[name] = max(c, best.get(name, 0.0))
                for name, c in sorted(found.items()):
                    spans.append({"template": name, "first": b * STEP, "containment": c})
        score = 1.0 if starts else max(best.values(), default=0.0)
        return (len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | set(best))), score, spans)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
             pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("containment", pa.float64())]))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t.as_py()) for t in b.column(1)]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                          "base_labels string, labels string, score double, spans array<struct<template:string,first:bigint,containment:double>>")

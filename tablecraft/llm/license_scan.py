"""Blocks of text that contain most of the words of a known licence notice."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablecraft.llm import text as T
from tablecraft.llm.columns import beside

#: Phrases whose every place counts, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Words of common licence notices, with the label of the licence.
TEMPLATES = (
    ("licensed under cc by", "cc-by"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
    ("copyright all rights reserved", "reserved"),
    ("all rights reserved", "reserved"),
)
#: Share of a template's different words that a block holds at least. A block is as many consecutive words as the template has.
CONTAINMENT = 0.8


def hashes_of(words: list[str]) -> np.ndarray:
    """The hashes that these words have inside texts."""
    data = "\n".join(words).encode()
    ends = np.array([0, len(data)])
    return T.split_words(np.frombuffer(data, np.uint8), ends, T.PLAIN_WORDS, True).hashes()


@dataclass
class Template:
    label: str
    tokens: np.ndarray  # hashes of its different words, rarest first
    length: int
    needed: int  # different words that a block must hold
    prefix: np.ndarray  # a block without any of these cannot hold enough of the others


def ordered(frequency: dict[int, int], templates=TEMPLATES, containment: float = CONTAINMENT) -> list[Template]:
    """Templates with their words in the global order: rarest in the corpus first, ties by hash."""
    out = []
    for words, label in templates:
        parts = words.split()
        tokens = np.unique(hashes_of(parts))
        tokens = tokens[np.lexsort((tokens, [frequency.get(int(t), 0) for t in tokens]))]
        needed = ceil(containment * len(tokens) - 1e-9)
        out.append(Template(label, tokens, len(parts), needed, np.sort(tokens[: len(tokens) - needed + 1])))
    return out


def template_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """Occurrences of each template word in all texts; a task sends one row per template word."""
    known = np.unique(np.concatenate([hashes_of(w.split()) for w, _ in templates]))

    def count(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, w in T.word_slices(batch.column(0), T.PLAIN_WORDS, True):
                h = w.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(total)], ["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {int(known[r["token"]]): r["n"] for r in rows}


def blocks(h: np.ndarray, doc: np.ndarray, t: Template) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all blocks that hold at least `needed` different words of the template, and how many they hold.

    Prefix filter: a block must cover one of the template's rarest words. Length filter: it must lie inside one text, whole or, in a
    shorter text, all of it. Positional filter: if the rarest word that a block holds is the template's r-th, at most the words from
    r on can be in it. What is left is counted exactly.
    """
    n, m = len(h), t.length
    rare = np.flatnonzero(np.isin(h, t.prefix))
    if not len(rare):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first_of = np.searchsorted(doc, doc[rare])
    past_of = np.searchsorted(doc, doc[rare], side="right")
    low, high = np.maximum(rare - m + 1, first_of), np.maximum(np.minimum(rare, past_of - m), first_of)
    touched = np.flatnonzero(T.covered(low, np.maximum(high - low + 1, 1), n))
    order = np.argsort(t.tokens)
    ranked = t.tokens[order]
    held = np.zeros((len(touched), len(t.tokens)), bool)
    for step in range(m):
        at = touched + step
        inside = at < n
        inside[inside] = doc[at[inside]] == doc[touched[inside]]
        rows = np.flatnonzero(inside)
        place = np.minimum(np.searchsorted(ranked, h[at[rows]]), len(ranked) - 1)
        equal = ranked[place] == h[at[rows]]
        held[rows[equal], order[place[equal]]] = True
    rank = held.argmax(1)
    possible = held.any(1) & (len(t.tokens) - rank >= t.needed)
    count = held.sum(1)
    good = possible & (count >= t.needed)
    return touched[good], count[good]


ADDED = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double",
         "blocks": "array<struct<start:bigint,words:bigint,label:string,containment:double>>"}


@beside(("text",), tuple(ADDED))
def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and blocks (start word, words, label, containment).

    score is the largest containment of a template in a block of the text, 1 where a base phrase occurs, 0 where nothing reaches the
    threshold. Missing, empty and blank texts have no words, no labels ("") and score 0. A text is judged alone: repeated rows agree.
    Other columns stay, but those named like an added one are replaced; an empty table gives an empty result.
    """
    arranged = ordered(template_frequencies(docs, templates), templates, containment)
    phrases = [(hashes_of(p.split()), label) for p, label in PHRASES]
    block_type = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def work(batches):
        for batch in batches:
            size = batch.num_rows
            n_words, n_base = np.zeros(size, np.int64), np.zeros(size, np.int64)
            first, last = np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
            score = np.zeros(size)
            base: dict[int, set] = {}
            found: dict[int, list] = {}
            for i, j, w in T.word_slices(batch.column(batch.schema.get_field_index("text")), T.PLAIN_WORDS, True):
                h, doc = w.hashes(), w.doc
                n_words[i:j] = np.diff(w.at)
                for tokens, label in phrases:
                    k = len(tokens)
                    if len(h) < k:
                        continue
                    hit = T.within(doc, k)
                    for step in range(k):
                        hit = hit & (h[step : len(h) - k + 1 + step] == tokens[step])
                    at = np.flatnonzero(hit)
                    row, place = doc[at] + i, at - w.at[doc[at]]
                    np.add.at(n_base, row, 1)
                    np.minimum.at(first, row, place)
                    np.maximum.at(last, row, place)
                    score[row] = 1.0
                    for r in np.unique(row):
                        base.setdefault(int(r), set()).add(label)
                for t in arranged:
                    at, count = blocks(h, doc, t)
                    if not len(at):
                        continue
                    row, share = doc[at] + i, count / len(t.tokens)
                    np.maximum.at(score, row, share)
                    for r, s, c in zip(row.tolist(), (at - w.at[doc[at]]).tolist(), share.tolist()):
                        found.setdefault(r, []).append({"start": s, "words": min(t.length, int(n_words[r]) - s), "label": t.label, "containment": c})
            none = n_base == 0
            names = [",".join(sorted(base.get(r, ()))) for r in range(size)]
            every = [",".join(sorted(base.get(r, set()) | {b["label"] for b in found.get(r, ())})) for r in range(size)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(names), pa.array(every),
                pa.array(score), pa.array([found.get(r, []) for r in range(size)], block_type),
            ], [*batch.schema.names, *ADDED])

    added = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in ADDED.items()))
    return docs.mapInArrow(work, StructType([*docs.schema, *added]))


def op6_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

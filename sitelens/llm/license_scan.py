"""Licence scan by a positional index of rare licence words.

The index holds, for every word of the licence templates, its inverse document
frequency among the templates and its postings (template, position).  A text's
words are looked up; of those in the index the rarest (highest IDF) count, and
each votes with its IDF for (template, position of the template's start).  Votes
that agree on a start are an alignment; it stands if the agreeing rare words
carry a good share of the template's rare weight and all mandatory key phrases
of the template lie inside the aligned part (a few words of drift allowed).
Its score is the share of the template's words found in place.

Base phrases are counted exactly, wherever their words stand consecutively.

Templates are a bounded table broadcast with the task; texts are scanned in
place, whole, without a shuffle.  Defined cases: null texts have no words, no
label and score 0; a base phrase alone scores 1; repeated rows get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitelens.llm.common import map_texts, words_of

#: Phrases and labels of the base scan.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short public notices (label, text, mandatory key phrases).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at", ("apache license",)),
    ("apache", "Licensed under the Apache License", ("apache license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("gpl", "This work is licensed under the GNU General Public License", ("gnu general public license",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ("lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
     ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted", ("permission to use copy modify",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by",)),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
    ("reserved", "All rights reserved", ("all rights reserved",)),
)

RARE_SHARE = 0.5
DRIFT = 3
FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
                      + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("base_labels", "labels")]
                      + [T.StructField("score", T.DoubleType())])


class Index:
    """Words, IDF and postings of the templates and base phrases."""

    def __init__(self, templates=TEMPLATES, base=BASE, rare_words: int = 6) -> None:
        self.word_ids: dict[bytes, int] = {}

        def ids(text: str) -> list[int]:
            return [self.word_ids.setdefault(w, len(self.word_ids)) for w in words_of(text.encode())]

        self.base = [(ids(p), label) for p, label in base]
        self.templates = [(label, ids(text), [ids(k) for k in keys]) for label, text, keys in templates]
        df = Counter(w for _, t, _ in self.templates for w in set(t))
        n = len(self.templates)
        self.idf = {w: math.log((n + 1) / (df[w] + 0.5)) for w in self.word_ids.values()}
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.weight = []
        for k, (_, words, _) in enumerate(self.templates):
            # the rarest words of the template carry its votes
            rare = set(sorted(set(words), key=lambda w: (-self.idf[w], w))[:rare_words])
            self.weight.append(sum(self.idf[w] for w in words if w in rare))
            for pos, w in enumerate(words):
                if w in rare:
                    self.postings.setdefault(w, []).append((k, pos))
        self.voters = np.zeros(len(self.word_ids) + 1, bool)
        self.voters[list(self.postings)] = True

    def scan(self, data: bytes) -> tuple:
        words = words_of(data)
        get = self.word_ids.get
        none = len(self.word_ids)
        ids = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        places: list[int] = []
        base_labels: set[str] = set()
        for phrase, label in self.base:
            at = occurrences(ids, phrase)
            if len(at):
                places += at.tolist()
                base_labels.add(label)
        labels = set(base_labels)
        score = 1.0 if places else 0.0
        for k, start in self._alignments(ids):
            label, words_t, keys = self.templates[k]
            lo, hi = max(0, start - DRIFT), start + len(words_t) + DRIFT
            part = ids[lo:hi]
            if all(len(occurrences(part, key)) for key in keys):
                labels.add(label)
                inside = [(p, w) for p, w in enumerate(words_t) if 0 <= start + p < len(ids)]
                score = max(score, sum(ids[start + p] == w for p, w in inside) / len(words_t))
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                sorted(base_labels), sorted(labels), float(score))

    def _alignments(self, ids: np.ndarray):
        """(template, start) that enough rare words agree on, words of a drift's
        distance counted together; deterministic order."""
        votes: dict[tuple[int, int], float] = {}
        for pos in np.flatnonzero(self.voters[ids]).tolist():
            w = int(ids[pos])
            for k, at in self.postings[w]:
                votes[k, pos - at] = votes.get((k, pos - at), 0.0) + self.idf[w]
        for (k, start), v in sorted(votes.items()):
            near = sum(votes.get((k, start + d), 0.0) for d in range(-DRIFT, DRIFT + 1))
            if near >= RARE_SHARE * self.weight[k]:
                yield k, start


def occurrences(ids: np.ndarray, phrase: list[int]) -> np.ndarray:
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(ids[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


def scanned(docs: DataFrame, text_col: str = "text", result: str = "license", templates=TEMPLATES, base=BASE,
            carry_text: bool = True) -> DataFrame:
    """``docs`` with the struct column ``result``."""
    def make():
        index = Index(templates, base)

        def work(texts):
            rows = [index.scan(t.as_py()) for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(FIELDS)}
        return work

    return map_texts(docs, text_col, result, FIELDS, make, carry_text)

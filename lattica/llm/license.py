"""License scan by a positional index of rare words.

The words of all templates are counted over every text, which gives their inverse document
frequencies. Each text is looked up by its own license words of highest inverse document frequency: as many
as are needed so that those left out couldn't make up the least share of any template alone. Each of their
places, less the word's places in a template, lays the template there; laid templates are compared at all
relative positions, and one counts if words of most of the template's weight agree and the mandatory key
phrases of the license, its version among them, stand there.

Edge cases: a null text has no words; overlapping places of a phrase all count; a template may begin before
a text or end behind it, and what is missing doesn't agree; of equally rare words those first in hash order
are looked up, which no result depends on; equal rows get equal results; a very long text is a block of its own;
with no documents there are no rows; extra columns, whatever their names, are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from . import shared

# Phrases that decide a label alone.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Notices of public licenses, with the phrases that are all mandatory; they tell versions apart.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("the mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license 2 0", ("apache license 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license version 2 0", ("mozilla public license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("boost-1", "distributed under the boost software license version 1 0", ("boost software license version 1",)),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2",)),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("to deal in the software without restriction",)),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license version 2 0 january 2004",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "may be used to endorse or promote products derived from this software")),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", ("all advertising materials mentioning features or use of this software",)),
    ("mpl-2", "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software", ("mozilla public license version 2 0 1 definitions",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("the origin of this software must not be misrepresented",)),
    ("artistic-1", "the artistic license preamble the intent of this document is to state the conditions under which a package may be copied", ("the artistic license preamble the intent of this document",)),
    ("artistic-2", "the artistic license 2 0 copyright c 2000 2006 the perl foundation", ("the artistic license 2 0",)),
    ("artistic-2", "licensed under the artistic license 2 0", ("the artistic license 2 0",)),
    ("cddl-1", "common development and distribution license cddl version 1 0 1 definitions", ("common development and distribution license cddl version 1",)),
    ("cddl-1", "subject to the terms of the common development and distribution license version 1 0", ("common development and distribution license version 1",)),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license version 1 1",)),
    ("epl-1", "made available under the terms of the eclipse public license v 1 0", ("eclipse public license v 1 0",)),
    ("cc-by-3", "licensed under a creative commons attribution 3 0 unported license", ("creative commons attribution 3 0",)),
    ("cc-by-sa-3", "licensed under a creative commons attribution sharealike 3 0 unported license", ("creative commons attribution sharealike 3 0",)),
    ("cc-by-nc-3", "licensed under a creative commons attribution noncommercial 3 0 unported license", ("creative commons attribution noncommercial 3 0",)),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives 4 0",)),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("creative commons attribution noncommercial sharealike 4 0",)),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ("creative commons attribution noncommercial noderivatives 4 0",)),
)
LEAST = 0.6
#: Words around a laid template in which its key phrases may stand.
SLACK = 2


@dataclass
class Index:
    """Template words as codes in hash order, their weights, and the postings of all of them."""

    hashes: np.ndarray
    weights: np.ndarray
    templates: list[np.ndarray]
    postings: dict[int, list[tuple[int, int]]]
    keys: list[list[np.ndarray]]

    def __post_init__(self):
        self.order = np.argsort(-self.weights, kind="stable")
        self.totals = np.array([self.weights[t].sum() for t in self.templates])
        #: What each word, from the rarest, weighs in each template.
        self.shares = np.array([np.bincount(t, self.weights[t], len(self.weights)) for t in self.templates])[:, self.order] / self.totals[:, None]

    def rarest(self, present: np.ndarray) -> np.ndarray:
        """Rows by words: the rarest words present, so many that the others weigh less than ``LEAST`` of each template."""
        ranked = present[:, self.order]
        need = np.zeros(len(present), np.int64)
        for share in self.shares:
            behind = np.cumsum((ranked * share)[:, ::-1], axis=1)[:, ::-1]  # weight of this word and the commoner ones
            np.maximum(need, (behind >= LEAST - 1e-9).sum(axis=1), out=need)
        out = np.zeros_like(present)
        out[:, self.order] = ranked & (np.arange(present.shape[1]) < need[:, None])
        return out

    def laid(self, codes: np.ndarray, row: np.ndarray, first: np.ndarray) -> dict[int, dict[str, float]]:
        """By row, the labels of the templates that fit somewhere, with the largest share of weight that agrees."""
        rows = len(first) - 1
        at = np.flatnonzero(codes >= 0)
        present = np.zeros((rows, len(self.weights)), bool)
        present[row[at], codes[at]] = True
        at = at[self.rarest(present)[row[at], codes[at]]]
        own = codes[at]
        reach = max(map(len, self.templates)) + SLACK
        starts: list[list[np.ndarray]] = [[] for _ in self.templates]
        for code in np.unique(own).tolist():
            here = at[own == code]
            for k, place in self.postings[code]:
                starts[k].append(row[here] * (len(codes) + 2 * reach) + here - place + reach)
        out: dict[int, dict[str, float]] = {}
        for k, found in enumerate(starts):
            if not found:
                continue
            r, s = np.divmod(np.unique(np.concatenate(found)), len(codes) + 2 * reach)
            s -= reach
            lo, hi = first[r], first[r + 1]
            share = np.zeros(len(r))
            for j, code in enumerate(self.templates[k].tolist()):
                inside = (s + j >= lo) & (s + j < hi)
                share += self.weights[code] * (inside & (codes[np.clip(s + j, 0, len(codes) - 1)] == code))
            share /= self.totals[k]
            good = share >= LEAST - 1e-9
            for key in self.keys[k]:
                places = _places(codes, row, key)
                a, z = np.maximum(lo, s - SLACK), np.minimum(hi, s + len(self.templates[k]) + SLACK) - len(key)
                good &= np.searchsorted(places, a) < np.searchsorted(places, z, "right")
            label = TEMPLATES[k][0]
            for x, v in zip(r[good].tolist(), share[good].tolist(), strict=True):
                had = out.setdefault(x, {})
                had[label] = max(had.get(label, 0.0), min(v, 1.0))
        return out


def _vocabulary() -> list[str]:
    texts = [*BASE.values(), *(t for _, t, _ in TEMPLATES), *(k for _, _, ks in TEMPLATES for k in ks)]
    return sorted({w for t in texts for w in t.split()}, key=bs.word_hash)


def _codes(block: bs.Block, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each word of a block, -1 for others, and each row's first word."""
    h, first = bs.words(block, bs.ALNUM)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, at, -1).astype(np.int32), first


def build(docs: DataFrame, text: str = "text") -> Index:
    """Weigh the template words by their document frequencies over all rows."""
    shared.small_batches(docs.sparkSession)
    names = _vocabulary()
    hashes = np.array([bs.word_hash(w) for w in names], np.uint64)

    def count(batches):
        total = np.zeros(len(hashes) + 1, np.int64)
        for batch in batches:
            for block in bs.blocks(batch.column(0)):
                codes, first = _codes(block, hashes)
                row = np.repeat(np.arange(block.rows), np.diff(first))
                some = codes >= 0
                key = np.unique(row[some].astype(np.int64) * len(hashes) + codes[some])
                total[:-1] += np.bincount(key % len(hashes), minlength=len(hashes))
                total[-1] += block.rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["code", "n"])

    found = {r.code: r.n for r in docs.select(text).mapInArrow(shared.tidy(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}  # a row a word
    rows = found.get(len(names), 0)
    weights = np.log((rows + 1) / np.array([found.get(k, 0) + 0.5 for k in range(len(names))])) + 1e-3
    code = {w: k for k, w in enumerate(names)}
    as_codes = lambda t: np.array([code[w] for w in t.split()], np.int32)
    templates = [as_codes(t) for _, t, _ in TEMPLATES]
    postings: dict[int, list[tuple[int, int]]] = {}
    for k, words in enumerate(templates):
        for at, c in enumerate(words.tolist()):
            postings.setdefault(c, []).append((k, at))
    for c in range(len(names)):  # words of base phrases alone
        postings.setdefault(c, [])
    return Index(hashes, weights, templates, postings, [[as_codes(p) for p in ks] for _, _, ks in TEMPLATES])


def _places(codes: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = len(codes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(codes[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[codes[at + k] == phrase[k]]
    return at[row[at] == row[at + len(phrase) - 1]]


def scan(docs: DataFrame, index: Index, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    code = {w: k for k, w in enumerate(_vocabulary())}
    base = {label: np.array([code[w] for w in phrase.split()], np.int32) for label, phrase in BASE.items()}

    def run(batches):
        for batch in batches:
            for block in bs.blocks(batch.column(batch.num_columns - 1)):
                codes, first = _codes(block, index.hashes)
                row = np.repeat(np.arange(block.rows), np.diff(first))
                n_base = np.zeros(block.rows, np.int64)
                low, high = np.full(block.rows, np.iinfo(np.int64).max), np.full(block.rows, -1)
                of_base: list[set[str]] = [set() for _ in range(block.rows)]
                for label, phrase in base.items():
                    at = _places(codes, row, phrase)
                    own = row[at]
                    n_base += np.bincount(own, minlength=block.rows)
                    np.minimum.at(low, own, at - first[own])
                    np.maximum.at(high, own, at - first[own])
                    for r in np.unique(own):
                        of_base[r].add(label)
                found = index.laid(codes, row, first)
                method = [found.get(r, {}) for r in range(block.rows)]
                none = n_base == 0
                score = [1.0 if b else max(m.values(), default=0.0) for b, m in zip(of_base, method, strict=True)]
                cols = {
                    "n_words": pa.array(np.diff(first)), "n_base": pa.array(n_base), "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none),
                    "base_labels": pa.array([",".join(sorted(b)) for b in of_base]), "labels": pa.array([",".join(sorted(b | set(m))) for b, m in zip(of_base, method, strict=True)]), "score": pa.array(score, pa.float64()),
                }
                yield pa.RecordBatch.from_arrays([*(c.slice(block.first, block.rows) for c in batch.columns[:-1]), *cols.values()], [*batch.schema.names[:-1], *cols])

    return rows.mapInArrow(shared.tidy(run), f"{schema}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

"""License scans: an exact set-similarity join of text blocks with license notices."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_missing

#: Phrases whose every place is reported, by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Label, share of the notice's distinct words in percent that a block must hold, opening words of the notice.
#: Notices of one line differ by single words (version, attribution), so they have to be held whole.
NOTICES = [
    ("mit", 100, "released under the MIT License"),
    ("apache-2", 100, "licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", 100, "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", 100, "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", 100, "licensed under the GNU General Public License, version 3"),
    (
        "mit", 80,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "apache-2", 80,
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    (
        "bsd", 80,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "gpl", 80,
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mpl-2", 80,
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "isc", 80,
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
]

#: Blocks of the shortest notices start this many words apart.
LEAST_STEP = 8
#: Texts read together.
TEXTS = 256

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns every separator into a space.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: runs of letters, digits and everything beyond ASCII."""
    return text.translate(_FOLD).split()


class Templates:
    """Phrases and notices as sets of word ranks in one global order, rarest first, with the postings of their prefixes.

    A block that holds ``need`` of a template's words holds one of the first
    size - need + 1 in the global order, so only those are indexed.
    """

    def __init__(self, phrases: Mapping[str, str], notices: Sequence[tuple[str, int, str]], frequency: Mapping[bytes, int]):
        texts = [(label, 100, words_of(p.encode()), True) for label, p in phrases.items()]
        texts += [(label, percent, words_of(p.encode()), False) for label, percent, p in notices]
        texts = [t for t in texts if t[2]]
        self.words = sorted({w for t in texts for w in t[2]}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(self.words)}
        self.held = []
        self.postings = defaultdict(lambda: defaultdict(list))
        for n, (label, percent, words, exact) in enumerate(texts):
            ranks = sorted({self.rank[w] for w in words})
            need = -(-len(ranks) * percent // 100)
            self.held.append((label, words if exact else None, frozenset(ranks), need))
            step = max(LEAST_STEP, 1 << (len(words) - 1).bit_length())
            for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.postings[step][r].append((n, i))
        self.postings = {step: dict(p) for step, p in self.postings.items()}
        self.first = {step: {self.words[r] for r in p} for step, p in self.postings.items()}
        self.any_first = set().union(*self.first.values()) if self.first else set()

    def _block(self, words: list[bytes], step: int):
        """Templates that a block of words meets, with their overlap."""
        ranks = sorted({r for w in words if (r := self.rank.get(w)) is not None})
        inside, seen, postings = frozenset(ranks), set(), self.postings[step]
        for j, r in enumerate(ranks):
            for n, i in postings.get(r, ()):
                if n in seen:
                    continue
                size, need = len(self.held[n][2]), self.held[n][3]
                if len(ranks) < need or min(size - i, len(ranks) - j) < need:  # length and positional filters
                    continue
                seen.add(n)
                overlap = len(inside & self.held[n][2])
                if overlap >= need:
                    yield n, overlap

    def scan(self, words: list[bytes]):
        """Places of phrases (label, start, end) and blocks that hold a notice (label, start, end, share), in order."""
        places, blocks = [], []
        if self.any_first.isdisjoint(words):
            return places, blocks
        for step, first in self.first.items():
            near = {b for p, w in enumerate(words) if w in first for b in (p // step - 1, p // step) if b >= 0}
            for b in sorted(near):
                part = words[b * step : (b + 2) * step]
                for n, overlap in self._block(part, step):
                    label, phrase, ranks, _ = self.held[n]
                    if phrase is None:
                        blocks.append((label, b * step, b * step + len(part), overlap / len(ranks)))
                        continue
                    k = len(phrase)
                    places += [(label, b * step + i, b * step + i + k) for i in range(min(step, len(part) - k + 1)) if part[i : i + k] == phrase]
        return sorted(places, key=lambda p: (p[1], p[0])), sorted(blocks, key=lambda p: (p[1], p[0]))


def _texts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            yield part, part.column(1).cast("binary").to_pylist()


def _counted(vocabulary: frozenset):
    def run(batches):
        seen = Counter()
        for _, texts in _texts(batches):
            for text in texts:
                seen.update(filter(vocabulary.__contains__, words_of(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return run


_PLACE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_BLOCK = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))


def _scanned(templates: Templates):
    def run(batches):
        for part, texts in _texts(batches):
            n, places, blocks = [], [], []
            for text in texts:
                words = words_of(text or b"")
                p, b = templates.scan(words)
                n.append(len(words))
                places.append([dict(zip(("label", "start", "end"), x)) for x in p])
                blocks.append([dict(zip(("label", "start", "end", "share"), x)) for x in b])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(places, _PLACE), pa.array(blocks, _BLOCK)], names=["doc_id", "n_words", "places", "blocks"]
            )

    return run


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Sequence[tuple[str, int, str]] = NOTICES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, places, blocks.

    ``places`` lists (label, start, end) wherever a phrase's words stand one after
    the other, ``blocks`` lists (label, start, end, share) of every text block that
    holds the notice's share of distinct words; positions count words from 0.

    A text's blocks start every ``step`` words and are two steps long, where step
    is the notice's number of words, rounded up to a power of two: any stretch as
    long as a notice lies whole in a block. The join is exact. Words are ordered
    by their count in the whole corpus (one pass, grouped counts), only the rarest
    words of each template are indexed, and block and template meet only if their
    sizes and positions still allow the share; the overlap is then counted. A
    phrase is a template to be held whole, whose order is checked afterwards.
    The templates are the caller's list, so their index goes to the tasks; documents
    are neither shuffled nor cut, and memory is bounded by the longest text.

    Defined results: null and empty texts have no words; rows that repeat a doc_id
    are scanned each; rows without doc_id keep a null one; templates without words
    are met nowhere; other columns are ignored; no documents give no rows.
    """
    docs = with_missing(docs, doc_id="long", text="string")
    vocabulary = frozenset(Templates(phrases, notices, {}).words)
    counts = docs.mapInArrow(_counted(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    templates = Templates(phrases, notices, {bytes(r.word): r.n for r in counts.collect()})
    return docs.mapInArrow(
        _scanned(templates),
        "doc_id long, n_words long, places array<struct<label:string,start:long,end:long>>, blocks array<struct<label:string,start:long,end:long,share:double>>",
    )

"""License scan: an exact containment join of text blocks with license templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# The phrases that a license goes by, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public license texts and the notices that name them, and their labels.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-notice": "This library is licensed under the GNU Lesser General Public License",
    "agpl-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "warranty-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-sa-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
}
# Words that tell a short notice from those of its relatives: it has all of the first, and its block none of the second.
TELLING = {
    "apache-2.0-notice": ("apache 2", ""),
    "gpl-2.0-notice": ("gnu general 2", "lesser affero"),
    "gpl-3.0-notice": ("gnu general 3", "lesser affero"),
    "gpl-text": ("gnu general", "lesser affero"),
    "lgpl-notice": ("gnu lesser", ""),
    "agpl-notice": ("gnu affero", ""),
    "cc-by-text": ("creative commons attribution", "noncommercial sharealike noderivatives nc sa nd"),
    "cc-by-nc-text": ("creative commons noncommercial", ""),
    "cc-by-sa-text": ("creative commons sharealike", ""),
    "cc-by-nc-notice": ("cc nc", ""),
    "cc-by-sa-notice": ("cc sa", ""),
}


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z lowered: runs of 0-9, a-z and what is not ASCII."""
    return WORD.findall((text or "").encode().lower())


def block_size(n_words: int) -> int:
    """The words of a block for a template of so many words: a power of two, half of it no shorter than the template."""
    return 2 << max(3, (n_words - 1).bit_length())


def blocks_of(words: list[bytes], size: int) -> Iterator[tuple[int, set[bytes]]]:
    """(first word, word set) of overlapping blocks; any run of size / 2 + 1 words at most lies within one."""
    half = size // 2
    for i in range(0, max(1, len(words) - half), half):
        yield i, set(words[i : i + size])


def needed(n: int, percent: int) -> int:
    """The fewest of a template's n words that reach the threshold."""
    return -(-n * percent // 100)


class Join:
    """The templates, indexed by the prefixes of their words in one global order.

    order: every template word's place, the rarest first. A template of n words
    of which o are needed shares one of its n - o + 1 rarest with each block that
    contains enough of it, so only those are indexed, and only blocks around a
    document's prefix words are looked at.
    """

    def __init__(self, templates: dict[str, list[bytes]], order: dict[bytes, int], percent: int, telling: dict[str, tuple[str, str]] = TELLING):
        self.order = order
        self.sets = []
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for label, words in templates.items():
            ranked = sorted(set(words), key=order.__getitem__)
            need = needed(len(ranked), percent)
            for i, w in enumerate(ranked[: len(ranked) - need + 1]):
                self.prefixes.setdefault(w, []).append((len(self.sets), i))
            has, lacks = (frozenset(words_of(x)) for x in telling.get(label, ("", "")))
            self.sets.append((label, frozenset(ranked), len(ranked), need, block_size(len(words)), has, lacks))

    def matches(self, words: list[bytes]) -> Iterator[tuple[str, int, int, int]]:
        """(label, first word, words shared, words of the template) of every block of a text that contains enough of a template."""
        hits = self.prefixes.keys() & set(words)
        if not hits:
            return
        places: dict[bytes, list[int]] = {w: [] for w in hits}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        looked: set[tuple[int, int]] = set()
        sets: dict[tuple[int, int], tuple[set[bytes], dict[bytes, int]]] = {}
        for w in sorted(hits, key=self.order.__getitem__):
            for t, i in self.prefixes[w]:
                label, template, n, need, size, has, lacks = self.sets[t]
                half = size // 2
                last = (max(1, len(words) - half) - 1) // half  # the last block of blocks_of()
                for b in sorted({b for p in places[w] for b in (p // half - 1, p // half) if 0 <= b <= last}):
                    if (t, b) in looked:
                        continue
                    if (size, b) not in sets:
                        block = set(words[b * half : b * half + size])
                        sets[size, b] = block, {x: j for j, x in enumerate(sorted(block & self.order.keys(), key=self.order.__getitem__))}
                    block, place = sets[size, b]
                    # length filter; positional filter: what was passed, this word, and what is left on the shorter side
                    if len(place) < need or min(i, place[w]) + 1 + min(n - i, len(place) - place[w]) - 1 < need:
                        continue
                    looked.add((t, b))
                    shared = len(template & block)
                    if shared >= need and has <= block and lacks.isdisjoint(block):
                        yield label, b * half, shared, n


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """The word numbers at which the phrase stands in ' word word ... '."""
    found, at = [], joined.find(phrase)
    while at >= 0:
        found.append(joined.count(b" ", 0, at))
        at = joined.find(phrase, at + 1)
    return found


def template_word_counts(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> dict[bytes, int]:
    """How many documents have each word of the templates (0 for none): a few hundred counts."""
    vocabulary = {w for t in (templates or TEMPLATES).values() for w in words_of(t)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    sums = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r["word"]): r["n"] for r in sums.collect()}
    return {w: found.get(w, 0) for w in vocabulary}


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, matches array<struct<label:string,first_word:bigint,shared:int,needed:int,size:int>>"
)


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """Per document: its words, the places of license phrases, and every (block, template) pair of enough containment.

    Exact: |block & template| * 100 >= percent * |template|, over distinct words;
    a template's blocks are two to four times its length (block_size()), and short
    notices also need the words that tell them from their relatives (TELLING).
    labels has those of the phrases and of the templates; score is the largest
    containment of a template that was found, 1 with a phrase, else 0. matches
    lists each pair. A null or empty text has no words, nulls for places, empty
    labels and score 0. Each row of docs gives one; other columns are not read.
    """
    templates = templates or TEMPLATES
    split = {label: words_of(t) for label, t in templates.items()}
    if not all(split.values()):
        raise ValueError("a template must have words")
    counts = template_word_counts(docs, text, templates)
    order = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Join(split, order, percent)
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                places, base = [], set()
                joined = b" " + b" ".join(words) + b" "
                for phrase, label in phrases:
                    if found := _places(joined, phrase):
                        places += found
                        base.add(label)
                matches = [{"label": label, "first_word": i, "shared": s, "needed": needed(n, percent), "size": n} for label, i, s, n in join.matches(words)]
                score = 1.0 if base else max((m["shared"] / m["size"] for m in matches), default=0.0)
                rows.append((
                    doc, len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | {m["label"] for m in matches})), score, matches,
                ))
            kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("shared", pa.int32()), ("needed", pa.int32()), ("size", pa.int32())]))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), kind]
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types)], SCHEMA_NAMES)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


SCHEMA_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

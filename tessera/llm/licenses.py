"""License notices: literal phrases, and an exact set-similarity join of text blocks with notice templates.

A block is a window of consecutive words, wherever lines end, of at most as many words as the template's divided by the
threshold. A template matches a block that holds at least ``THRESHOLD`` of its distinct tokens, among them those that
name the license. Each template's tokens are ordered by their number in all documents, rarest first. A text that has a
matching block must hold one of the first |T| - need + 1 of them (prefix filter), must have ``need`` of the tokens in
all (length filter), and, when the first one it holds is at place i, at least ``need`` must be left from there on
(position filter). Only texts that pass are searched, so no match is lost and few texts are looked at. Of blocks of a
template that overlap the one with the most tokens counts, then the shortest. Blocks of several templates may overlap
and all count; one gives way only where its license is named as part of a longer name (``Index.matches``). Templates are a table of a stated size that goes to every task; documents never
leave theirs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

class Template(NamedTuple):
    label: str
    text: str
    #: Tokens that a block must hold.
    named: tuple[str, ...] = ()


#: The published texts of short licenses, and notices as projects print them.
TEMPLATES: tuple[Template, ...] = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
software must not be misrepresented; you must not claim that you wrote the original software."""),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache",)),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ("gnu", "general")),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", ("gnu", "lesser", "general")),
    Template("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""", ("gnu", "affero", "general")),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla",)),
    Template("mit", "Released under the MIT License.", ("mit", "license")),
    Template("mit", "Licensed under the MIT License.", ("mit", "license")),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    Template("gpl", "Licensed under the GNU General Public License, version 3.", ("gnu", "general")),
    Template("gpl", "Released under the GPL License.", ("gpl",)),
    Template("gpl", "Licensed under the GPL License.", ("gpl",)),
    Template("lgpl", "Licensed under the GNU Lesser General Public License.", ("gnu", "lesser", "general")),
    Template("agpl", "Licensed under the GNU Affero General Public License.", ("gnu", "affero", "general")),
    Template("bsd", "Licensed under the BSD License.", ("bsd",)),
    Template("bsd", "Released under the BSD License.", ("bsd",)),
    Template("mpl", "Licensed under the Mozilla Public License.", ("mozilla",)),
    Template("cc-by", "Licensed under CC BY 4.0.", ("cc", "by")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc")),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc", "by", "sa")),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0.", ("cc", "by", "nd")),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", ("cc", "by", "nc", "sa")),
    Template("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0.", ("cc", "by", "nc", "nd")),
    Template("cc-by", "Licensed under the Creative Commons Attribution License.", ("creative", "commons")),
    Template("cc-by-sa", "Licensed under the Creative Commons Attribution-ShareAlike License.", ("creative", "commons", "sharealike")),
    Template("cc-by-nc", "Licensed under the Creative Commons Attribution-NonCommercial License.", ("creative", "commons", "noncommercial")),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons")),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "sharealike")),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "commons", "noncommercial")),
    Template("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ("creative", "commons", "noderivatives")),
    Template("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ("creative", "commons", "noncommercial", "sharealike")),
    Template("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ("creative", "commons", "noncommercial", "noderivatives")),
)
THRESHOLD = 0.8
#: More templates than this are refused, as all go to every task.
MOST_TEMPLATES = 20_000

#: A-Z becomes lower case; other ASCII but digits and letters parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Match(NamedTuple):
    template: int
    first: int
    n_words: int
    shared: int


class Index:
    """Templates by the tokens of their prefixes."""

    def __init__(self, templates: Sequence[Template], threshold: float, counts: Mapping[bytes, int]):
        self.labels = [t.label for t in templates]
        self.tokens = [sorted(set(words_of(t.text.encode())), key=lambda w: (counts.get(w, 0), w)) for t in templates]
        self.sets = [frozenset(t) for t in self.tokens]
        self.named = [frozenset(w.encode() for w in t.named) for t in templates]
        self.need = [max(1, math.ceil(round(threshold * len(t), 9))) for t in self.tokens]
        self.reach = [math.ceil(len(words_of(t.text.encode())) / threshold) for t in templates]
        self.by_token: dict[bytes, list[tuple[int, int]]] = {}
        for k, (tokens, need) in enumerate(zip(self.tokens, self.need, strict=True)):
            for place, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.by_token.setdefault(token, []).append((k, place))
        self.prefixes = frozenset(self.by_token)
        self.every = frozenset().union(*self.sets)

    def _candidates(self, held: frozenset[bytes]) -> list[int]:
        """Templates that a text with these of the templates' tokens may hold."""
        seen: dict[int, int] = {}
        for token in held & self.prefixes:
            for k, place in self.by_token[token]:
                seen[k] = min(place, seen.get(k, place))
        return [k for k, place in sorted(seen.items()) if len(self.tokens[k]) - place >= self.need[k] and self.named[k] <= held and len(self.sets[k] & held) >= self.need[k]]

    def blocks(self, words: list[bytes]) -> list[Match]:
        """The best block of each group of overlapping blocks that reach a template, for each template."""
        if self.prefixes.isdisjoint(words):
            return []
        found = self._candidates(self.every.intersection(words))
        wanted = frozenset().union(*[self.sets[k] for k in found])
        places = [(at, word) for at, word in enumerate(words) if word in wanted] if found else []
        return [m for k in found for m in self._windows(k, [(at, word) for at, word in places if word in self.sets[k]])]

    def _windows(self, k: int, places: list[tuple[int, bytes]]) -> Iterator[Match]:
        reach, need, named = self.reach[k], self.need[k], self.named[k]
        counts: dict[bytes, int] = {}
        last: dict[bytes, int] = {}
        left, best, end = 0, None, -1
        for at, word in places:
            counts[word] = counts.get(word, 0) + 1
            last[word] = at
            while at - places[left][0] >= reach:
                gone = places[left][1]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone], last[gone]
                left += 1
            if len(counts) < need or not named <= counts.keys():
                continue
            if best and places[left][0] > end:
                yield Match(k, -best[2], -best[1], best[0])
                best = None
            start, end = min(last.values()), at  # without words that the block holds again
            best = max(best or (0, 0, 0), (len(counts), start - at - 1, -start))
        if best:
            yield Match(k, -best[2], -best[1], best[0])

    def naming_spans(self, words: list[bytes], m: Match) -> list[tuple[int, int]]:
        """The shortest runs of a block's words that hold all tokens that name its license: first and last word."""
        named, last, out = self.named[m.template], {}, []
        for at in range(m.first, m.first + m.n_words):
            if words[at] in named:
                last[words[at]] = at
                if len(last) == len(named):
                    start = min(last.values())
                    if out and out[-1][0] == start:
                        continue  # an earlier run with this start is shorter
                    out.append((start, at))
        return out

    def matches(self, words: list[bytes]) -> list[Match]:
        """All blocks, but for those whose license is named only as part of a longer name that another block has.

        CC BY is named by CC BY-SA, and the GNU General License by its Lesser one: a block gives way where each run of words
        that names it lies within one that names a license with all of its naming tokens and more.
        """
        found = self.blocks(words)
        spans = [self.naming_spans(words, m) for m in found]

        def stands(k: int) -> bool:
            own = self.named[found[k].template]
            longer = [x for o, held in zip(found, spans, strict=True) if self.named[o.template] > own for x in held]
            return not spans[k] or any(all(a < c or d < b for c, d in longer) for a, b in spans[k])

        return sorted((m for k, m in enumerate(found) if stands(k)), key=lambda m: (m.first, m.template))


def token_counts(docs: DataFrame, templates: Sequence[Template]) -> dict[bytes, int]:
    """How often each token of the templates occurs in all documents; as many numbers come back as templates have tokens."""
    wanted = frozenset(t for template in templates for t in words_of(template.text.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(filter(wanted.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    texts = docs.where(F.col("text").isNotNull()).select(F.col("text").cast("binary").alias("text"))
    return {bytes(r.token): r.n for r in texts.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


def _phrase_places(words: list[bytes], phrases: Mapping[str, str]) -> dict[str, list[int]]:
    """Where each phrase's words stand one after the other."""
    out: dict[str, list[int]] = {}
    for phrase in phrases:
        parts = [p.encode() for p in phrase.split()]
        at = [k for k in range(len(words) - len(parts) + 1) if words[k] == parts[0] and words[k : k + len(parts)] == parts]
        if at:
            out[phrase] = at
    return out


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,template:int,first_word:long,n_words:long,containment:double>>"


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: word count, places and labels of phrases, labels of both kinds, and the matching blocks.

    score is the largest share of a template's tokens in a matching block, 1 where a phrase stands, else 0. Null and
    empty texts have no words, a null doc_id stays null, texts of any length are read whole. Repeated rows are scanned
    as often; an empty table gives an empty result.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates do not go to every task")
    index = Index(templates, threshold, token_counts(docs, templates))
    needed = frozenset(p.split()[-1].encode() for p in phrases)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(match)]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                words = words_of(text)
                base = {} if needed.isdisjoint(words) else _phrase_places(words, phrases)
                found = [(index.labels[m.template], m.template, m.first, m.n_words, m.shared / len(index.tokens[m.template])) for m in index.matches(words)]
                places = [p for at in base.values() for p in at]
                named = {phrases[p] for p in base}
                score = 1.0 if places else max((f[4] for f in found), default=0.0)
                spans = [dict(zip(("label", "template", "first_word", "n_words", "containment"), f, strict=True)) for f in found]
                rows.append((key, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(named)), ",".join(sorted(named | {f[0] for f in found})), score, spans))
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(one, _SCHEMA)

"""Licence scan by a positional index of rare licence words.

Templates are the usual short notices and the whole texts below, cut into
clauses. Their words form an index: word -> (clause, position). One pass over
all texts counts in how many each of these words occurs. A clause is posted
under its rarest words (highest inverse document frequency), so many that a
place that holds the share SHARE of the clause's weight has two of them. A
file's words are looked up, the postings of each clause intersected by the
place at which it would begin, and every place with two or more is verified
word by word. A notice's label needs its clause and its mandatory phrases; a
whole text's label needs clauses with the share SHARE of the text's weight and
its mandatory phrases. The three base phrases are found everywhere,
independently of that.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import text_of
from cairn.llm.words import ascii_words

#: Share of a clause's or text's weight that must stand in place, and words a phrase may be off.
SHARE, DRIFT = 0.6, 3

# Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, mandatory phrases. Opening words of public licence texts and the usual one-line notices.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2.0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", ["apache org licenses"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted", "without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["general public license", "version 2"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["general public license", "version 3"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4.0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]


# Label, public licence text as published (without title, copyright line and placeholders), mandatory phrases.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ["sublicense and or sell copies"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ["with or without fee"]),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ["redistributions of source code", "redistributions in binary form"]),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ["redistributions of source code", "to endorse or promote products"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""", ["must not be misrepresented"]),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ["machine executable object code"]),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ["overt act of relinquishment"]),
]
#: Words of a clause: an inserted or lost word shifts what stands behind it, so long sentences are cut.
CLAUSE = 24


def _phrase(text: str) -> bytes:
    return b" " + b" ".join(ascii_words(text)) + b" "


def _clauses(text: str) -> list[list[bytes]]:
    """The sentences and lines of a text, in parts of at most CLAUSE words about equally long."""
    out = []
    for sentence in re.split(r"(?<=[.:;])\s+|\n", text):
        words = ascii_words(sentence)
        parts = -(-len(words) // CLAUSE)
        cuts = [len(words) * i // max(parts, 1) for i in range(parts + 1)]
        out += [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    # one or two words say nothing by themselves
    return [c for c in out if len(c) > 2]


class Index:
    """Postings of the clauses' words; idf: of each word over the corpus."""

    def __init__(self, idf: dict[bytes, float] | None = None):
        self.idf = idf or {}
        self.clauses: list[list[bytes]] = []
        #: label, numbers of its clauses, mandatory phrases, whether these have to stand at the clause
        self.templates: list[tuple[str, list[int], list[bytes], bool]] = []
        number: dict[tuple, int] = {}
        for label, text, phrases, near in [*((*x, True) for x in NOTICES), *((*x, False) for x in TEXTS)]:
            own = []
            for words in [ascii_words(text)] if near else _clauses(text):
                if (key := tuple(words)) not in number:
                    number[key] = len(self.clauses)
                    self.clauses.append(words)
                own.append(number[key])
            self.templates.append((label, own, [_phrase(p) for p in phrases], near))
        self.vocabulary = {w for words in self.clauses for w in words}
        of = lambda w: self.idf.get(w, 1.0)
        self.weights = [[of(w) for w in words] for words in self.clauses]
        self.weight = [sum(w) for w in self.weights]
        self.needed = []
        self.postings = defaultdict(list)
        for n, words in enumerate(self.clauses):
            held, most, posted = 0.0, 0.0, 0
            for at in sorted(range(len(words)), key=lambda i: (-of(words[i]), i)):
                # what is posted but for its heaviest word outweighs what a place may lack, so a place has two of them
                if held - most > (1 - SHARE + 1e-9) * self.weight[n]:
                    break
                self.postings[words[at]].append((n, at))
                held, most, posted = held + of(words[at]), max(most, of(words[at])), posted + 1
            self.needed.append(2 if held - most > (1 - SHARE + 1e-9) * self.weight[n] else 1)

    def places(self, words: list[bytes]) -> dict[int, list[tuple[int, float]]]:
        """clause -> (begin, share of its weight) of each place that holds SHARE of it."""
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for at, w in enumerate(words):
            for n, place in self.postings.get(w, ()):
                votes[n, at - place] += 1
        found = defaultdict(list)
        for (n, begin), hits in votes.items():
            if hits >= self.needed[n]:
                clause, weights = self.clauses[n], self.weights[n]
                share = sum(weights[i] for i, w in enumerate(clause) if 0 <= begin + i < len(words) and words[begin + i] == w) / self.weight[n]
                if share >= SHARE:
                    found[n].append((begin, share))
        return found

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """(labels, best share of a template's weight) of a text."""
        found = self.places(words)
        labels, best = set(), 0.0
        if not found:
            return labels, best
        line = None
        for label, own, phrases, near in self.templates:
            if near:
                n = own[0]
                for begin, share in found.get(n, ()):
                    around = b" " + b" ".join(words[max(0, begin - DRIFT) : begin + len(self.clauses[n]) + DRIFT]) + b" "
                    if all(p in around for p in phrases):
                        labels.add(label)
                        best = max(best, share)
            elif any(n in found for n in own):
                share = sum(self.weight[n] * max(s for _, s in found[n]) for n in own if n in found) / sum(self.weight[n] for n in own)
                if share >= SHARE:
                    line = line or b" " + b" ".join(words) + b" "
                    if all(p in line for p in phrases):
                        labels.add(label)
                        best = max(best, share)
        return labels, best


def word_counts(docs: DataFrame) -> dict[bytes, float]:
    """idf of each licence word over all texts (the highest for words that none has). The result has a row per word of the templates at most."""

    def run(batches):
        vocabulary, found, n = Index().vocabulary, defaultdict(int), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in vocabulary.intersection(ascii_words(text)):
                    found[w] += 1
        yield pa.record_batch([pa.array([*found, b""], pa.binary()), pa.array([*found.values(), n], pa.int64())], names=["word", "n"])

    counts = docs.select(text_of("text").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r.word): r.n for r in counts.collect()}
    total = counts.pop(b"", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 0.1 for w in Index().vocabulary}


_FIND = [(re.compile(b"(?= " + p.encode() + b" )"), label) for p, label in BASE.items()]


def _scan(idf: dict[bytes, float]):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        index = Index(idf)
        vocabulary = {*index.vocabulary, b"reserved"}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some, out = batch.slice(at, 2048), []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    words = ascii_words(text)
                    present, places, base = vocabulary.intersection(words), [], set()
                    if b"by" in present or b"reserved" in present or b"license" in present:
                        line = b" " + b" ".join(words) + b" "
                        for pattern, label in _FIND:
                            nth = last = 0
                            for m in pattern.finditer(line):
                                nth, last = nth + line.count(b" ", last, m.start()), m.start()
                                places.append(nth)
                                base.add(label)
                    labels, score = index.scan(words) if len(present) > 1 else (set(), 0.0)
                    out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), min(1.0, score) if labels else 1.0 if base else 0.0))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], names=names)

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: no words, empty labels, score 0. The score is the
    best share of a template's weight found in place, 1 for a base phrase alone.
    Rows do not depend on each other, so repeated ids and rows keep their
    verdicts; a text of any length is scanned whole; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return rows.mapInArrow(_scan(word_counts(docs)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

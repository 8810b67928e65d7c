"""Licence statements in documents: Dice coefficient of word bigrams with licence templates.

A stretch of words matches a template if 2 * common / (bigrams of both) reaches the threshold.
Of a document's words only those stretches are compared whose length can reach it (with t the
threshold, between t / (2 - t) and (2 - t) / t times the template's), and of the templates only
those of which the document has enough bigrams for any stretch to reach it.
The threshold depends on the template's size: one changed word of a short statement still matches,
if the stretch has the words that name the licence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import text_slices
from fleetlens.llm.common import text_or_empty

THRESHOLD = 0.9
LEAST_BIGRAMS = 4           # shorter templates have to match in full
WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*")

# Public licence statements and notices by their SPDX names.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0
        International License.""",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0
        International License.""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms
        of the GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version.""",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
}
SOFTWARE_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
    NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
    EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
    ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
    OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted
    provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
    the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
    other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission."""
BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
    OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES |= {
    "MIT notice text": f"{TEMPLATES['MIT notice']} {SOFTWARE_AS_IS}",
    "ISC notice text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause notice text": f"{BSD_CONDITIONS} {BSD_AS_IS}",
    "BSD-3-Clause notice text": f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_AS_IS}",
    "MIT licensed notice": "Licensed under the MIT License.",
    "MIT project notice": "This project is licensed under the terms of the MIT license.",
    "Apache-2.0 short notice": "Licensed under the Apache License 2.0.",
    "Apache-2.0 released notice": "Released under the Apache License, Version 2.0.",
    "ISC licensed notice": "Licensed under the ISC License.",
    "GPL-2.0 licensed notice": "Licensed under the GNU General Public License v2.0.",
    "GPL-3.0 licensed notice": "Licensed under the GNU General Public License v3.0.",
    "LGPL-3.0 licensed notice": "Licensed under the GNU Lesser General Public License v3.0.",
    "MPL-2.0 licensed notice": "Licensed under the Mozilla Public License 2.0.",
}

TEMPLATES["All-rights-reserved notice"] = "All rights reserved."
NO_LICENSE = frozenset({"All-rights-reserved"})     # among the matches, but grants nothing: never the licence

# Words of which a stretch that is not verbatim must have at least one of each tuple.
NAMED: dict[str, list[tuple[str, ...]]] = {
    "Apache-2.0": [("apache",)], "BSD-2-Clause": [("bsd",), ("2-clause",)], "BSD-3-Clause": [("bsd",), ("3-clause",)],
    "CC0-1.0": [("cc0",)], "CC-BY-4.0": [("by", "attribution"), ("4.0",)],
    "CC-BY-NC-4.0": [("by-nc", "attribution-noncommercial"), ("4.0",)],
    "CC-BY-SA-4.0": [("by-sa", "attribution-sharealike"), ("4.0",)], "GPL-2.0": [("gnu",), ("general",), ("2", "v2.0")],
    "GPL-3.0": [("gnu",), ("general",), ("3", "v3.0")], "ISC": [("isc",)],
    "LGPL-3.0": [("gnu",), ("lesser",), ("3", "v3.0")], "MIT": [("mit",)], "MPL-2.0": [("mozilla",)],
    "Proprietary": [("reserved",)],
}


def words_of(text: str) -> list[re.Match]:
    return list(WORD.finditer(text))


def normal(word: str) -> str:
    return word.lower().replace("’", "'")


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float | None = None):
        """One threshold for all templates, or one by the size of each."""
        self.threshold = threshold
        self.bigrams, self.sizes, self.ends = {}, {}, {}
        self.holders: dict[tuple[str, str], list[str]] = {}
        for name, text in templates.items():
            words = [normal(m[0]) for m in words_of(text)]
            bag = Counter(zip(words, words[1:]))
            self.bigrams[name], self.sizes[name], self.ends[name] = bag, sum(bag.values()), (words[0], words[-1])
            for pair in bag:
                self.holders.setdefault(pair, []).append(name)

    def limit(self, name: str) -> float:
        """The threshold: two bigrams, those of one changed word, may differ in short templates."""
        if self.threshold is not None:
            return self.threshold
        n = self.sizes[name]
        return THRESHOLD if n < LEAST_BIGRAMS else min(THRESHOLD, 1 - 2 / n)

    def bounds(self, name: str) -> tuple[int, int]:
        """Sizes in bigrams that a stretch similar to the template can have."""
        t, n = self.limit(name), self.sizes[name]
        low = int(np.ceil(n * t / (2 - t) - 1e-9))
        if t < THRESHOLD and self.threshold is None:
            # one word more or less, or the word beside the first or last changed
            return max(low, n - 2), min(int(np.floor(n * (2 - t) / t + 1e-9)), n + 1)
        return max(low, 1), int(np.floor(n * (2 - t) / t + 1e-9))

    def matches(self, text: str) -> list[tuple[str, float, int, int]]:
        """(name, Dice, first character, end) of the best stretches, in text order, without
        overlaps: where stretches overlap the most similar stays, of these the longest."""
        words = words_of(text)
        plain = [normal(m[0]) for m in words]
        places: dict[str, list[int]] = {}
        pairs = list(zip(plain, plain[1:]))
        for i, pair in enumerate(pairs):
            for name in self.holders.get(pair, ()):
                places.setdefault(name, []).append(i)
        found = []
        for name, at in places.items():
            low, high = self.bounds(name)
            n, bag, limit = self.sizes[name], self.bigrams[name], self.limit(name)
            named = NAMED.get(name.split()[0], []) if self.threshold is None and limit < THRESHOLD else []
            if sum(min(c, bag[p]) for p, c in Counter(pairs[i] for i in at).items()) * 2 < limit * (n + low) - 1e-9:
                continue
            # a best stretch begins and ends with a bigram of the template
            for x, begin in enumerate(at):
                left, same = dict(bag), 0
                for y in range(x, min(len(at), bisect_left(at, begin + high))):
                    pair = pairs[at[y]]
                    if left[pair]:
                        left[pair] -= 1
                        same += 1
                    size = at[y] - begin + 1
                    dice = 2 * same / (n + size)
                    if dice < limit - 1e-9:
                        continue
                    if named and size < n - 1 and plain[max(begin - 2, 0)] != self.ends[name][0] and \
                            plain[min(at[y] + 3, len(plain) - 1)] != self.ends[name][1]:
                        continue        # a mention, not the statement
                    if all(any(w in plain[begin:at[y] + 2] for w in choice) for choice in named):
                        found.append((-dice, -size, begin, name, at[y] + 1))
        kept: list[tuple[str, float, int, int]] = []
        for dice, _, begin, name, last in sorted(found):
            span = words[begin].start(), words[last].end()
            if all(span[1] <= a or span[0] >= b for _, _, a, b in kept):
                kept.append((name, round(-dice, 6), *span))
        return sorted(kept, key=lambda m: m[2])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license (of the most similar match, null if none), score (its Dice coefficient, 0.0 if
    none), n_matches, and matches (name, score, start, end in characters) of every row of
    ``docs``.

    Text is normalised to words in lower case; a template's name up to the first space is its
    licence; a notice in NO_LICENSE is only listed in matches. Ties go to the earlier match. Null and empty texts have no match; null ids stay
    null; repeated rows give equal rows; the whole text is searched, whatever its length.
    """
    kind = pa.list_(pa.struct([("name", pa.string()), ("score", pa.float64()), ("start", pa.int64()),
                               ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for part in text_slices(batches, "text"):
            every = [scanner.matches(t) for t in part.column("text").to_pylist()]
            granted = [[x for x in m if x[0].split()[0] not in NO_LICENSE] for m in every]
            best = [max(m, key=lambda x: (x[1], -x[2])) if m else None for m in granted]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([b and b[0].split()[0] for b in best], pa.string()),
                 pa.array([b[1] if b else 0.0 for b in best], pa.float64()),
                 pa.array([len(m) for m in every], pa.int64()),
                 pa.array([[dict(zip(("name", "score", "start", "end"), x)) for x in m] for m in every], kind)],
                names=["id", "license", "score", "n_matches", "matches"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(
        run, "id long, license string, score double, n_matches long, "
             "matches array<struct<name: string, score: double, start: long, end: long>>"
    ).withColumnRenamed("id", id_col)

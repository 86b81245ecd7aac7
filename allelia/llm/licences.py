"""Licence scans with a positional index of rare words.

A first pass counts over all documents how many hold each licence word. For every template the words with the highest
IDF (at most ``RARE``) and the rarest word of its mandatory key phrases, which every counted place holds, are looked up in the postings of the file; each posting proposes a relative position, and a proposal is scored
by the share of template words that stand where they belong. It counts when the score reaches ``share`` and every
mandatory key phrase of the template stands in its place. The base phrases are templates whose words are all mandatory.

Null and empty texts have no words, no places, no labels and score 0. Ties of rarity go to the earlier word. Repeated rows are judged
alike, a long text is one block, an empty table gives an empty one. Other columns stay; those called like an added one are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import Words, blocks, word_hashes

RARE = 3
SHARE = 0.8
#: Fixed values of the contract: phrase and label.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Opening words of licence texts, label, mandatory key phrases.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ("permission is hereby granted free of charge",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ("with or without fee is hereby granted",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ("redistribution and use in source and binary forms",)),
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license",)),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ("gnu general public license version 3",)),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ("gnu general public license",)),
    ("gnu lesser general public license", "lgpl", ("gnu lesser general public license",)),
    ("gnu affero general public license", "agpl", ("gnu affero general public license",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ("mozilla public license",)),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ("cc by nc 4 0",)),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ("cc by sa 4 0",)),
    ("licensed under cc by 4 0", "cc-by-4.0", ("cc by 4 0",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("released into the public domain",)),
    ("released under the mit license", "mit", ("mit license",)),
)
#: Bodies of licences and notices whole, label, mandatory key phrases.
TEXTS = (
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit",
        ("the above copyright notice and this permission notice shall be included",),
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
        "bsd-3-clause",
        ("may be used to endorse or promote products",),
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "isc",
        ("and the author disclaims all warranties",),
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache-2.0",
        ("apache license version 2 0",),
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "gpl-3.0-or-later",
        ("either version 3 of the license",),
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission
        is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
        notice may not be removed or altered from any source distribution.""",
        "zlib",
        ("altered source versions must be plainly marked",),
    ),
)


def _words(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


class Index:
    """Templates as term ids of the sorted licence vocabulary."""

    def __init__(self):
        templates = TEMPLATES + TEXTS
        texts = self.texts = [p.split() for p, _ in BASE] + [_words(t) for t, _, _ in templates]
        self.labels = [x for _, x in BASE] + [x for _, x, _ in templates]
        self.vocab = np.unique(word_hashes(sorted({w for t in texts for w in t})))
        self.terms = [np.searchsorted(self.vocab, word_hashes(t)) for t in texts]
        self.must = [np.ones(len(t), bool) for t in texts]
        for k, (_, _, phrases) in enumerate(templates, len(BASE)):
            self.must[k][:] = False
            for phrase in map(str.split, phrases):
                at = next(i for i in range(len(texts[k])) if texts[k][i : i + len(phrase)] == phrase)
                self.must[k][at : at + len(phrase)] = True

    def weigh(self, documents: int, holding: dict[int, int]) -> None:
        idf = np.array([math.log((documents + 1) / (holding.get(int(h.view(np.int64)), 0) + 1)) for h in self.vocab])
        order = [np.argsort(-idf[t], kind="stable") for t in self.terms]
        self.rare = [np.unique(np.append(o[: 1 if k < len(BASE) else RARE], o[must[o]][:1])) for k, (o, must) in enumerate(zip(order, self.must))]

    def terms_of(self, hashes: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[k] == hashes, k, -1)

    def scan(self, term: np.ndarray, first: np.ndarray, share: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each template: row, start word and score of its places."""
        known = np.flatnonzero(term >= 0)
        posting = known[np.argsort(term[known], kind="stable")]
        at = np.searchsorted(term[posting], np.arange(len(self.vocab) + 1))
        out = []
        for want, must, rare in zip(self.terms, self.must, self.rare):
            start = np.concatenate([posting[at[want[r]] : at[want[r] + 1]] - r for r in rare.tolist()])
            row = np.concatenate([np.searchsorted(first, posting[at[want[r]] : at[want[r] + 1]], "right") - 1 for r in rare.tolist()])
            pair = np.unique(np.stack([row, start]), axis=1)
            row, start = pair[0], pair[1]
            fine, found = np.ones(len(row), bool), np.zeros(len(row), np.int64)
            for k in range(len(want)):
                p = start + k
                hit = (p >= first[row]) & (p < first[row + 1])
                hit[hit] = term[p[hit]] == want[k]
                found += hit
                if must[k]:
                    fine &= hit
            score = found / len(want)
            ok = fine & (score >= share)
            out.append((row[ok], np.maximum(start[ok], first[row[ok]]), score[ok]))
        return out


def _index(docs: DataFrame) -> Index:
    index = Index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(len(index.vocab), np.int64), 0
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(0)):
                words = Words(data, offs)
                term = index.terms_of(words.hash)
                at = np.flatnonzero(term >= 0)
                row = np.searchsorted(words.first, at, "right") - 1
                n += np.bincount(np.unique(row * len(index.vocab) + term[at]) % len(index.vocab), minlength=len(n))
                rows += b - a
        yield pa.RecordBatch.from_arrays([pa.array([*index.vocab.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), rows], pa.int64())], names=["term", "n"])

    found = {r.term: r.n for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    index.weigh(found.pop(None, 0), found)
    return index


PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())])


def scan(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """Add n_words and places array<struct<label, start word, score, base>> to each document."""
    index = _index(docs)
    keep = [c for c in docs.columns if c not in ("n_words", "places")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE))])
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a, b, data, offs in blocks(get("text")):
                words = Words(data, offs)
                places = [[] for _ in range(b - a)]
                for k, (row, start, score) in enumerate(index.scan(index.terms_of(words.hash), words.first, share)):
                    for r, s, x in zip(row.tolist(), (start - words.first[row]).tolist(), score.tolist()):
                        places[r].append({"label": index.labels[k], "start": s, "score": x, "base": k < len(BASE)})
                yield pa.RecordBatch.from_arrays([get(c).slice(a, b - a) for c in keep] + [pa.array(words.counts(), pa.int64()), pa.array(places, kind)], names=[*keep, "n_words", "places"])

    return docs.select(*keep).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    start = F.transform(base, lambda p: p["start"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))

"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file is split into segments (lines, and sentences in them); each, and the whole
file, is compared with license templates: statements, standard headers, whole
texts of short licenses and SPDX tags. A match of the whole file goes before one
of its sentences. IDF comes from how many files of the
corpus have each template token (a table bounded by the templates); a token
outside of all templates counts as one that no file has. The files that are
mostly a license (``FILE_SHARE`` of their tokens, or the whole text matches)
license their directory; a file without a license of its own takes that of the
nearest directory above it. Directories, not files, are joined by path, so a
large directory adds one row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NOT_ALNUM, Words, batches_of, chunks, store

THRESHOLD = 0.7
FILE_SHARE = 0.25
# Customary license statements.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
]
# Whole texts of short licenses, and parts that several of them have.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
WHOLE = [
    ("MIT", f"""MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"""),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAME} {_BSD_END}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    *((f"GPL-{v}.0", f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""") for v in (2, 3)),
]
TEMPLATES += WHOLE + [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES + WHOLE} - {"Proprietary"})]


class Segments:
    """Token hashes of texts with the document and the segment of each."""

    def __init__(self, texts: list[str | None]):
        self.w = w = Words([t.lower() if t else t for t in texts], white=NOT_ALNUM)
        self.hash = w.hashes()
        b = w.buf
        stop = (b == 46) | (b == 33) | (b == 63)
        ends = b == 10
        ends[:-1] |= stop[:-1] & ((b[1:] == 32) | (b[1:] == 10))
        self.segment = np.cumsum(ends)[w.starts] if len(w.starts) else np.zeros(0, np.int64)


class Matcher:
    """Template vectors over the template vocabulary."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[int, int] | None = None, n: int = 0):
        t = Segments([x for _, x in templates])
        self.names = [name for name, _ in templates]
        self.vocabulary = np.unique(t.hash)
        self.top = np.log(1 + n) + 1
        self.idf = np.array([np.log((1 + n) / (1 + (df or {}).get(int(h.view(np.int64)), 0))) + 1 for h in self.vocabulary])
        self.vectors = []
        for i in range(len(templates)):
            v = {k: c * self.idf[k] for k, c in Counter(np.searchsorted(self.vocabulary, t.hash[t.w.doc == i]).tolist()).items()}
            norm = sum(x * x for x in v.values()) ** 0.5
            self.vectors.append({k: x / norm for k, x in v.items()} if norm else {})

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return at, self.vocabulary[at] == h

    def groups(self, group: np.ndarray, at: np.ndarray, known: np.ndarray, hashes: np.ndarray, threshold: float):
        """(group, template, cosine, tokens) of each group of consecutive tokens with a template at ``threshold`` or above."""
        if not len(group):
            return
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        own = np.add.reduceat(np.where(known, self.idf[at] ** 2, 0), starts)
        # repeated tokens weigh more than one by one, so this bound only counts one known and all others
        total = own + np.add.reduceat(~known, starts) * self.top**2
        ends = np.r_[starts[1:], len(group)]
        size = ends - starts
        for g in np.flatnonzero((own > 0) & (own * size >= threshold**2 * total)):
            s, e = starts[g], ends[g]
            tf = Counter(at[s:e][known[s:e]].tolist())
            rest = Counter(hashes[s:e][~known[s:e]].tolist())
            v = {k: c * self.idf[k] for k, c in tf.items()}
            norm = (sum(x * x for x in v.values()) + sum((c * self.top) ** 2 for c in rest.values())) ** 0.5
            scores = [sum(x * t.get(k, 0) for k, x in v.items()) / norm for t in self.vectors]
            best = int(np.argmax(scores))
            if scores[best] >= threshold:
                yield int(group[s]), best, float(scores[best]), int(e - s)


def frequencies(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[int, int], int]:
    """How many files have each template token, and how many files there are."""
    matcher = Matcher(templates)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        df, files = np.zeros(len(matcher.vocabulary), np.int64), 0
        for part in chunks(batches, "text"):
            s = Segments(part["text"])
            at, known = matcher.known(s.hash)
            pairs = np.unique(s.w.doc[known] * len(df) + at[known])
            df += np.bincount(pairs % len(df), minlength=len(df))
            files += len(part["text"])
        yield from batches_of(schema, key=np.r_[matcher.vocabulary.view(np.int64), 0], n=np.r_[df, files])

    rows = files.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    table = {r.key: r.n for r in rows}
    return table, table.pop(0, 0)


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, doc_id, license, score, is_file): the license of each file's best segment or whole text."""
    df, n = frequencies(files, templates)
    matcher = Matcher(templates, df, n)
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("license", pa.string()), ("score", pa.float64()), ("is_file", pa.bool_())])

    def run(batches):
        for part in chunks(batches, "text"):
            s = Segments(part["text"])
            at, known = matcher.known(s.hash)
            best: dict[int, tuple[float, str, bool]] = {}
            first = dict(zip(s.segment.tolist(), s.w.doc.tolist(), strict=True))
            for whole, group in ((False, s.segment), (True, s.w.doc)):
                for g, t, score, size in matcher.groups(group, at, known, s.hash, threshold):
                    doc = g if whole else first[g]
                    is_file = whole or size >= FILE_SHARE * s.w.n[doc]
                    old = best.get(doc, (0.0, "", False))
                    # a license that the whole text matches says more than one of its sentences
                    best[doc] = (score, matcher.names[t], is_file or old[2]) if whole or score > old[0] else (old[0], old[1], is_file or old[2])
            rows = [best.get(i, (None, None, False)) for i in range(len(part["text"]))]
            yield from batches_of(schema, doc_id=part["doc_id"], path=part["path"], license=[r[1] for r in rows], score=[r[0] for r in rows], is_file=[r[2] for r in rows])

    return files.select("doc_id", "path", "text").mapInArrow(run, "doc_id long, path string, license string, score double, is_file boolean")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file (doc_id, path, text): doc_id, path, license, score, via (own, inherited or null), licensed_by (a directory).

    Null texts have no license of their own; a null path inherits nothing; of
    several license files in a directory the best score wins, then the first
    path; repeated rows each give a row; an empty table gives none; extra columns
    are ignored.
    """
    own = store(own_licenses(files, templates, threshold))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = own.withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    best = F.max(F.struct("score", F.col("license").alias("license")))
    licensed = own.filter("is_file AND folder IS NOT NULL").groupBy("folder").agg(best.alias("best")).select("folder", F.col("best.license").alias("found"), F.col("best.score").alias("found_score"))
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("above")))
    folders = own.filter("folder IS NOT NULL").select("folder").distinct()
    nearest = (
        folders.select("folder", F.inline(above))
        .join(licensed.withColumnRenamed("folder", "above"), "above")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "above", "found", "found_score")).alias("near"))
    )
    out = own.join(nearest, "folder", "left")
    inherits = F.col("license").isNull() & F.col("near").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "near.found").alias("license"),
        F.when(inherits, F.col("near.found_score")).otherwise(F.col("score")).alias("score"),
        F.when(inherits, "inherited").when(F.col("license").isNotNull(), "own").alias("via"),
        F.when(inherits, F.col("near.above")).alias("licensed_by"),
    )


def document_path() -> Column:
    """A directory tree for ``documents``: source, thousands, fifties, id."""
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 50).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text", document_path().alias("path")))

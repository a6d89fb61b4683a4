"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A text is looked at in parts: each line, each paragraph (adjoining lines with words), the header (the comment
block that it begins with) and the whole file. Every part is a sparse TF-IDF vector. The templates' words are
the only ones that can contribute to a product, so the vocabulary is theirs; all other words count towards a
part's length with the weight of a word that no template has. Inverse document frequencies come from the
lines of all texts. A file with no licence of its own takes that of the nearest directory above it, or its
own, that holds a licence file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import give_back, staged
from tidemark.llm.tokens import chunks_of_text, split_words

THRESHOLD = 0.75
CHUNK_BYTES = 3_000_000
PARTS_AT_ONCE = 8192
LICENCE_NAMES = r"(?i)^(un)?(licen[sc]e|copying|notice)([.-].*)?$"

# The notices and texts by which files and licence files name their licence.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_END = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_AS_IS = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""


def _gnu(kind: str, version: str, subject: str = "program") -> list[str]:
    """A GNU licence's header, whole and by its parts."""
    frees = f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    hope = f"This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
    copy = f"You should have received a copy of the GNU {kind} along with this {subject}. If not, see <https://www.gnu.org/licenses/>."
    return [frees, f"{frees} {hope} {copy}", f"This {subject} is licensed under the GNU {kind}, version {version}."]


TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", _MIT, f"{_MIT} {_MIT_END} {_MIT_AS_IS}", f"MIT License Copyright (c) {_MIT} {_MIT_END} {_MIT_AS_IS}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License", _APACHE, f"{_APACHE} {_APACHE_AS_IS}", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ],
    "GPL-2.0": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu("General Public License", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("General Public License", "3")],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_gnu("Lesser General Public License", "2.1", "library")],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("Lesser General Public License", "3", "library")],
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0-or-later", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_gnu("Affero General Public License", "3")],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_AS_IS}", f"BSD 2-Clause License Copyright (c) {_BSD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_AS_IS}"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", _BSD_NAMES,
        f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_AS_IS}", f"BSD 3-Clause License Copyright (c) {_BSD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_AS_IS}",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0", "Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ISC": [_ISC, _ISC + _ISC_KEPT, f"{_ISC}{_ISC_KEPT} {_ISC_AS_IS}", f"ISC License Copyright (c) {_ISC}{_ISC_KEPT} {_ISC_AS_IS}", "SPDX-License-Identifier: ISC"],
    "0BSD": [f"{_ISC}. {_ISC_AS_IS}", "SPDX-License-Identifier: 0BSD"],
    "Zlib": [
        "SPDX-License-Identifier: Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
#: A line of a comment, or one with nothing on it.
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--|\"{3}|'{3}|rem\b|$)"


def _words_of_lines(lines: pa.Array):
    """Lower-case runs of letters, digits and dots inside words: ``(distinct words, index, count a line)``."""
    plain = pc.replace_substring_regex(pc.utf8_lower(lines), r"[^\pL\pN.]+|\.(\s|$)|[.]{2,}", " ")
    return split_words(plain)


def _template_counts() -> tuple[list[str], list[str], np.ndarray]:
    """Names, vocabulary and word counts of all templates, a row for each."""
    names = [n for n, texts in TEMPLATES.items() for _ in texts]
    words, index, counts = _words_of_lines(pa.array([t for texts in TEMPLATES.values() for t in texts], pa.large_string()))
    rows = np.zeros((len(names), len(words)))
    np.add.at(rows, (np.repeat(np.arange(len(names)), counts), index), 1)
    return names, words.to_pylist(), rows


def weights(n_lines: int, lines_with: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """The inverse document frequency of each template word, and that of a word in no template; templates count as lines."""
    return np.log((n_lines + len(counts) + 1) / (lines_with + (counts > 0).sum(0))), float(np.log(n_lines + len(counts) + 1))


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(text of each line, number of each line, lines)``."""
    split = pc.split_pattern(texts, "\n")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), split.flatten()


def _levels(of: np.ndarray, number: np.ndarray, lines: pa.Array, full: np.ndarray):
    """For lines, paragraphs, headers and whole texts: the part of each line, -1 for none. A part of one line is told once, as the line.

    ``full``: the lines with words.
    """
    starts = number == 0
    yield np.where(full, np.arange(len(of)), -1)
    paragraph = np.cumsum(starts | ~full | np.append(False, ~full[:-1]))
    comment = pc.match_substring_regex(lines, COMMENT, ignore_case=True).to_numpy(zero_copy_only=False).astype(bool)
    broken = np.cumsum(~comment)
    header = np.where(comment & (broken == (broken[starts] - ~comment[starts])[of]), of, -1)
    for part in (paragraph, header, of):
        part = np.where(full, part, -1)
        n = np.bincount(part[part >= 0], minlength=int(part.max(initial=0)) + 1)
        yield np.where((part >= 0) & (n[part] > 1), part, -1)


def scan(docs: DataFrame, key: str, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, licence, score, line, n_lines, n_licence_lines)``, one row per input row; ``key`` is any column and goes along.

    The best part of the whole text decides; ties go to lines before paragraphs, headers and the file, then
    to the first part, then to the first template. line is where the part begins, n_licence_lines how many
    lines with words stand in parts that reach the threshold. licence and line are null where none does.
    """
    names, vocabulary, counts = _template_counts()
    slots = {w: i for i, w in enumerate(vocabulary)}
    rows = docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))

    def terms(lines: pa.Array):
        """Each word's line, its number among the distinct words, and these words' slots or -1."""
        words, index, n = _words_of_lines(lines)
        slot = np.fromiter((slots.get(w, -1) for w in words.to_pylist()), dtype=np.int64, count=len(words))
        return np.repeat(np.arange(len(lines), dtype=np.int64), n), index, slot

    def count(batches):
        total, n_lines = np.zeros(len(vocabulary), dtype=np.int64), 0
        for b in batches:
            for _, _, texts in chunks_of_text(b.column(0), CHUNK_BYTES):
                _, _, lines = _parts(texts)
                line, index, slot = terms(lines)
                known = slot[index] >= 0
                total += np.bincount(np.unique(line[known] * len(vocabulary) + slot[index][known]) % len(vocabulary), minlength=len(vocabulary))
                n_lines += len(lines)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary))), pa.array(np.concatenate([[n_lines], total]))], names=["slot", "n"])

    held = {r["slot"]: r["n"] for r in rows.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    idf, unseen = weights(held.get(-1, 0), np.array([held.get(i, 0) for i in range(len(vocabulary))]), counts)
    unit = counts * idf
    unit = unit / np.sqrt((unit**2).sum(1, keepdims=True))

    def match(batches):
        weight, label = np.append(idf, unseen), np.array(names, dtype=object)
        for b in batches:
            for first, to, texts in chunks_of_text(b.column(1), CHUNK_BYTES):
                of, number, lines = _parts(texts)
                line, index, slot = terms(lines)
                full = np.bincount(line, minlength=len(of)) > 0
                n, found, covered = to - first, [], np.zeros(len(of), dtype=bool)
                for level, part in enumerate(_levels(of, number, lines, full)):
                    mine = part[line]
                    hit = np.zeros(int(part.max(initial=-1)) + 1, dtype=bool)  # parts with a word of a template
                    hit[mine[(slot[index] >= 0) & (mine >= 0)]] = True
                    use = np.flatnonzero((mine >= 0) & hit[np.maximum(mine, 0)]) if len(hit) else np.zeros(0, dtype=np.int64)
                    if not len(use):
                        continue
                    both, times = np.unique(mine[use] << 32 | index[use], return_counts=True)
                    where, at = np.unique(both >> 32, return_inverse=True)
                    s = slot[both & 0xFFFFFFFF]
                    length = np.sqrt(np.bincount(at, weights=(times * weight[s]) ** 2))
                    inside, best, value = np.flatnonzero(s >= 0), np.zeros(len(where), dtype=np.int64), np.zeros(len(where))
                    begins = np.searchsorted(at[inside], np.arange(len(where) + 1))
                    for low in range(0, len(where), PARTS_AT_ONCE):
                        high = min(len(where), low + PARTS_AT_ONCE)
                        rows_in = inside[begins[low] : begins[high]]
                        products = np.zeros((high - low, len(names)))
                        np.add.at(products, at[rows_in] - low, times[rows_in, None] * idf[s[rows_in], None] * unit.T[s[rows_in]])
                        cosine = products / length[low:high, None]
                        best[low:high], value[low:high] = cosine.argmax(1), cosine.max(1)
                    good = np.flatnonzero(value >= threshold - 1e-12)
                    covered |= np.isin(part, where[good])
                    place = dict(zip(*np.unique(part, return_index=True)))
                    found += [(of[place[w]], -round(v, 12), level, number[place[w]], label[k], v) for w, v, k in zip(where[good].tolist(), value[good].tolist(), best[good].tolist())]
                licence, score, where_at = np.full(n, None, dtype=object), np.zeros(n), np.full(n, -1)
                for text, _, _, at_line, name, v in sorted(found, key=lambda f: f[:4], reverse=True):
                    licence[text], score[text], where_at[text] = name, v, at_line
                lines_with = lambda these: np.bincount(of[these], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), pa.array(licence, pa.string()), pa.array(score), pa.array(where_at, mask=where_at < 0), pa.array(lines_with(full)), pa.array(lines_with(covered & full))],
                    names=["key", "licence", "score", "line", "n_lines", "n_licence_lines"],
                )
        give_back()

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(match, f"key {kind}, licence string, score double, line bigint, n_lines bigint, n_licence_lines bigint").withColumnRenamed("key", key)


def with_inheritance(files: DataFrame) -> DataFrame:
    """Adds ``(origin, inherited_from)`` to scanned files, which also have a ``path``.

    A licence file is one named like one, or one of which half the lines with words are licence
    lines. A file without a licence takes that of the nearest directory, its own or one above it,
    that holds a licence file; of several there, the best score, then the smallest path. origin is
    ``own``, ``inherited`` or ``none``. Directories are resolved once each, then joined to the files.
    """
    parts = F.split("path", "/")
    files = files.withColumn("dir", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    is_licence = F.element_at(parts, -1).rlike(LICENCE_NAMES) | (2 * F.col("n_licence_lines") >= F.col("n_lines"))
    holders = files.where(F.col("licence").isNotNull() & is_licence).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("holder"))
    held = holders.select(F.col("dir").alias("above"), "holder.licence", "holder.path")
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    lines = files.select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "above"))
    nearest = lines.join(held, "above").groupBy("dir").agg(F.max_by(F.struct("licence", "above"), "depth").alias("found"))
    out = files.join(nearest, "dir", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("found").isNotNull(), "inherited").otherwise("none")
    return out.withColumn("origin", origin).withColumn("inherited_from", F.when(F.col("origin") == "inherited", F.col("found.above"))).withColumn("licence", F.coalesce("licence", "found.licence")).drop("found", "dir")


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, path, licence, score, line, n_lines, n_licence_lines, origin, inherited_from)``, one row per input row.

    Defined results: null or empty text has no lines with words and so no own licence; repeated rows come
    out as often as they come; a null path is the empty one, in the root directory; null ids stay null; an
    empty table gives no rows; other columns are ignored.
    """
    keyed = docs.select(F.struct(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path")).alias("file"), F.col(text_col).alias("text"))
    files = staged(scan(keyed, "file", "text", threshold).select("file.*", "licence", "score", "line", "n_lines", "n_licence_lines"), "licence-files")
    return with_inheritance(files).select("doc_id", "path", "licence", "score", "line", "n_lines", "n_licence_lines", "origin", "inherited_from")

"""License scans by conditional compression.

Words that licenses use (cues) mark candidate blocks of a text, as many words around them as a template of that
length class needs. A block is compressed alone, and with each template as zstandard raw dictionary: what a template
saves, as a share of what the template alone compresses to, is its gain. Templates that gain enough, and all that must agree
in every word, are confirmed by the exact differences of wording between template and block, however many they are; they are
reported with the span they cover.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from array import array
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.llm.common import small_batches, table

#: Licenses' well-known wordings; "<...>" stands for a name or a year, up to GAP words.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Released under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("bsd-3-clause", "Neither the name of the <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
)

CUE = re.compile(r"licen[sc]e|sublicen|copyright|warrant(?:y|ies)|merchantab|rights\s+reserved|public\s+domain|redistribut|permission\s+(?:is|to|notice)|endorse\s+or\s+promote|spdx-license", re.I)
#: A word, as compared: letters and digits, and signs that stand in names and versions between them.
WORD = re.compile(r"[A-Za-z0-9À-￿]+(?:[.+'-][A-Za-z0-9]+)*")
GAP = 8
#: Of what a template alone compresses to, what it must save to be looked at, if some of its words may differ.
LEAST_GAIN = 0.2
#: Hundredths of a template's words that may differ, rounded down: notices of under ten words must agree in every word.
MAY_DIFFER = 10
LEVEL = 15


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]  # None is written "" and stands for a gap
    size: int
    packer: zstandard.ZstdCompressor


def _size(raw: bytes, packer: zstandard.ZstdCompressor) -> int:
    return len(packer.compress(raw))


def _packer(dictionary: bytes | None = None) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if dictionary is None:
        return zstandard.ZstdCompressor(**plain)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **plain)


class Scanner:
    """Templates by length class. A class has the templates of over half its length, in words, up to its length."""

    def __init__(self, templates=TEMPLATES):
        self.plain = _packer()
        self.classes: dict[int, list[Template]] = {}
        empty = _size(b"", self.plain)
        for name, text in templates:
            words = []
            for part in re.split(r"(<[^>]*>)", text):
                words += [""] if part.startswith("<") else [w.lower() for w in WORD.findall(part)]
            raw = (" ".join(w for w in words if w) + " ").encode()
            length = 8
            while length < len(words):
                length *= 2
            self.classes.setdefault(length, []).append(Template(name, tuple(words), max(1, _size(raw, self.plain) - empty), _packer(raw)))

    def scan(self, text: str) -> list[tuple[int, int, str, int, int, str]]:
        """(start, end, name, gain in thousandths, number of differences, the differences) of a text's licenses, in order.

        Of spans that overlap the longest is kept, then the one with fewest differences, then the first name.
        """
        cues = [m.start() for m in CUE.finditer(text)]
        if not cues:
            return []
        found = []
        starts, ends = array("q"), array("q")
        for m in WORD.finditer(text):
            starts.append(m.start()), ends.append(m.end())
        marked = sorted({min(bisect.bisect_right(ends, c), len(ends) - 1) for c in cues})
        for length, templates in sorted(self.classes.items()):
            for low, high in _blocks(len(starts), marked, length):
                block = [(text[a:b], a, b) for a, b in zip(starts[low:high], ends[low:high], strict=True)]
                raw = (" ".join(w.lower() for w, _, _ in block) + " ").encode()
                alone = _size(raw, self.plain)
                lower = [w.lower() for w, _, _ in block]
                for t in templates:
                    gain = (alone - _size(raw, t.packer)) / t.size
                    if gain < LEAST_GAIN and not _word_for_word(t.words):
                        continue
                    for first, last, differences in _confirm(t.words, lower):
                        found.append((block[first][1], block[last][2], t.name, round(1000 * gain), len(differences), " ".join(differences)))
        kept: list[tuple] = []
        for x in sorted(set(found), key=lambda x: (x[0] - x[1], x[4], x[2], -x[3], x)):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        return sorted(kept)


def _blocks(n: int, marked: list[int], length: int):
    """(first, end) of the blocks of words for templates of up to length words: around each run of marked words that are near.

    All is counted in words, however long these are. A run's stretch is cut into blocks of 4 lengths that overlap by 2, so
    that every occurrence of a template is whole in one of them.
    """
    reach = length * 2
    runs: list[list[int]] = []
    for c in marked:
        if runs and c - runs[-1][1] <= 2 * reach:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    for first, last in runs:
        low, high = max(0, first - reach), min(n, last + reach + 1)
        for k in range(low, max(low + 1, high - reach), reach):
            yield k, min(k + 2 * reach, high)


def _allowed(template: tuple[str, ...]) -> int:
    return sum(map(bool, template)) * MAY_DIFFER // 100


def _word_for_word(template: tuple[str, ...]) -> bool:
    return "" not in template and _allowed(template) == 0


def _confirm(template: tuple[str, ...], block: list[str]):
    """(first, last, differences) of every place where the block has the template with few enough differences.

    Differences are written -word for one that is missing and +word for one too many, in order.
    """
    allowed = _allowed(template)
    n = len(template)
    if _word_for_word(template):
        for k in range(len(block) - n + 1):
            if block[k] == template[0] and tuple(block[k : k + n]) == template:
                yield k, k + n - 1, []
        return
    start = 0
    while start < len(block):
        part = block[start:]
        pieces = [x for x in difflib.SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if x.size]
        pieces = _densest(pieces, n + allowed + GAP * template.count(""))
        if not pieces:
            return
        differences, t, b, gap_words = [], 0, pieces[0].b, 0
        for x in [*pieces, difflib.Match(n, pieces[-1].b + pieces[-1].size, 0)]:
            missing, more = template[t : x.a], part[b : x.b]
            if "" in missing and len(more) <= GAP:
                missing, more = [w for w in missing if w], []
            differences += [f"-{w}" for w in missing if w] + [f"+{w}" for w in more]
            t, b = x.a + x.size, x.b + x.size
        if len(differences) <= allowed:
            yield start + pieces[0].b, start + pieces[-1].b + pieces[-1].size - 1, differences
        start += pieces[-1].b + pieces[-1].size


def _densest(pieces: list, span: int) -> list:
    """Of matching pieces in order, those within a span of the block that match most words."""
    best, most = [], 0
    for i in range(len(pieces)):
        chosen = [x for x in pieces[i:] if x.b + x.size - pieces[i].b <= span]
        size = sum(x.size for x in chosen)
        if size > most:
            best, most = chosen, size
    return best


@functools.lru_cache(maxsize=4)
def scanner(templates=TEMPLATES) -> Scanner:
    return Scanner(templates)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """id, n_licenses, licenses array of {name, start, end, gain, n_differences, differences} for each row of docs.

    Spans are in code points, end exclusive; gain is what the template saved of its own compressed size, in thousandths. Null
    and empty texts have no license; null ids are kept; repeated rows are each scanned; other columns are dropped. Equal
    texts give equal results. Of equally long spans that overlap, the one with fewest differences stays, then the first name.
    An empty table gives no row. Whole texts are scanned; no shuffle; memory follows the longest text.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = "name string, start long, end long, gain long, n_differences long, differences string"
    schema = docs.select("id").schema
    for x in docs.sparkSession.createDataFrame([], f"n_licenses long, licenses array<struct<{one.replace(' string', ':string').replace(' long', ':long')}>>").schema:
        schema = schema.add(x)
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.int64()), ("n_differences", pa.int64()), ("differences", pa.string())]))
    templates = tuple(templates)

    def run(batches):
        s = scanner(templates)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for at in range(0, batch.num_rows, 1000):
                rows = [[{"name": n, "start": a, "end": b, "gain": g, "n_differences": k, "differences": d} for a, b, n, g, k, d in s.scan(x.as_py() or "")] for x in texts[at : at + 1000]]
                yield pa.RecordBatch.from_arrays([ids[at : at + 1000], pa.array(list(map(len, rows)), pa.int64()), pa.array(rows, kind)], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"], x["end"], x["gain"], x["n_differences"])), ",")
    return found.select("doc_id", "n_licenses", spans.alias("licenses"))

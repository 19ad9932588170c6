"""License scans by conditional compression.

A text is walked once, from left to right, over the words that license notices use (triggers). Around a trigger that no
notice found so far covers, blocks of as many words as the templates need are compressed with zstandard: alone, and with
each template as a raw dictionary (words in lower case, parted by spaces, so that capitals and line breaks do not count). The bytes that a template saves rank the templates. In that order, exact wording
confirms: the words of template and block are aligned, the template's naming words must all be there, few others may be
missing, and the notice must cover the trigger. The first confirmed is the finding, with its wording differences (words
missing, words extra). A template whose naming words a block lacks cannot be confirmed and needs no compression.

Each trigger is looked at once, in blocks whose size depends on the templates alone, so the work grows with the text's
length, however many notices it holds.

Cases: a null or empty text has no findings; texts are read whole; rows that repeat give repeated findings; of templates
that save as much, the first by name wins; a null id stays null; an empty table gives an empty result; the output
has only the id and the columns named here, so others cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import table

_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: The wording of public license notices, by identifier (after a colon, a variant of its wording), and the
#: words that name the license, all of which a notice needs.
TEMPLATES: dict[str, tuple[str, str]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "Apache-2.0:header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache 2.0",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "bsd 2-clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "bsd 3-clause"),
    "BSD:text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "redistribution binary forms",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "cc by 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "cc0 1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "general public 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "general public 3"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "lesser general public 3"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "affero general public 3"),
    "GPL:header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "general public 3",
    ),
    "ISC": ("Released under the ISC License.", "isc"),
    "MIT": ("Released under the MIT License.", "mit"),
    "MIT:text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "permission granted software restriction",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    "BSD-2-Clause:whole": (f"{_BSD} {_BSD_WARRANTY}", "redistributions binary warranties"),
    "BSD-3-Clause:whole": (
        f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        f"products derived from this software without specific prior written permission. {_BSD_WARRANTY}",
        "redistributions binary neither endorse warranties",
    ),
    "MIT:whole": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "permission granted sublicense noninfringement",
    ),
    "ISC:whole": (
        f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_NO_WARRANTY}",
        "permission granted appear tortious",
    ),
    "0BSD:whole": (f"{_GRANT}. {_NO_WARRANTY}", "permission granted tortious"),
    "Unlicense:whole": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain.",
        "unencumbered public domain jurisdictions",
    ),
    "Zlib:whole": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution.",
        "permission granted misrepresented altered",
    ),
    "BSL-1.0:whole": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following:",
        "permission granted reproduce transmit derivative",
    ),
    "Apache-2.0:whole-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
        "apache 2.0 governing",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public 2.0",
    ),
}
#: Identifiers that a line for machines may name; each is a template of two words.
IDENTIFIERS = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
TEMPLATES |= {f"{i}:identifier": (f"SPDX-License-Identifier: {i}", f"spdx-license-identifier {i.lower()}") for i in IDENTIFIERS}
# Creative Commons' own wording, by rule from the elements of a license.
TEMPLATES |= {
    f"CC-{code}-4.0:named": (f"This work is licensed under a Creative Commons {name} 4.0 International License", f"creative commons {name.lower()} 4.0")
    for code, name in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike"}.items()
}
#: Words around which a block is looked at, and which each notice has at least one of.
TRIGGER = re.compile(r"licen[sc]|permission|redistribut|released under|unencumbered|public domain", re.I)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
#: Share of a template's words that must be there; words that may stand between them, as a share of the template's.
SHARE, LOOSE = 0.8, 1.0
#: Templates are looked for in blocks by their number of words, up to each of these; words of a block on either side of the
#: trigger, as a share of its longest template's.
LENGTHS, AROUND = (3, 16, 128, 1024), 1.5
FINDINGS = "license string, template string, start int, end int, saving double, missing string, extra int"


class Template(NamedTuple):
    name: str
    words: list[str]
    counts: Counter
    naming: frozenset[str]
    compressor: zstandard.ZstdCompressor


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


@lru_cache(maxsize=1)
def prepared() -> tuple[zstandard.ZstdCompressor, list[tuple[int, list[Template]]], frozenset[str]]:
    """A compressor without a dictionary; words on either side of a trigger, and templates, by length; all naming words."""
    plain = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False)
    every = []
    for name, (text, naming) in sorted(TEMPLATES.items()):
        words = [w for w, _, _ in _words(text)]
        raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        every.append(Template(name, words, Counter(words), frozenset(naming.split()), zstandard.ZstdCompressor(compression_params=plain, dict_data=raw)))
    groups = []
    for least, most in zip((0, *LENGTHS), LENGTHS):
        own = [t for t in every if least < len(t.words) <= most]
        if own:
            groups.append((int(AROUND * max(len(t.words) for t in own)) + 1, own))
    return zstandard.ZstdCompressor(compression_params=plain), groups, frozenset().union(*(t.naming for t in every))


def ranked(have: list[str], where: dict[str, list[int]], at: int, done: int) -> list[tuple[int, str, Template, int, int, float]]:
    """Templates whose naming words are near word ``at``, by the bytes that they save (negative, most first), with their block."""
    alone, groups, _ = prepared()
    found = []
    for around, own in groups:
        lo, hi = max(done, at - around), min(len(have), at + around + 1)
        near = lambda w: (p := where.get(w)) is not None and (i := bisect_left(p, lo)) < len(p) and p[i] < hi  # noqa: E731, B023
        named = [t for t in own if all(map(near, t.naming))]
        if not named:
            continue
        raw = " ".join(have[lo:hi]).encode()
        size = len(alone.compress(raw))
        for t in named:
            saved = size - len(t.compressor.compress(raw))
            found.append((-saved, t.name, t, lo, hi, saved / size))
    return sorted(found, key=lambda f: f[:2])


def worded(have: list[str], template: Template) -> tuple[int, int, list[str], int] | None:
    """First and last word of a template's best place among ``have``, what is missing and how many words are extra."""
    length, least = len(template.words), SHARE * len(template.words) - 1e-9
    if sum(min(n, template.counts[w]) for w, n in Counter(w for w in have if w in template.counts).items()) < least:
        return None
    match = [b for b in SequenceMatcher(None, have, template.words, autojunk=False).get_matching_blocks() if b.size]
    if not match:
        return None
    # Words farther from the longest stretch than they are many belong to something else.
    main = max(range(len(match)), key=lambda k: match[k].size)
    lo = hi = main
    gap = lambda a, b: match[b].a - match[a].a - match[a].size - (match[b].b - match[a].b - match[a].size)
    while lo > 0 and gap(lo - 1, lo) <= max(2, 2 * match[lo - 1].size):
        lo -= 1
    while hi + 1 < len(match) and gap(hi, hi + 1) <= max(2, 2 * match[hi + 1].size):
        hi += 1
    match = match[lo : hi + 1]
    first, last = match[0].a, match[-1].a + match[-1].size
    got = {b.b + k for b in match for k in range(b.size)}
    missing = [w for k, w in enumerate(template.words) if k not in got]
    extra = last - first - len(got)
    there = {template.words[k] for k in got}
    if len(got) < least or extra > LOOSE * length or template.naming - there:
        return None
    return first, last, missing, extra


def findings(text: str | None) -> list[tuple[str, str, int, int, float, str, int]]:
    """License, template, start, end, saving, missing words and number of extra words of each notice in a text."""
    if not text or not TRIGGER.search(text):
        return []
    words = _words(text)
    have, starts = [w for w, _, _ in words], [a for _, a, _ in words]
    where: dict[str, list[int]] = {}
    naming = prepared()[2]
    for i, w in enumerate(have):
        if w in naming:
            where.setdefault(w, []).append(i)
    found, done = [], 0
    for m in TRIGGER.finditer(text):
        at = bisect_right(starts, m.start()) - 1
        if at < done:
            continue
        for _, name, template, lo, hi, saving in ranked(have, where, at, done):
            place = worded(have[lo:hi], template)
            if place and lo + place[0] <= at < lo + place[1]:
                first, last, missing, extra = place
                done = lo + last
                found.append((name.split(":")[0], name, words[lo + first][1], words[done - 1][2], round(saving, 6), " ".join(missing), extra))
                break
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template, start, end, saving, missing, extra: a row for each notice found."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch["doc_id"], batch["text"]):
                for f in findings(text.as_py()):
                    ids.append(i.as_py())
                    out.append(f)
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32()]
            names = ["license", "template", "start", "end", "saving", "missing", "extra"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FINDINGS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

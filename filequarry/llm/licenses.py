"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment measures them.

Templates and texts are sequences of words: runs of ASCII letters and digits, A-Z lower-cased, all else a separator. Of
each WINDOW neighbouring word-triples of a template, the one with the smallest hash is a fingerprint. A text's triples
are looked up whole, so a stretch of WINDOW + 2 words taken over unchanged is always found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, tidied

GRAM, WINDOW = 3, 4
#: Share of a template's words that must be matched, and by how many words an alignment may drift.
COVERAGE, BAND = 0.75, 12
#: The wording of public licences and of the usual notices that point to them.
TEMPLATES = {
    "reserved-notice": "All rights reserved.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    "MIT-licensed": "Licensed under the MIT License.",
    "BSD-notice": "Released under the BSD License.",
    "BSD-licensed": "Licensed under the BSD License.",
    "ISC-notice": "Released under the ISC License.",
    "ISC-licensed": "Licensed under the ISC License.",
    "Apache-2.0-notice": "Released under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "MIT-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
#: Whole texts, read once by the driver.
TEMPLATES |= {f"{p.stem}-whole": p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
#: A line that names licenses by their SPDX identifiers; its license is the expression itself.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)")
_LOWER = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[a-z0-9]+")
FOUND = "doc_id long, text_key long, license string, coverage double, words int, start int, end int"


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


def winnowed(sequence: list[bytes]) -> dict[int, bytes]:
    """Fingerprints of a word sequence by position: of each window the rightmost smallest triple."""
    grams = [b" ".join(sequence[i : i + GRAM]) for i in range(len(sequence) - GRAM + 1)]
    h = [zlib.crc32(g) for g in grams]
    picks = set()
    for i in range(max(1, len(h) - WINDOW + 1)):
        w = range(i, min(len(h), i + WINDOW))
        if w:
            picks.add(min(w, key=lambda k: (h[k], -k)))
    return {i: grams[i] for i in sorted(picks)}


def align(template: list[bytes], text: list[bytes | None], start: int) -> tuple[int, int, int]:
    """(matched words, first, last) of the best alignment within BAND words of the diagonal on which template[0] is text[start].

    Matches count 2, and a word that only one side has costs 1; words before and after the match are free.
    """
    best, wide = (0, 0, 0, 0), 2 * BAND + 1
    row = [(0, 0, -1, -1)] * (wide + 2)  # score, matches, first, last; cell b is text[start - BAND + i + b] for word i
    for i, w in enumerate(template):
        new = [(0, 0, -1, -1)] * (wide + 2)
        for b in range(wide):
            j = start - BAND + i + b
            if not 0 <= j < len(text):
                continue
            up, left, cell = row[b + 1], new[b - 1] if b else (0, 0, -1, -1), row[b]
            top = (0, 0, -1, -1)
            if w == text[j]:
                top = (cell[0] + 2, cell[1] + 1, cell[2] if cell[1] else j, j)
            for s in (up, left):
                if s[0] - 1 > top[0]:
                    top = (s[0] - 1, *s[1:])
            new[b] = top
            if top[0] > best[0]:
                best = top
        row = new
    return best[1], best[2], best[3]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = {k: words(t.encode()) for k, t in templates.items()}
        self.index: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, seq in self.templates.items():
            for at, gram in winnowed(seq).items():
                self.index[gram].append((name, at))
        self.counts = {k: Counter(seq) for k, seq in self.templates.items()}
        self.heads = {g.split(b" ", 1)[0] for g in self.index}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) of a text, in code points; of overlapping ones the most words stay."""
        raw = (text or "").encode("utf-8", "replace")
        seq, heads, index = words(raw), self.heads, self.index
        starts: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in [i for i, w in enumerate(seq) if w in heads]:
            for name, at in index.get(b" ".join(seq[i : i + GRAM]), ()):
                starts[name][i - at].append(i)
        found = []
        for name, some in starts.items():
            template, need, failed = self.templates[name], self.counts[name], set()
            if len(seq) < COVERAGE * len(template):
                continue
            rest = list(seq)  # without the words of what is found, so that the same license beside it is found too
            # where most fingerprints are first, as what they find spares the others
            for s, places in sorted(some.items(), key=lambda x: (-len(x[1]), x[0])):
                if all(rest[i] is None for i in places) or any(t in failed for t in range(s - BAND // 2, s + BAND // 2 + 1)):
                    continue  # found, or in about the same band
                if (Counter(rest[max(0, s - BAND) : s + len(template) + BAND]) & need).total() < COVERAGE * len(template):
                    continue  # too few of the words are there at all
                n, a, z = align(template, rest, s)
                if n < COVERAGE * len(template):
                    failed.add(s)
                    continue
                found.append((n, a, z, name))
                rest[a : z + 1] = [None] * (z + 1 - a)
        kept: list[tuple[int, int, int, str]] = []
        taken = bytearray(len(seq) if found else 0)
        for n, a, z, name in sorted(found, key=lambda f: (-f[0], len(self.templates[f[3]]), f[1], f[3])):
            if not any(taken[a : z + 1]):
                taken[a : z + 1] = b"\1" * (z + 1 - a)
                kept.append((n, a, z, name))
        told = []
        if text and "SPDX-License-Identifier" in text:
            told = [(m[1], 1.0, len(words(m[0].encode())), *m.span()) for m in SPDX.finditer(text)]
        if not kept:
            return told
        spans = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
        place = lambda x: len(raw[:x].decode("utf-8", "ignore"))
        told += [(name, n / len(self.templates[name]), n, place(spans[a][0]), place(spans[z][1])) for n, a, z, name in kept]
        return sorted(told, key=lambda f: f[3])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """FOUND of each row of ``docs(doc_id, text)``; spans are in code points, ends exclusive.

    Null and empty texts hold no license. Rows with a null doc_id are scanned like others; repeated rows each get their
    rows; other columns are not read; an empty table gives no rows. Texts are scanned whole. The templates are a bounded
    list that goes to every task with its code.
    """
    scanner = Scanner(templates or TEMPLATES)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            rows = []
            for doc, key, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (got := seen.get(t)) is None:
                    got = seen[t] = scanner.scan(t)
                rows += [(doc, key, *m) for m in got]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")), "text").mapInArrow(run, FOUND)

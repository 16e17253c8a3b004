"""License scans (operator 7): Dice coefficient over word bigrams.

Stretches of whole lines of a text are compared with licence templates, both
normalised to lower-case words; a template that no stretch of lines reaches is
looked for in stretches of words, wherever they begin and end.  Dice of two sets of a and b bigrams can't reach
t unless t / (2 - t) <= a / b <= (2 - t) / t, so a stretch meets only templates
of about its size; and it shares at least t / (2 - t) of a template's bigrams,
so it holds one of the template's *anchor* words.  Texts without anchors are
passed over by one regular expression.  A stretch ends where all that its first
line has stands in later lines too: without that line it is as good.  So time
grows with the text, times the templates' bigrams at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import common

#: Notices by which works are put under well-known licences.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0-line": "Licensed under the GPL, version 2.",
    "LGPL-line": "Licensed under the GNU Lesser General Public License.",
    "AGPL-line": "Licensed under the GNU Affero General Public License.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-line": "Distributed under the BSD 3-Clause License.",
    "BSD-2-line": "Distributed under the BSD 2-Clause License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-line": "Released under the ISC License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-line": "Licensed under CC0 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-line": "This software is released under the Unlicense.",
    "Proprietary": "All rights reserved.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}
#: What the three-clause licence has besides.
_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY"
TEMPLATES["BSD-3-Clause-text"] = TEMPLATES["BSD-2-Clause-text"].replace(" THIS SOFTWARE IS PROVIDED BY", _THIRD)

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class TemplateIndex:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold, self.grams = threshold, {k: g for k, v in templates.items() if (g := bigrams(words(v)))}
        least = threshold / (2 - threshold)
        # a little wider, so that rounding doesn't lose a stretch at the bound itself
        self.sizes = {k: (least * len(g) - 1e-9, len(g) / least + 1e-9) for k, g in self.grams.items()}
        self.most = max((hi for _, hi in self.sizes.values()), default=0)
        often = Counter(w for g in self.grams.values() for w in {x for p in g for x in p})
        self.anchors: set[str] = set()
        for g in self.grams.values():  # words that touch so many bigrams that too few are left without them
            left = set(g)
            while len(left) >= least * len(g) - 1e-9:
                by = Counter(w for p in left for w in set(p))
                word = min(by, key=lambda w: (w not in self.anchors, len(w) < 4, -by[w], often[w], w))
                self.anchors.add(word)
                left = {p for p in left if word not in p}
        self.pattern = r"(?i)" + "|".join(sorted(map(re.escape, self.anchors)))
        self.touch: dict[tuple[str, str], list[str]] = {}
        for k, g in self.grams.items():
            for p in g:
                self.touch.setdefault(p, []).append(k)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, Dice, start, end) of each template's best stretch of lines, or else of words; start and end are code points."""
        lines, at = [], 0
        for line in text.split("\n"):
            ws = words(line)
            if ws:
                lines.append((at, at + len(line), ws))
            at += len(line) + 1
        held = [bigrams(ws) for _, _, ws in lines]
        joints = [{(a[2][-1], b[2][0])} for a, b in zip(lines, lines[1:], strict=False)]
        best: dict[str, tuple[float, int, int]] = {}
        for i, (start, _, _) in enumerate(lines):
            own = held[i] | joints[i] if i < len(joints) else held[i]
            if not any(p in self.touch for p in own):
                continue  # no best stretch begins with a line that shares nothing
            got, rest, met = set(held[i]), set(own), Counter(k for p in held[i] for k in self.touch.get(p, ()))
            new = True
            for j in range(i, len(lines)):
                if j > i:
                    more = joints[j - 1] | held[j]
                    # once the lines behind have all that the first one has, they do as well without it
                    rest -= held[j] if j == i + 1 else more
                    if not rest:
                        break
                    more -= got
                    new = bool(more)
                    got |= more
                    met.update(k for p in more for k in self.touch.get(p, ()))
                if len(got) > self.most:
                    break
                if not new:
                    continue
                for k, n in met.items():
                    lo, hi = self.sizes[k]
                    if lo <= len(got) <= hi and (d := 2 * n / (len(got) + len(self.grams[k]))) >= self.threshold and d > best.get(k, (0.0, 0, 0))[0]:
                        best[k] = (d, start, lines[j][1])
        self.inside(text, best)
        return [(k, *v) for k, v in sorted(best.items())]

    def inside(self, text: str, best: dict[str, tuple[float, int, int]]) -> None:
        """Adds the best stretch of words of each template that no stretch of lines reaches.

        A best stretch begins and ends with bigrams of its template, and holds
        neither its first nor its last one twice.
        """
        ws = [(w, m.start(), m.end()) for m in WORD.finditer(text) for w in words(m[0])]
        pairs = [(a[0], b[0]) for a, b in zip(ws, ws[1:], strict=False)]
        at: dict[str, list[int]] = {}
        for i, p in enumerate(pairs):
            for k in self.touch.get(p, ()):
                if k not in best:
                    at.setdefault(k, []).append(i)
        for k, starts in at.items():
            g, (lo, hi) = self.grams[k], self.sizes[k]
            if len({pairs[i] for i in starts}) < lo:  # as many bigrams must be shared
                continue
            for i in starts:
                got: set = set()
                met = 0
                for j in range(i, len(pairs)):
                    p = pairs[j]
                    if p in got:
                        if p == pairs[i]:
                            break
                        continue
                    got.add(p)
                    if len(got) > hi:
                        break
                    if p in g:
                        met += 1
                        if (d := 2 * met / (len(got) + len(g))) >= self.threshold and d > best.get(k, (0.0, 0, 0))[0]:
                            best[k] = (d, ws[i][1], ws[j + 1][2])


FOUND = "doc_id long, license string, dice double, start long, end long"


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row for each document and template whose best stretch of lines, or else of words, reaches ``threshold``.

    ``df`` has doc_id and text; further columns are not read.  Null and empty
    texts, and templates of less than two words, match nothing.  Repeated rows
    are scanned one by one; of equally good stretches a short one is told, and the
    first of those.  Whole texts are scanned, however long.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pc.fill_null(pc.match_substring_regex(batch.column(1), index.pattern), False) if index.anchors else pa.array([False] * batch.num_rows)
            some = batch.filter(hit)
            rows = [(d, *found) for d, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for found in index.scan(t)]
            if rows:
                names = [x.split()[0] for x in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))

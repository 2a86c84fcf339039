"""Licence scans: normalised passages compared with licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

_WORD = re.compile(rb"[a-z0-9]+")
_HITS = "array<struct<license:string,dice:double,first_line:int,last_line:int>>"

# Public licence notices and texts that stand as templates.
TEMPLATES: dict[str, Sequence[str]] = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}


def words(text: bytes) -> list[bytes]:
    """A-Z in lower case; words are runs of a-z and 0-9."""
    return _WORD.findall(text.lower())


def bigrams(of: Sequence[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(of, of[1:]))


class Templates:
    """Bigrams of every template, and which templates hold a bigram."""

    def __init__(self, templates: Mapping[str, Sequence[str]], dice: float) -> None:
        self.dice = dice
        texts = [(name, words(t.encode())) for name in sorted(templates) for t in templates[name]]
        self.rows = [(name, bigrams(own)) for name, own in texts if len(own) > 1]
        self.lengths = [len(own) for _, own in texts if len(own) > 1]
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (_, grams) in enumerate(self.rows):
            for g in grams:
                self.holders.setdefault(g, []).append(i)
        sizes = [len(g) for _, g in self.rows]
        #: Bigrams of a template that a window has to hold: its set has as many as the template's words allow, at most 1 / needed of the template's.
        self.needed = [math.ceil(n * dice / (2 - dice) - 1e-9) for n in sizes]
        #: Dice d of sets of a and b bigrams needs d / (2 - d) * b <= a <= (2 - d) / d * b.
        self.least = math.ceil(min(sizes, default=1) * dice / (2 - dice) - 1e-9)
        self.most = math.floor(max(sizes, default=0) * (2 - dice) / dice + 1e-9)

    def best(self, of: Sequence[bytes]) -> tuple[float, str] | None:
        """The best template of a passage, by Dice, then by name."""
        if len(of) - 1 < self.least:
            return None
        grams = bigrams(of)
        if not self.least <= len(grams) <= self.most:
            return None
        shared = Counter(i for g in grams for i in self.holders.get(g, ()))
        found = [(-2 * n / (len(grams) + len(self.rows[i][1])), self.rows[i][0]) for i, n in shared.items()]
        score, name = min(found, default=(0.0, ""))
        return (-score, name) if -score >= self.dice else None

    def windows(self, own: Sequence[bytes], known: set[str]) -> Iterator[tuple[str, float, int, int]]:
        """(licence, Dice, first word, last word) of the best window of each licence that is not known yet.

        A window has as many words as its template and begins with a bigram of it; the
        earliest of the best stays. Only templates are tried of which the text holds enough bigrams at all,
        and the bigrams of a window are counted as it slides.
        """
        grams = list(zip(own, own[1:]))
        shared = Counter(i for g in set(grams) for i in self.holders.get(g, ()))
        best: dict[str, tuple[float, int, int]] = {}
        for i, n in shared.items():
            name, of = self.rows[i]
            size = self.lengths[i] - 1  # bigrams of a window
            if name in known or n < self.needed[i] or len(grams) < size:
                continue
            held: Counter = Counter()
            both = 0
            for k, g in enumerate(grams):
                held[g] += 1
                both += held[g] == 1 and g in of
                if k >= size:
                    old = grams[k - size]
                    held[old] -= 1
                    if not held[old]:
                        del held[old]
                        both -= old in of
                start = k - size + 1
                if start >= 0 and grams[start] in of:
                    score = (-2 * both / (len(held) + len(of)), start, i)
                    if -score[0] >= self.dice and score < best.get(name, (1.0, 0, 0)):
                        best[name] = score
        for name, (score, start, i) in sorted(best.items()):
            yield name, -score, start, start + self.lengths[i] - 1

    def scan(self, text: str) -> list[dict]:
        """Hits among the lines and the paragraphs (runs of lines with a word) of a text, then the best window of each other licence."""
        hits = []
        group: list[list[bytes]] = []
        every: list[bytes] = []
        line_of: list[int] = []
        first = 0
        for i, line in enumerate([*text.encode("utf-8", "surrogatepass").split(b"\n"), b""]):
            own = words(line)
            if own:
                every += own
                line_of += [i] * len(own)
                if not group:
                    first = i
                group.append(own)
                if hit := self.best(own):
                    hits.append({"license": hit[1], "dice": hit[0], "first_line": i, "last_line": i})
                continue
            if len(group) > 1:
                # a passage of w words may repeat bigrams, so only its bigrams can be pruned by size
                if hit := self.best([w for x in group for w in x]):
                    hits.append({"license": hit[1], "dice": hit[0], "first_line": first, "last_line": i - 1})
            group = []
        for name, score, a, b in self.windows(every, {h["license"] for h in hits}):
            hits.append({"license": name, "dice": score, "first_line": line_of[a], "last_line": line_of[b]})
        return hits


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, dice: float = 0.8) -> DataFrame:
    """doc_id and hits (license, dice, first_line, last_line) of each row of docs(doc_id, text).

    Templates are a small fixed list that goes with the task. Every line and every
    paragraph of whole texts is compared with all templates that size bounds admit.
    A licence that none of them shows is looked for in windows of a template's length over the
    whole text, so it may stand inside a long line or over several paragraphs. A
    null or empty text has no hits; null ids and rows that repeat are kept; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))
    plain = {k: tuple(v) for k, v in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Templates(plain, dice)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([work.scan(t or "") for t in batch.column(1).to_pylist()], kind)], names=["doc_id", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, hits {_HITS}")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_hits and the best hit (by Dice, licence, first line) of each row of docs(doc_id, text)."""
    hits = scan(docs)
    best = F.array_min(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("dice"), h["license"].alias("license"), h["first_line"].alias("first_line"))))
    return hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"), best["license"].alias("license"), (-best["dice"]).alias("dice"), best["first_line"].cast("long").alias("first_line"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    rows = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, ts in TEMPLATES.items() for t in ts)
    grams = "list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2]))"
    ascii_ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = "regexp_extract_all({}, '[a-z0-9]+')"
    return f"""
with tw as (select name, nth, w, {grams} as g from (select name, row_number() over () as nth, {found.format(ascii_.format('text'))} as w from (values {rows}) v(name, text))),
t as (select name, nth, g from tw),
d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
l as (select row, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from d),
lw as (select row, i, {found.format(ascii_.format('line'))} as w from l),
f as (select *, sum((len(w) = 0)::int) over (partition by row order by i) as part from lw),
p as (
  select row, i as first_line, i as last_line, w from f where len(w) > 0
  union all
  select row, min(i), max(i), flatten(list(w order by i)) from f where len(w) > 0 group by row, part having count(*) > 1
),
g as (select row, first_line, last_line, {grams} as g from p where len(w) > 1),
m as (
  select row, first_line, last_line, name, 2 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) as dice
  from g join t on 2 * least(len(g.g), len(t.g)) >= 0.79 * (len(g.g) + len(t.g))
),
u as (select row, first_line, last_line, max(dice) as dice, arg_min(name, struct_pack(d := -dice, n := name)) as license from m where dice >= 0.8 group by row, first_line, last_line),
e as (select row, flatten(list(w order by i)) as w, flatten(list(list_transform(w, lambda x: i) order by i)) as ln from lw group by row),
eg as (select row, ln, w as words, {grams} as g from e where len(w) > 1),
c as (
  select row, ln, words, name, nth, t.g as tg, len(t.w) as n from eg join tw t on len(words) >= len(t.w) and len(list_intersect(eg.g, t.g)) >= ceil(len(t.g) * 0.8 / 1.2 - 1e-9)
  where not exists (select 1 from u where u.row = eg.row and u.license = t.name)
),
s as (select * from (select *, unnest(range(1, len(words) - n + 2)) as a from c) where list_contains(tg, words[a] || ' ' || words[a + 1])),
sg as (select row, name, nth, a, tg, ln[a] as first_line, {grams} as g from (select *, words[a:a + n - 1] as w from s)),
v as (select row, name, nth, a, first_line, 2 * len(list_intersect(g, tg)) / (len(g) + len(tg)) as dice from sg),
x as (select row, name as license, max(dice) as dice, arg_min(first_line, struct_pack(d := -dice, a := a, n := nth)) as first_line from v where dice >= 0.8 group by row, name),
h as (select row, first_line, dice, license from u union all select row, first_line, dice, license from x)
select doc_id, coalesce(n, 0) as n_hits, license, dice, first_line from d left join (
  select row, count(*) as n, arg_min(license, k) as license, -min(k.d) as dice, arg_min(first_line, k)::bigint as first_line
  from (select *, struct_pack(d := -dice, n := license, f := first_line) as k from h) group by row
) using (row)
"""


SQL = _sql()

"""Licence scan in DataFrame functions only.

A text is cut into units: its lines, its blocks between blank lines, and windows of its words over all
line ends. A window has as many words as a template and lies so that one of the template's anchor bigrams
is at its place, so notices within a longer line, or over several blocks, are seen. Units are normalised
(A-Z lower-cased, all but a-z, 0-9 to single spaces), turned into sets of word bigrams and compared with
licence templates by the Dice coefficient, twice the common bigrams over the sum of both sizes.

Templates are an index sorted by size: the coefficient is at most twice the smaller size over their sum,
so a unit's number of bigrams picks the slice of templates that it may match, often none, and only those
are compared. Texts that hold none of the needles (rare words and bigrams), of which any match must hold one, are not cut. A
window is compared with its own template only. The best template of all units at or above the limit is
the document's licence; of equal ones the largest, then the first in the table.

Null and empty texts have none, an empty table gives an empty table. Repeated rows are judged alike. A very long text costs its words once.
Columns of the caller's come back under any name; those named license or dice are replaced.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import aside

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU_1 = "is free software: you can redistribute it and/or modify it under the terms of the GNU"
_GNU_2 = "as published by the Free Software Foundation, either version"
_GNU_3 = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"

#: Public licence texts and notices, whole and in the parts that occur alone.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", f"{_MIT}. {_AS_IS}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", f"This program {_GNU_1} General Public License {_GNU_2} 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", f"This program {_GNU_1} General Public License {_GNU_2} 3 of the License, or (at your option) any later version. {_GNU_3} General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("LGPL-3.0", f"This library {_GNU_1} Lesser General Public License {_GNU_2} 3 of the License, or (at your option) any later version. {_GNU_3.replace('program', 'library')} Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("AGPL-3.0", f"This program {_GNU_1} Affero General Public License {_GNU_2} 3 of the License, or (at your option) any later version. {_GNU_3} Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."),
    ("BSD-3-Clause", _BSD_HEAD),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_NAME} {_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_END}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"{_ISC}. {_ISC_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} For more information, please refer to <https://unlicense.org/>"),
)
LIMIT = 0.8


def _normal(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")


def bigrams(text: str) -> list[str]:
    words = _normal(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(templates, limit: float) -> list[str]:
    """Bigrams of which every unit at or above the limit holds one.

    A coefficient of t with a template of b bigrams needs t / (2 - t) * b of them in common, so enough
    of them are taken, longest first, for the rest to be too few.
    """
    out: list[str] = []
    for _, body in templates:
        own = bigrams(body)
        rest = sorted((g for g in own if g not in out), key=lambda g: (len(g), g))
        while rest and len(rest) + 1e-9 >= limit / (2 - limit) * len(own):
            out.append(rest.pop())
    return out


def needles(templates, limit: float, short: int = 40) -> list[str]:
    """Strings of which the normalised words of every unit at or above the limit hold one, between spaces.

    Of templates of at most `short` bigrams, anchor bigrams; of longer ones single words, the longest first, until
    too few of the template's bigrams do without them all.
    """
    small, large = ([t for t in templates if (len(bigrams(t[1])) <= short) == x] for x in (True, False))
    out = anchors(small, limit)
    for _, body in large:
        own = bigrams(body)
        without = lambda: sum(g not in out and not (set(g.split(" ")) & set(out)) for g in own)
        rest = sorted({w for g in own for w in g.split(" ")} - set(out), key=lambda w: (len(w), w))
        while rest and without() + 1e-9 >= limit / (2 - limit) * len(own):
            out.append(rest.pop())
    return out


def _pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _unit_bigrams(unit: Column) -> Column:
    return F.array_distinct(_pairs(F.split(F.lower(F.trim(F.regexp_replace(unit, "[^A-Za-z0-9]+", " "))), " ")))


def _places(templates, keys: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Of each anchor bigram, the templates that hold it and where."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in keys}
    for j, (_, body) in enumerate(templates):
        words = _normal(body)
        for o, g in enumerate(f"{a} {b}" for a, b in zip(words, words[1:])):
            if g in out:
                out[g].append((j, o))
    return out


def _array(values) -> str:
    """A literal of numbers or of normalised words, in SQL: one call for thousands of them."""
    return "array(" + ", ".join(repr(v) for v in values) + ")"


def _index(templates, limit: float) -> tuple[Column, Column, Column]:
    """Templates in order of size (n, j, bg), and for each number of bigrams where its slice starts and how many it has."""
    sized = sorted((len(bigrams(body)), j) for j, (_, body) in enumerate(templates))
    rows = F.expr("array(" + ", ".join(f"named_struct('n', {n}, 'j', {j}, 'bg', {_array(bigrams(templates[j][1]))})" for n, j in sized) + ")")
    spans = []
    for n in range(int(sized[-1][0] * (2 - limit) / limit) + 2):
        fits = [k for k, (m, _) in enumerate(sized) if n and 2.0 * min(n, m) >= limit * (n + m)]
        spans.append((fits[0] + 1, len(fits)) if fits else (1, 0))
    return rows, F.expr(_array(a for a, _ in spans)), F.expr(_array(n for _, n in spans))


def scan_licenses(df: DataFrame, text: str = "text", templates=TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """df less its text, with license and dice (both null if none is found). No exchange. Other columns of df may have any names; those with the new names are replaced."""
    own, back = aside(df, text, "license", "dice")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.select(*own, t.alias("_text"))
    df = df.withColumn("_plain", F.lower(F.regexp_replace("_text", "[^A-Za-z0-9]+", " ")))
    padded, may_hit = F.concat(F.lit(" "), F.col("_plain"), F.lit(" ")), F.lit(False)
    for k in needles(templates, limit):
        may_hit = may_hit | F.contains(F.col("_padded"), F.lit(f" {k} "))
    df = df.withColumn("_padded", padded)
    df = df.withColumn("_may_hit", may_hit)
    units = F.concat(F.split("_text", "\n"), F.split("_text", r"\n[ \t\r]*\n"))
    df = df.withColumn("_units", F.when(F.col("_may_hit"), units).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_sets", F.transform("_units", _unit_bigrams))
    rows, start, count = _index(templates, limit)

    def best(bg: Column) -> Column:
        mine = F.slice(rows, F.coalesce(F.get(start, F.size(bg)), F.lit(1)), F.coalesce(F.get(count, F.size(bg)), F.lit(0)))
        return F.array_max(F.transform(mine, lambda m: F.struct((2.0 * F.size(F.array_intersect(bg, m["bg"])) / (F.size(bg) + m["n"])).alias("dice"), m["n"].alias("n"), (-m["j"]).alias("j"))))

    keys = anchors(templates, limit)
    sizes, bodies = F.expr(_array(len(_normal(b)) for _, b in templates)), F.expr("array(" + ", ".join(_array(bigrams(b)) for _, b in templates) + ")")
    places = F.expr("map(" + ", ".join(f"'{k}', array(" + ", ".join(f"named_struct('j', {j}, 'o', {o})" for j, o in v) + ")" for k, v in _places(templates, keys).items()) + ")")
    # where anchors are, then (template, start) of windows; a start before the text is cut off
    df = df.withColumn("_words", F.when(F.col("_may_hit"), F.split(F.trim("_plain"), " ")).otherwise(F.array().cast("array<string>")))
    hits = F.filter(F.transform(_pairs(F.col("_words")), lambda g, i: F.when(g.isin(keys), F.struct(g.alias("g"), i.alias("i")))), lambda h: h.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(places, h["g"]), lambda p: F.struct(p["j"].alias("j"), (h["i"] - p["o"]).alias("at"))))))
    df = df.withColumn("_starts", starts)
    window = lambda s: F.slice("_words", F.greatest(s["at"], F.lit(0)) + 1, F.element_at(sizes, s["j"] + 1) + F.least(s["at"], F.lit(0)))
    df = df.withColumn("_windows", F.transform("_starts", lambda s: F.struct(s["j"].alias("j"), F.array_distinct(_pairs(window(s))).alias("bg"))))

    def fit(w: Column) -> Column:
        body = F.element_at(bodies, w["j"] + 1)
        return F.struct((2.0 * F.size(F.array_intersect(w["bg"], body)) / (F.size(w["bg"]) + F.size(body))).alias("dice"), F.size(body).alias("n"), (-w["j"]).alias("j"))

    df = df.withColumn("_best", F.array_max(F.concat(F.transform("_sets", best), F.transform("_windows", fit))))
    names = F.array(*(F.lit(n) for n, _ in templates))
    hit = F.col("_best.dice") >= limit
    return df.select(*back, F.when(hit, F.element_at(names, (1 - F.col("_best.j")).cast("int"))).alias("license"), F.when(hit, F.col("_best.dice")).alias("dice"))


def _sql() -> str:
    rows = ", ".join(f"({j}, '{n}', [{', '.join(repr(b) for b in bigrams(body))}])" for j, (n, body) in enumerate(TEMPLATES))
    return f"""
WITH t(j, name, bg) AS (VALUES {rows}),
u AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT n, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[ \\t\\r]*\\n'))) AS unit FROM u),
w AS (SELECT n, string_split(lower(trim(regexp_replace(unit, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS ws FROM parts),
b AS (SELECT n, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bg FROM w),
s AS (SELECT n, name, j, len(t.bg) AS size, 2.0::DOUBLE * len(list_intersect(b.bg, t.bg)) / (len(b.bg) + len(t.bg)) AS dice FROM b JOIN t ON 2.0::DOUBLE * least(len(b.bg), len(t.bg)) >= {LIMIT}::DOUBLE * (len(b.bg) + len(t.bg))),
best AS (SELECT n, name, dice, row_number() OVER (PARTITION BY n ORDER BY dice DESC, size DESC, j) AS k FROM s WHERE dice >= {LIMIT}::DOUBLE)
SELECT doc_id, name AS license, dice FROM u LEFT JOIN best ON u.n = best.n AND k = 1
"""

"""Licence scan: normalised text compared to licence templates by Dice coefficient over word bigrams.

Units are the whole text, its paragraphs, its lines and its windows: all runs of words, across lines and sentences, of up to
the length below. A unit of n distinct bigrams can reach Dice t with a template of m only where t / (2 - t) <= n / m <=
(2 - t) / t; templates outside these bounds are not compared. The same bound says that a unit holds m t / (2 - t) of the
template's bigrams at least; every unit's bigrams are the text's too, so that texts that hold fewer are done with at once.
Windows are as long as the upper bound allows for the template with its repeated bigrams, and the best one starts at one of its
bigrams. A template that names a version or family fits only where the same stands. Everything happens within the row: there is no
join and no shuffle but the last, of results.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, bound, table

THRESHOLD = 0.75

# Short notices and the standard public wordings of common licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-3-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-3.0-notice": "Licensed under CC BY-NC 3.0.",
    "CC-BY-NC-2.0-notice": "Licensed under CC BY-NC 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "GPL-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "LGPL-2.1-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "AGPL-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def _bigrams(text: str) -> list[str]:
    words = [w for w in re.split(NOT_WORD, text.lower()) if w]
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a normalised template: lower case, words only."""
    return list(dict.fromkeys(_bigrams(text)))


def version_bigrams(text: str) -> list[str]:
    """Those of a template's bigrams that tell it from its sisters, by version or family: "version 3", "v 2", "nc 4", "2 0", "gnu
    lesser"; numbers of clauses are none."""
    return [x for x in template_bigrams(text) if re.fullmatch(r"(version|v|by|nc|attribution|[0-9]+) [0-9]+|gnu (general|lesser|affero)", x)]


def longest_window(text: str, threshold: float = THRESHOLD) -> int:
    """Most bigrams, with repeats, of a window that is compared to a template."""
    return int(len(_bigrams(text)) * (2 - threshold) / threshold + 1e-9)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _pairs(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", words[i], words[i + 1]))


def _earlier(pairs: Column) -> Column:
    """Per bigram of a text the place where it stood before, -1 at first."""
    place = lambda s: F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), F.when((k > 0) & (F.get(s, k - 1)["x"] == x["x"]), F.get(s, k - 1)["i"]).otherwise(-1).alias("was")))
    return F.transform(F.sort_array(_let(F.sort_array(F.transform(pairs, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), place)), lambda x: x["was"])


def _best_window(pairs: Column, earlier: Column, t: Column) -> Column:
    """Largest Dice coefficient of a template t and a window that holds its version, or 0; distinct bigrams are those that did not
    stand in the window before."""
    steps = F.transform(pairs, lambda x, i: F.struct(F.array_contains(t["bigrams"], x).alias("hit"), F.array_contains(t["versions"], x).alias("version"), F.get(earlier, i).alias("was")))
    one = lambda c: c.cast("int")

    def walk(steps, a):
        def step(acc, x):
            new = x["was"] < a
            return _let(
                F.struct((acc["n"] + one(new)).alias("n"), (acc["c"] + one(x["hit"] & new)).alias("c"), (acc["v"] + one(x["version"] & new)).alias("v")),
                lambda now: F.struct(now["n"].alias("n"), now["c"].alias("c"), now["v"].alias("v"), F.greatest(acc["best"], F.when(now["v"] == F.size(t["versions"]), 2.0 * now["c"] / (now["n"] + t["m"])).otherwise(0.0)).alias("best")),
            )

        return F.aggregate(F.slice(steps, a + 1, t["longest"]), F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0).alias("v"), F.lit(0.0).alias("best")), step, lambda acc: acc["best"])

    def over(steps):
        hits = F.filter(F.transform(steps, lambda x, i: F.when(x["hit"], i)), lambda i: i.isNotNull())
        starts = _let(hits, lambda h: F.filter(h, lambda a, k: F.get(h, k + t["least"] - 1) < a + t["longest"]))
        return F.array_max(F.transform(starts, lambda a: walk(steps, a)))

    return _let(steps, over)


def _words(unit: Column) -> Column:
    return F.array_remove(F.split(F.lower(unit), NOT_WORD), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def scan_licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, license, dice, unit) of the templates that units of a document reach, the best unit of each (then the first).

    unit is the number of the unit among the distinct ones: the whole text, then lines, then paragraphs; windows have the
    whole text's, 0. Null, empty and one-word texts have no bigram and match nothing. Rows of one id, repeated or not, are taken
    together: the best unit of any of them counts. Other columns are not read.
    """
    grams = {name: template_bigrams(t) for name, t in templates.items()}
    ratio = threshold / (2 - threshold)
    every = list(dict.fromkeys(b for g in grams.values() for b in g))
    made = F.array(*(F.struct(F.lit(name).alias("license"), _strings(g).alias("bigrams"), _strings(version_bigrams(templates[name])).alias("versions"), F.lit(len(g)).alias("m"), F.lit(math.ceil(len(g) * ratio - 1e-9)).alias("least"), F.lit(longest_window(templates[name], threshold)).alias("longest")) for name, g in grams.items()))
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    docs = bound(docs.select("doc_id", "text", _words(F.col("text")).alias("words")), "w", F.col("words")).where(F.size("w") >= 2).select("doc_id", "text", "w")
    # templates that the whole text holds enough of
    docs = bound(docs, "h", F.array_distinct(F.filter(_pairs(F.col("w")), lambda x: x.isin(*every)))).where(F.size("h") >= min(math.ceil(len(g) * ratio - 1e-9) for g in grams.values()))
    docs = bound(docs, "t", F.filter(made, lambda t: (F.size(F.array_intersect("h", t["bigrams"])) >= t["least"]) & (F.size(F.array_except(t["versions"], "h")) == 0))).where(F.size("t") > 0)
    docs = bound(docs, "p", _pairs(F.col("w")))
    docs = bound(docs, "e", _earlier(F.col("p")))
    docs = bound(docs, "windows", F.transform("t", lambda t: F.struct(t["license"].alias("license"), _best_window(F.col("p"), F.col("e"), t).alias("dice"), F.lit(0).alias("unit"))))
    units = F.array_distinct(F.concat(F.array("text"), F.split("text", "\n"), F.split("text", r"\n[ \t\r]*\n")))
    parts = docs.select("doc_id", "t", "windows", F.posexplode(units).alias("unit", "part"))
    parts = bound(parts.select("doc_id", "t", "windows", "unit", _words(F.col("part")).alias("words")), "u", F.col("words"))
    parts = bound(parts.select("doc_id", "t", "windows", "unit", F.when(F.size("u") >= 2, F.array_distinct(_pairs(F.col("u")))).otherwise(_strings([])).alias("grams")), "g", F.col("grams"))

    def compared(t):
        fits = (F.size("g") >= t["m"] * ratio) & (F.size("g") <= t["m"] / ratio)
        dice = F.when(fits & (F.size(F.array_except(t["versions"], "g")) == 0), 2.0 * F.size(F.array_intersect("g", t["bigrams"])) / (F.size("g") + t["m"]))
        return F.struct(t["license"].alias("license"), dice.alias("dice"), F.col("unit").alias("unit"))

    found = F.concat(F.transform("t", compared), F.when(F.col("unit") == 0, F.col("windows")).otherwise(F.slice("windows", 1, 0)))
    hits = parts.select("doc_id", F.explode(F.filter(found, lambda x: x["dice"] >= threshold)).alias("x"))
    best = hits.groupBy("doc_id", "x.license").agg(F.min(F.struct(-F.col("x.dice"), "x.unit")).alias("b"))
    return best.select("doc_id", "license", (-F.col("b.col1")).alias("dice"), F.col("b.unit").alias("unit"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", F.round("dice", 6).alias("dice"))


def oracle() -> str:
    """DuckDB: every unit and every window against every template whose bigrams a text holds enough of."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda values: f"[{', '.join(map(q, values))}]::VARCHAR[]"
    rows = ", ".join(f"({q(name)}, {listed(template_bigrams(t))}, {listed(version_bigrams(t))}, {longest_window(t)})" for name, t in TEMPLATES.items())
    words = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    dice = "2.0 * len(list_intersect(g, b)) / (len(g) + len(b))"
    return f"""
WITH t(license, b, v, longest) AS (VALUES {rows}),
whole AS (SELECT doc_id, text, {pairs} AS p FROM (SELECT doc_id, text, {words("text")} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 2),
near AS (SELECT doc_id, text, p, t.* FROM whole, t WHERE len(list_intersect(list_distinct(p), b)) >= len(b) * {THRESHOLD / (2 - THRESHOLD)} - 1e-9),
u AS (SELECT doc_id, license, b, v, unnest([text] || string_split(text, chr(10)) || regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS part FROM near),
g AS (SELECT doc_id, license, b, v, list_distinct({pairs}) AS g FROM (SELECT *, {words("part")} AS w FROM u) WHERE len(w) >= 2),
a AS (SELECT *, unnest(range(1, len(p) + 1)) AS a FROM near),
e AS (SELECT *, unnest(range(a, least(len(p), a + longest - 1) + 1)) AS e FROM a WHERE list_contains(b, p[a])),
x AS (SELECT doc_id, license, b, v, g FROM g UNION ALL SELECT doc_id, license, b, v, list_distinct(list_slice(p, a, e)) AS g FROM e)
SELECT doc_id, license, round(max({dice}), 6) AS dice FROM x WHERE {dice} >= {THRESHOLD} AND list_has_all(g, v) GROUP BY doc_id, license"""

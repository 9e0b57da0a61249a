"""License scan with built-in functions alone: Dice coefficient over word bigrams against licence templates.

A text is lowered, everything but letters, digits and line feeds becomes a space. Its units are its lines, the whole text
where it has several lines, and windows: runs of as many words as a template has, across lines, that begin with one of its
bigrams. Matching windows that overlap form one region, which is given with its best coefficient and ends with the last of
the template's bigrams in it; so a licence wrapped over the lines of a long file is found, and so is a notice inside a longer
sentence.

Size bounds prune: a unit whose distinct bigrams number n can reach the coefficient t against a template of m bigrams only
if t / (2 - t) <= n / m <= (2 - t) / t; words bound n, so short units fall by counting words, and each template is
compared only within its bounds. At least m * t / (2 - t) of a template's bigrams are needed, so a unit must have one of a
few words of it: texts without such a word of any template fall before they are split, units without one fall next. Of
windows only those are compared that hold enough of the template's bigrams, told from their positions alone. The plan is
narrow: nothing is shuffled, joined or broadcast, so skewed keys don't matter.

Null or empty text has no unit. Repeated rows are scanned each. Equal coefficients: every template that reaches t is given.
Very long texts are read whole. Templates are a bounded parameter (MAX_BIGRAMS). An empty table gives an empty result. Only
the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_BIGRAMS = 50_000
WHOLE = -1
#: Words that many texts have; other words are looked for first.
FREQUENT = frozenset("a all an and any are as at be by for from in is it may not of on or that the this to with you".split())
#: What is no part of a word, for both Java's and RE2's expressions.
NOT_WORD = r"[^\p{L}\p{N}\n]+"

# Licence notices and texts.
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of"
_VERSION = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
_LESSER = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": f"{_BSD} {_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "BSL-1.0": _BOOST,
    "AGPL-3.0": f"{_FREE} the GNU Affero General Public License {_VERSION.format(3)} {_HOPE} GNU Affero General Public License for more details.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": f"{_FREE} the GNU General Public License {_VERSION.format(2)} {_HOPE} GNU General Public License for more details.",
    "LGPL-2.1": _LESSER,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib": _ZLIB,
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": _PERMISSION,
    "MIT-notice": "Released under the MIT License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def normalised_words(text: str) -> list[str]:
    """A template's words; the same rule as for units."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = normalised_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _share(t: float) -> Fraction:
    """The threshold as the exact fraction that its decimal form says; bounds are compared in whole numbers."""
    return Fraction(str(t))


def _bounds(sizes: list[int], t: float) -> tuple[int, int]:
    """Least and most distinct bigrams of a unit that can match any template."""
    r = _share(t) / (2 - _share(t))
    return int(-(-min(sizes) * r // 1)), int(max(sizes) / r // 1)


def anchors_of(grams: list[str], t: float) -> set[str]:
    """Words of which a unit must have one to reach t: without them too few of a template's bigrams are left. Words of
    FREQUENT come last, long ones first, as rare ones mostly are."""
    needed = -(-len(grams) * _share(t) / (2 - _share(t)) // 1)
    left, chosen = [g.split(" ") for g in grams], set()
    for word in sorted({w for g in left for w in g}, key=lambda w: (w in FREQUENT, -len(w), w)):
        if len(left) < needed:
            break
        chosen.add(word)
        left = [g for g in left if word not in g]
    return chosen


def _words(line: Column) -> Column:
    """Its words; one empty word for a line without any."""
    return F.split(F.trim(line), " ")


def any_word(words: set[str]) -> str:
    """An expression that finds one of `words`, which are letters and digits; tried at starts of words alone, by first letters."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(words):
        by_first.setdefault(word[0], []).append(word[1:])
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + r")(?![\p{L}\p{N}])"


def _needed(n: int, t: float) -> int:
    """How many of a template's n bigrams a unit must have."""
    return int(-(-n * _share(t) / (2 - _share(t)) // 1))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions read instead of computing them again: a generator is between."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__held")).select("*", "__held.*").drop("__held")


def _pairs(words: Column) -> Column:
    fewer = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), fewer), F.slice(words, F.lit(2), fewer), lambda a, b: F.concat(a, F.lit(" "), b))


def _shared_and_both(grams: Column, template: Column) -> tuple[Column, Column]:
    return F.size(F.array_intersect(grams, template)), F.size(grams) + F.size(template)


def _of_units(split: DataFrame, sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """Lines and whole texts that match."""
    p, q = _share(threshold).numerator, _share(threshold).denominator
    every = sorted({g for grams in sets.values() for g in grams})
    least, most = _bounds([len(g) for g in sets.values()], threshold)
    anchors = sorted({w for grams in sets.values() for w in anchors_of(grams, threshold)})
    whole = F.when(F.size("lines") > 1, F.array(F.array_remove(F.flatten("lines"), ""))).otherwise(F.array().cast("array<array<string>>"))
    units = split.select("doc_id", F.size("lines").alias("n_lines"), F.posexplode(F.concat("lines", whole)).alias("place", "words"))
    units = units.where((F.size("words") > least) & F.exists("words", lambda w: w.isin(anchors)))
    known = F.filter(_pairs(F.col("words")), lambda g: g.isin(every))
    line = F.when(F.col("place") == F.col("n_lines"), WHOLE).otherwise(F.col("place"))
    hit = units.where(F.size(known) >= least).select("doc_id", line.alias("line"), F.array_distinct(_pairs(F.col("words"))).alias("grams"))
    candidates = F.array(*(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("t")) for name, grams in sorted(sets.items())))
    n, m = F.size("grams"), lambda c: F.size(c["t"])
    near = F.filter(candidates, lambda c: (n * (2 * q - p) >= m(c) * p) & (n * p <= m(c) * (2 * q - p)))
    scored = hit.where(n.between(least, most)).select("doc_id", "line", "grams", F.explode(near).alias("c"))
    shared, both = _shared_and_both(F.col("grams"), F.col("c.t"))
    scored = scored.select("doc_id", "line", "c.license", shared.alias("shared"), both.alias("both"))
    dice = F.round(F.lit(2.0) * F.col("shared") / F.col("both"), 6).alias("dice")
    unit = F.when(F.col("line") == WHOLE, "text").otherwise("line").alias("unit")
    return scored.where(F.col("shared") * (2 * q) >= F.col("both") * p).select("doc_id", unit, "line", F.col("line").alias("last_line"), "license", dice)


def _of_windows(split: DataFrame, templates: dict[str, str], sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """Regions of overlapping windows that match."""
    p, q = _share(threshold).numerator, _share(threshold).denominator
    filled = F.transform("lines", lambda line: F.array_remove(line, ""))
    rows = _held(split, filled=filled).drop("lines")
    rows = _held(rows, words=F.flatten("filled"), at=F.flatten(F.transform("filled", lambda line, i: F.array_repeat(i, F.size(line))))).drop("filled")
    rows = _held(rows, pairs=_pairs(F.col("words"))).select("doc_id", "at", "pairs")
    size = {name: len(normalised_words(templates[name])) for name in sets}
    each = (
        F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("t"), F.lit(size[name]).alias("n"), F.lit(_needed(len(grams), threshold)).alias("needed"))
        for name, grams in sorted(sets.items())
    )
    rows = rows.select("*", F.explode(F.array(*each)).alias("c")).select("*", "c.*").where(F.size(F.array_intersect("pairs", "t")) >= F.col("needed"))
    known = F.filter(F.transform("pairs", lambda g, i: F.when(F.array_contains("t", g), i)), lambda i: i.isNotNull())
    rows = _held(rows, known=known)
    # a window that begins at a known bigram has enough of them if the last one needed is inside
    enough = lambda s, a: F.get("known", a + F.col("needed") - 1) <= s + F.col("n") - 2
    rows = _held(rows, starts=F.filter(F.transform("known", lambda s, a: F.when(enough(s, a), s)), lambda s: s.isNotNull()))
    rows = rows.where(F.size("starts") > 0)

    def scored(s: Column) -> Column:
        shared, both = _shared_and_both(F.array_distinct(F.slice("pairs", s + 1, F.col("n") - 1)), F.col("t"))
        return F.when(shared * (2 * q) >= both * p, F.struct(s.alias("first"), s.alias("last"), (F.lit(2.0) * shared / both).alias("dice")))

    rows = _held(rows, hits=F.filter(F.transform("starts", scored), lambda h: h.isNotNull()))

    def grown(regions: Column, hit: Column) -> Column:
        last = F.get(regions, F.size(regions) - 1)
        wider = F.struct(last["first"].alias("first"), hit["last"].alias("last"), F.greatest(last["dice"], hit["dice"]).alias("dice"))
        joins = (F.size(regions) > 0) & (hit["first"] - last["last"] < F.col("n"))
        return F.when(joins, F.concat(F.slice(regions, F.lit(1), F.greatest(F.size(regions) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(regions, F.array(hit)))

    none = F.array().cast("array<struct<first:int,last:int,dice:double>>")
    found = rows.select("doc_id", "license", "at", "n", "known", F.explode(F.aggregate("hits", none, grown)).alias("r"))
    inside = F.filter("known", lambda i: i <= F.col("r.last") + F.col("n") - 2)
    first, last = F.get("at", F.col("r.first")), F.get("at", F.array_max(inside) + 1)
    return found.select("doc_id", F.lit("window").alias("unit"), first.alias("line"), last.alias("last_line"), "license", F.round("r.dice", 6).alias("dice"))


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit (line, text or window), line and last_line (from 0; -1 for a whole text), license, dice (six decimals):
    each unit and template at `threshold` or more."""
    templates = TEMPLATES if templates is None else templates
    sets = {name: grams for name, text in templates.items() if (grams := bigrams_of(text))}
    if sum(map(len, sets.values())) > MAX_BIGRAMS:
        raise ValueError(f"templates have more than {MAX_BIGRAMS} bigrams")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("low"))
    if not sets:
        return rows.where(F.lit(False)).selectExpr("doc_id", "'' AS unit", "0 AS line", "0 AS last_line", "'' AS license", "0D AS dice")
    anchors = {w for grams in sets.values() for w in anchors_of(grams, threshold)}
    split = rows.where(F.col("low").rlike(any_word(anchors))).select("doc_id", F.regexp_replace("low", NOT_WORD, " ").alias("norm"))
    split = split.select("doc_id", F.explode(F.array(F.transform(F.split("norm", "\n"), _words))).alias("lines"))
    return _of_units(split, sets, threshold).unionByName(_of_windows(split, templates, sets, threshold))


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in SQL over the table documents."""
    templates = TEMPLATES if templates is None else templates
    sets = {name: bigrams_of(text) for name, text in templates.items()}
    values = ", ".join(
        f"('{name}', {len(normalised_words(templates[name]))}, {_needed(len(grams), threshold)}, [{', '.join(repr(g) for g in grams)}])"
        for name, grams in sorted(sets.items())
    )
    filled = "list_filter(string_split(l, ' '), lambda w: w <> '')"
    return f"""
WITH templates(license, n, needed, t) AS (VALUES {values}),
norm AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_replace(lower(text), '{NOT_WORD.replace(chr(92) + "n", chr(10))}', ' ', 'g') AS norm FROM documents WHERE text IS NOT NULL),
lines AS (SELECT row_id, doc_id, string_split(norm, chr(10)) AS ls FROM norm),
units AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS unit FROM lines UNION ALL SELECT doc_id, -1, array_to_string(ls, ' ') FROM lines WHERE len(ls) > 1),
words AS (SELECT doc_id, line, list_filter(string_split(unit, ' '), lambda w: w <> '') AS w FROM units),
grams AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
scored AS (SELECT doc_id, line, license, 2.0 * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice FROM grams, templates WHERE len(g) * {2 - threshold} >= len(t) * {threshold} AND len(g) * {threshold} <= len(t) * {2 - threshold}),
flat AS (SELECT row_id, doc_id, flatten(list_transform(ls, lambda l: {filled})) AS w, flatten(list_transform(range(len(ls)), lambda i: list_transform({filled.replace("(l,", "(ls[i + 1],")}, lambda w: i))) AS line_of FROM lines),
pairs AS (SELECT row_id, doc_id, line_of, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM flat),
near AS (SELECT * FROM pairs, templates WHERE len(list_intersect(g, t)) >= needed),
known AS (SELECT *, list_filter(range(len(g)), lambda i: list_contains(t, g[i + 1])) AS k FROM near),
starts AS (SELECT *, unnest(list_filter(list_transform(range(len(k)), lambda a: CASE WHEN k[a + needed] <= k[a + 1] + n - 2 THEN k[a + 1] END), lambda s: s IS NOT NULL)) AS s FROM known),
windows AS (SELECT *, list_distinct(g[s + 1 : s + n - 1]) AS win FROM starts),
hits AS (SELECT row_id, doc_id, line_of, license, n, k, s, 2.0 * len(list_intersect(win, t)) / (len(win) + len(t)) AS dice FROM windows WHERE 2.0 * len(list_intersect(win, t)) / (len(win) + len(t)) >= {threshold}),
edges AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY row_id, license ORDER BY s) < n THEN 0 ELSE 1 END AS edge FROM hits),
regions AS (SELECT *, sum(edge) OVER (PARTITION BY row_id, license ORDER BY s) AS region FROM edges),
spans AS (SELECT doc_id, license, any_value(line_of) AS line_of, any_value(n) AS n, any_value(k) AS known, min(s) AS begins, max(s) AS ends, max(dice) AS dice FROM regions GROUP BY row_id, doc_id, license, region)
SELECT doc_id, CASE WHEN line = -1 THEN 'text' ELSE 'line' END AS unit, line::INT AS line, line::INT AS last_line, license, round(dice::DOUBLE, 6) AS dice FROM scored WHERE dice >= {threshold}
UNION ALL
SELECT doc_id, 'window', line_of[begins + 1]::INT, line_of[list_max(list_filter(known, lambda i: i <= ends + n - 2)) + 2]::INT, license, round(dice::DOUBLE, 6) FROM spans
"""

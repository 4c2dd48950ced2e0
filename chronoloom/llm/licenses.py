"""License scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions only.

Documents and templates are normalised alike: A-Z in lower case, other characters than letters and digits of ASCII become one space; so
line ends, indents and marks between words don't matter, and a notice may stand anywhere in a text, within a line or over many.

A match at Dice >= LEAST has LEAST / (2 - LEAST) of a template's bigrams at least. So a template has anchors(): bigrams, one more than a match may lack,
of which each match has one; an inverted index of them, which is as large as the templates and broadcast, gives the candidates. An anchor tells
where the notice would begin. Around it windows() are compared: one of the template's size, and such as have up to a quarter of the words put in or left out
before or after the anchor. Sizes of windows lie within the bounds that LEAST sets for sets of bigrams.

Null and empty texts, and texts of one word, match nothing. The best window of a document and licence is reported: that of greatest Dice, then the first, then the
shortest. Repeated rows of documents count as one under their doc_id; rows without doc_id form one group. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Notices and texts as licences word them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0 header": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MIT permission": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all rights reserved": ["Copyright. All rights reserved."],
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that say little, so they make poor anchors.
DULL = frozenset("the a of to and in is or you any this that with by at for be under it on are not may can as if no will".split())
#: Quarters of a template that a window begins and ends later than the template would.
SHIFTS = [(0, 0), (0, 1), (-1, 0), (0, -1), (1, 0)]


def plain(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def named(templates: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """(licence, words)."""
    return [(name, plain(t)) for name, ts in (templates or TEMPLATES).items() for t in ts]


def share(least: float) -> float:
    """What a match has of a template's bigrams, at least."""
    return least / (2 - least)


def anchors(words: list[str], least: float = LEAST) -> list[str]:
    """Bigrams of a template, one more than a match may lack; those that are likely to be rare."""
    grams = sorted(set(pairs(words)))
    telling = lambda g: sum(min(len(w), 9) for w in g.split() if w not in DULL and not w.isdigit())
    return sorted(grams, key=lambda g: (-telling(g), g))[: int(len(grams) - share(least) * len(grams) + 1e-9) + 1]


def index(templates: dict[str, list[str]] | None = None, least: float = LEAST) -> list[tuple[str, str, int, int, list[str]]]:
    """(anchor, licence, its place in the template, words of the template, the template's bigrams)."""
    out = []
    for name, words in named(templates):
        chosen = set(anchors(words, least))
        out += [(g, name, at, len(words), sorted(set(pairs(words)))) for at, g in enumerate(pairs(words)) if g in chosen]
    return out


def hints(known: list[tuple]) -> list[str]:
    """Words of which every match has one: the longer word of each anchor."""
    return sorted({max(g.split(), key=lambda w: (w not in DULL, len(w), w)) for g, *_ in known})


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, least: float = LEAST, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, dice, first_word, n_words): for each document of docs(doc_id, text) and licence the window of best Dice.

    first_word counts the words of the normalised text from 0. templates are texts by licence, as TEMPLATES are.
    """
    known = index(templates, least)
    table = F.broadcast(docs.sparkSession.createDataFrame(known, "gram string, license string, at int, m int, t array<string>"))
    rows = docs.select("doc_id", F.split(_normal(F.coalesce("text", F.lit(""))), " ").alias("w"))
    rows = rows.where(F.arrays_overlap("w", F.array(*map(F.lit, hints(known)))))
    # explode_outer: for explode, Catalyst adds a filter on the whole array and pushes it below the projections
    rows = rows.select("doc_id", "w", F.posexplode_outer("w").alias("p", "x"))
    rows = rows.withColumn("gram", F.concat_ws(" ", "x", F.get("w", F.col("p") + 1))).join(table, "gram")
    quarter = F.call_function("div", F.col("m"), F.lit(4)).cast("int")
    ends = [F.struct((F.col("p") - F.col("at") + a * quarter).alias("a"), (F.col("p") - F.col("at") + F.col("m") + b * quarter).alias("b")) for a, b in SHIFTS]
    rows = rows.select("doc_id", "w", "license", "t", F.explode_outer(F.array(*ends)).alias("s"))
    a, b = F.greatest("s.a", F.lit(0)), F.least("s.b", F.size("w"))
    rows = rows.select("doc_id", "license", "t", a.alias("a"), (b - a).alias("n_words"), F.slice("w", a + 1, F.greatest(b - a, F.lit(0))).alias("v")).where(F.col("n_words") >= 2)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("v") - 2), lambda i: F.concat_ws(" ", F.get("v", i), F.get("v", i + 1))))
    rows = rows.select("doc_id", "license", "t", "a", "n_words", grams.alias("g"))
    fits = F.size("g").between(F.size("t") * F.lit(share(least)) - 1e-6, F.size("t") / F.lit(share(least)) + 1e-6)
    dice = F.when(fits, 2 * F.size(F.array_intersect("g", "t")) / (F.size("g") + F.size("t")))
    found = rows.select("doc_id", "license", "a", "n_words", dice.alias("dice")).where(F.col("dice") >= least)
    best = found.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("dice")).alias("d"), "a", "n_words")).alias("m"))
    return best.select("doc_id", "license", (-F.col("m.d")).alias("dice"), F.col("m.a").cast("long").alias("first_word"), F.col("m.n_words").cast("long").alias("n_words"))


def sql(least: float = LEAST) -> str:
    """The same result in DuckDB SQL, without hints."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(g)}, {quote(name)}, {at}, {m}, [{', '.join(map(quote, t))}])" for g, name, at, m, t in index(least=least))
    normal = "trim(regexp_replace(translate(text, '%s', '%s'), '[^a-z0-9]+', ' ', 'g'))" % (UPPER, LOWER)
    shifts = ", ".join(f"({a}, {b})" for a, b in SHIFTS)
    return f"""
with known(gram, license, o, m, t) as (values {known}),
d as (select doc_id, string_split({normal}, ' ') as w, row_number() over () as r from documents where text is not null),
g as (select r, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as gram, unnest(range(len(w) - 1)) as p from d),
h as (select r, license, t, p - o as start, m from g join known using (gram)),
s as (select distinct r, license, t, greatest(start + a * (m // 4), 0) as a, start + m + b * (m // 4) as e from h, (values {shifts}) v(a, b)),
x as (select doc_id, license, t, a, least(e, len(w)) - a as n_words, w[a + 1:least(e, len(w))] as v from s join d using (r)),
y as (select doc_id, license, t, a, n_words, list_distinct([v[i] || ' ' || v[i + 1] for i in range(1, len(v))]) as g from x where n_words >= 2),
z as (select doc_id, license, a, n_words, 2 * len(list_intersect(g, t))::double / (len(g) + len(t)) as dice from y where len(g) between len(t) * {share(least)!r} - 1e-6 and len(t) / {share(least)!r} + 1e-6)
select doc_id, license, dice, a::bigint as first_word, n_words::bigint as n_words from z where dice >= {least} qualify row_number() over (partition by doc_id, license order by dice desc, a, n_words) = 1"""

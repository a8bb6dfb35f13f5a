"""Operator 6: licence scans with DataFrame functions only.

A text is lower-cased and cut into words, and the distinct bigrams that it shares with any
template are found by hash sets; they name the templates that can reach the threshold. For each of these, the passage compared is the
stretch of text that lies best on the template: shared bigrams count for it and all others
against it in the ratio that the Dice threshold sets, so some stretch reaches the threshold
only if the best one does. It may be part of a line, run over many wrapped lines or be the
whole text. The Dice coefficient is then taken over the bigram sets of passage and
template. All of it is built-in expressions over one row: no shuffle, no Python worker.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: A template of fewer bigrams must be there whole: one word less would be another licence.
WHOLE_BELOW = 5
# Public licence notices and short licences, as their owners word them.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
#: What is not part of a word; ASCII letters and digits and whatever is not ASCII are.
APART = r"[^a-z0-9\x{80}-\x{10ffff}]+"
COLUMNS = ("licence", "licence_dice", "licence_start", "licence_words", "licences")


def plain(text: str) -> list[str]:
    """The words of a template, as the expressions below have them."""
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.lower()).split()


def bigrams(found: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def known(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(name, bigrams) in order of names; a template of one word has no bigram and is left out."""
    return [(name, b) for name, texts in sorted(templates.items()) for t in texts if (b := bigrams(plain(t)))]


def least_shared(n: int, threshold: float) -> int:
    """Bigrams that a passage at the threshold shares with a template of n, whatever its own size."""
    return n if n < WHOLE_BELOW else math.ceil(threshold / (2 - threshold) * n - 1e-9)


def gain(threshold: float) -> tuple[int, int]:
    """What a shared bigram counts for a passage, and any other against it: (2 - t) to t, as integers."""
    return round(100 * (2 - threshold)), round(100 * threshold)


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with licence, licence_dice (millionths, long), licence_start and licence_words (long), and licences (array).

    licence names the template whose passage has the highest Dice coefficient, null if none reaches the
    threshold; ties go to the name that sorts first. licence_start is the number of the word (from 1) at which
    its passage begins, licence_words its length. licences are all names that reach the threshold, sorted, but for
    those whose passage overlaps one of a higher coefficient. A null or empty text, or one of a single
    word, holds none. Texts of any length are scanned whole; left out are only templates of which a text shares
    too few bigrams to reach the threshold. Repeated rows get equal results, an empty table an empty one;
    clashing columns of docs give way.
    """
    docs = docs.drop(*COLUMNS)
    kinds = known(templates or TEMPLATES)
    if not kinds:
        none = ["string", "bigint", "bigint", "bigint", "array<string>"]
        return docs.select(*docs.columns, *(F.lit(None).cast(t).alias(c) for c, t in zip(COLUMNS[:-1], none, strict=False)), F.array().cast("array<string>").alias("licences"))
    up, down = gain(threshold)
    every = sorted({b for _, bs in kinds for b in bs})
    table = ", ".join(f"named_struct('place', {-k}, 'n', {len(bs)}, 'least', {least_shared(len(bs), threshold)}, 'b', array({quoted(bs)}))" for k, (_, bs) in enumerate(kinds))
    least = min(least_shared(len(bs), threshold) for _, bs in kinds)
    # w: words; b: bigrams, a null in the last place; d: distinct ones of any template; c: templates that share enough
    w = f"array_remove(split(lower(`{text_col}`), r'{APART}'), '')"
    b = "zip_with(w, slice(w, 2, size(w)), (x, y) -> if(y is null, null, concat(x, ' ', y)))"
    d = f"array_intersect(b, array({quoted(every)}))"
    c = f"if(size(d) < {least}, null, filter(array({table}), t -> size(array_intersect(t.b, d)) >= t.least))"
    # h: shared bigrams with their places, from 1; o: those of one template
    h = "filter(transform(b, (x, i) -> struct(i + 1 as at, x as b)), x -> array_contains(d, x.b))"
    o = "filter(h, x -> array_contains(t.b, x.b))"
    # the best passage from one shared bigram to another: both + v(last) - v(first), where v(x) = (up + down) * number of x - down * place of x
    v = f"{up + down} * (s.n + 1) - {down} * x.at"
    move = f"named_struct('n', s.n + 1, 'v', {v}, 'low', if(s.n = 0 or {v} < s.low, {v}, s.low), 'from', if(s.n = 0 or {v} < s.low, x.at, s.from), 'best', s.best, 'at', s.at, 'to', s.to)"
    keep = "if(s.v - s.low >= s.best, if(s.v - s.low > s.best, named_struct('n', s.n, 'v', s.v, 'low', s.low, 'from', s.from, 'best', s.v - s.low, 'at', s.from, 'to', x.at), s), s)"
    best = f"aggregate(o, named_struct('n', 0, 'v', 0, 'low', 0, 'from', 0, 'best', -1, 'at', 0, 'to', 0), (s, x) -> {bind('s', move, keep)})"
    shared = "size(array_distinct(transform(filter(o, x -> x.at between p.at and p.to), x -> x.b)))"
    dice = f"if({shared} >= t.least, cast(floor(2000000L * {shared} / (size(array_distinct(slice(b, p.at, p.to - p.at + 1))) + t.n)) as bigint), 0L)"
    passage = bind("o", o, bind("p", best, f"named_struct('dice', {dice}, 'place', t.place, 'at', p.at, 'size', p.to - p.at + 2)"))
    good = bind("h", h, f"filter(transform(c, t -> {passage}), p -> p.dice >= {math.ceil(threshold * 1_000_000 - 1e-6)})")
    apart = "filter(g, p -> not exists(g, q -> q.dice > p.dice and q.at < p.at + p.size - 1 and p.at < q.at + q.size - 1))"
    found = bind("w", w, bind("b", b, bind("d", d, bind("c", c, f"if(size(c) > 0, {bind('g', good, apart)}, null)"))))
    names = f"array({quoted([n for n, _ in kinds])})"
    row = f"named_struct('licence', {names}[-t.place], 'licence_dice', t.dice, 'licence_start', cast(t.at as bigint), 'licence_words', cast(t.size as bigint), 'licences', array_sort(array_distinct(transform(coalesce(g, array()), p -> {names}[-p.place]))))"
    return docs.select(*docs.columns, F.inline(F.expr(f"array({bind('g', found, bind('t', 'array_max(g)', row))})")))


def bind(name: str, value: str, body: str) -> str:
    """body with name standing for value, which is computed once: a transform over an array of one element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def op6(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", "licence", "licence_dice", "licence_start", "licence_words", F.array_join("licences", ",").alias("licences"))


def op6_sql(threshold: float = THRESHOLD) -> str:
    """The same scan for DuckDB without its shortcuts: every bigram of every text against every template."""
    up, down = gain(threshold)
    rows = ", ".join(f"({k}, '{name}', {least_shared(len(bs), threshold)}, [{quoted(bs)}])" for k, (name, bs) in enumerate(known(TEMPLATES)))
    return f"""
WITH templates(place, name, least, bigrams) AS (VALUES {rows}),
entries AS (SELECT place, unnest(bigrams) AS b FROM templates),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    string_split(trim(regexp_replace(lower(text), '{APART}', ' ', 'g')), ' ') AS w FROM documents),
pairs AS (SELECT r, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM texts),
shared AS (
  SELECT r, place, pos, b, {up + down} * row_number() OVER (PARTITION BY r, place ORDER BY pos) - {down} * pos AS v
  FROM pairs JOIN entries USING (b)),
lows AS (SELECT *, min({{'v': v, 'at': pos}}) OVER (PARTITION BY r, place ORDER BY pos) AS low FROM shared),
passages AS (
  SELECT r, place, low['at'] AS first, pos AS last FROM lows
  QUALIFY row_number() OVER (PARTITION BY r, place ORDER BY v - low['v'] DESC, pos) = 1),
sizes AS (
  SELECT p.r, p.place, first, last, (SELECT count(DISTINCT b) FROM shared s WHERE s.r = p.r AND s.place = p.place AND s.pos BETWEEN first AND last) AS both_,
    len(list_distinct(list_transform(range(first, last + 1), lambda i: w[i] || ' ' || w[i + 1]))) AS own
  FROM passages p JOIN texts t ON t.r = p.r),
scores AS (
  SELECT r, z.place, name, first, last, CAST(2000000 * both_ // (own + len(bigrams)) AS BIGINT) AS dice
  FROM sizes z JOIN templates t ON t.place = z.place WHERE both_ >= least),
high AS (SELECT * FROM scores WHERE dice >= {math.ceil(threshold * 1_000_000 - 1e-6)}),
good AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, place) AS n FROM high p
  WHERE NOT EXISTS (SELECT 1 FROM high q WHERE q.r = p.r AND q.dice > p.dice AND q.first <= p.last AND p.first <= q.last)),
names AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM good GROUP BY r)
SELECT doc_id, name AS licence, dice AS licence_dice, CAST(first AS BIGINT) AS licence_start, CAST(last - first + 2 AS BIGINT) AS licence_words, coalesce(licences, '') AS licences
FROM texts t LEFT JOIN good g ON g.r = t.r AND n = 1 LEFT JOIN names m ON m.r = t.r
"""

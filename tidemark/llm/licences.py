"""Licence scan: lines, whole texts and windows of them compared with licence texts by the Dice coefficient of word bigrams.

Texts are lower-cased and cut into runs of a-z and 0-9. A unit (each line, and the whole text if it has several) with
A distinct bigrams and a template with B have 2 * shared / (A + B); at a least value t only templates with
2 * min(A, B) >= t * (A + B), in whole numbers, are compared, and a unit beyond every template's bounds, or without a
bigram of any template, is dropped first. A whole text of any length is a unit; one whose first words already have more
distinct bigrams than the bounds allow is dropped before the rest is cut. The best template of a unit counts, ties by the template's name.

A licence that is wrapped over lines, or stands inside other text, is found by windows: a window of a template begins at a bigram
of the template and has as many words as it. At least m = B t / (2 - t) of the template's bigrams, with repeats, must lie in it,
which the places of known bigrams tell without looking at the window; those left are compared exactly. The best window of a
template counts, ties by the first.

DataFrame functions only, in one pass without a shuffle; the templates are a constant. Null and empty texts match
nothing, like units of fewer than two words; repeated rows are scanned one by one; extra columns are not looked at.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

LEAST = 0.8

# Usual licence notices by SPDX-like name.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("bsd", "Licensed under the BSD License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_bigrams() -> list[tuple[str, list[str]]]:
    """(name, distinct bigrams) of each template, in the order of names and texts."""
    words = [(name, _words(text)) for name, text in sorted(TEMPLATES)]
    return [(name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})) for name, w in words]


def template_lengths() -> list[int]:
    """Words of each template, in the same order."""
    return [len(_words(text)) for _, text in sorted(TEMPLATES)]


def _bigrams(words: str) -> str:
    return f"array_distinct(transform(sequence(0, size({words}) - 2), i -> concat({words}[i], ' ', {words}[i + 1])))"


def _windows(least: float) -> str:
    """SQL for array<struct<template, start, id, dice>> of a text's bigrams g and the places h of the known ones: of each template
    (by number) the best window of at least that Dice coefficient, and the word at which it starts."""
    p, q = Fraction(str(least)).as_integer_ratio()
    parts = []
    for k, ((name, bs), n) in enumerate(zip(template_bigrams(), template_lengths(), strict=True)):
        m = -(-len(bs) * p // (2 * q - p))
        parts.append(f"named_struct('k', {k}, 'id', '{name}', 'n', {len(bs)}, 'm', {m}, 'l', {n - 1}, 'b', array({', '.join(repr(b) for b in bs)}))")
    # places of the template's bigrams, those from which enough others are near, and these windows compared
    own = "filter(h, i -> array_contains(t.b, g[i]))"
    near = "filter(transform(o, (i, j) -> if(get(o, j + t.m - 1) <= i + t.l - 1, i, null)), i -> i is not null)"
    dice = "transform(array(slice(g, i + 1, t.l)), w -> round(2D * size(array_intersect(w, t.b)) / (size(array_distinct(w)) + t.n), 6))[0]"
    best = f"array_min(transform({near}, i -> named_struct('d', -{dice}, 's', i)))"
    each = f"transform(array({own}), o -> if(size(o) < t.m, null, named_struct('template', t.k, 'id', t.id, 'best', {best})))[0]"
    scored = f"filter(transform(filter(array({', '.join(parts)}), t -> size(h) >= t.m), t -> {each}), x -> x.best.d <= -{least})"
    return f"transform({scored}, x -> named_struct('template', x.template, 'start', x.best.s, 'id', x.id, 'dice', -x.best.d))"


def scan(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, `found`: array<struct<line, id, dice>>, line from 0 or -1 for the whole text, and `windows`:
    array<struct<template, start, id, dice>>, start in words from 0."""
    templates = template_bigrams()
    known = ", ".join(f"'{b}'" for b in sorted({b for _, bs in templates for b in bs}))
    p, q = Fraction(str(least)).as_integer_ratio()
    most = max(len(bs) for _, bs in templates) * (2 * q - p) // p
    fewest = -(-min(len(bs) for _, bs in templates) * p // (2 * q - p))
    literal = ", ".join(f"named_struct('id', '{name}', 'n', {len(bs)}, 'b', array({', '.join(repr(b) for b in bs)}))" for name, bs in templates)
    lines = F.split(text_of("text"), "\n", -1)
    rows = documents.select("doc_id", F.transform(lines, lambda x: F.split(F.lower(x), "[^a-z0-9]+")).alias("w"))
    # a separator at either end leaves an empty word there
    rows = rows.withColumn("w", F.expr("transform(w, (x, i) -> named_struct('line', i, 'w', filter(x, y -> y <> '')))"))
    rows = rows.withColumn("all", F.expr("flatten(w.w)"))
    rows = rows.withColumn("g", F.expr("if(size(all) < 2, cast(array() as array<string>), transform(sequence(0, size(all) - 2), i -> concat(all[i], ' ', all[i + 1])))"))
    rows = rows.withColumn("h", F.expr(f"if(size(g) = 0, cast(array() as array<int>), filter(sequence(0, size(g) - 1), i -> g[i] in ({known})))"))
    rows = rows.withColumn("windows", F.expr(_windows(least)))
    # distinct bigrams only grow with the text, so that a prefix with too many decides; the rest is compared whole
    few = f"transform(array(slice(x.w, 1, {4 * most})), y -> size(y) < 2 or size({_bigrams('y')}) <= {most})[0]"
    whole = f"filter(array(named_struct('line', -1, 'w', all)), x -> size(w) > 1 and {few})"
    # no line of a text without a known bigram can match
    rows = rows.withColumn("w", F.expr(f"if(size(h) = 0, slice(w, 1, 0), concat(w, {whole}))"))
    rows = rows.withColumn("u", F.expr(f"transform(filter(w, x -> size(x.w) > 1), x -> named_struct('line', x.line, 'b', {_bigrams('x.w')}))"))
    bounded = f"size(x.b) between {fewest} and {most}"
    rows = rows.withColumn("u", F.expr(f"filter(u, x -> {bounded} and exists(x.b, y -> y in ({known})))"))
    dice = "round(2D * size(array_intersect(x.b, t.b)) / (size(x.b) + t.n), 6)"
    bound = f"{2 * q}L * least(t.n, size(x.b)) >= {p}L * (t.n + size(x.b))"
    scored = f"transform(filter(array({literal}), t -> {bound}), t -> named_struct('d', -{dice}, 'id', t.id))"
    rows = rows.withColumn("s", F.expr(f"transform(u, x -> named_struct('line', x.line, 'best', array_min({scored})))"))
    found = f"transform(filter(s, x -> x.best.d <= -{least}), x -> named_struct('line', x.line, 'id', x.best.id, 'dice', -x.best.d))"
    return rows.select("doc_id", F.expr(found).alias("found"), "windows")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_matches (lines and whole texts), n_windows (templates with a window), licences (distinct names of both, in
    order), best_dice (0 if none) and windows (template:start, comma-joined)."""
    best = F.greatest(F.array_max(F.col("found.dice")), F.array_max(F.col("windows.dice")))
    at = F.transform("windows", lambda x: F.concat_ws(":", x["template"].cast("string"), x["start"].cast("string")))
    return scanned.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.size("windows").cast("long").alias("n_windows"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("found.id"), F.col("windows.id")))), ",").alias("licences"),
        F.coalesce(best, F.lit(0.0)).alias("best_dice"),
        F.array_join(at, ",").alias("windows"),
    )


def oracle_sql(least: float = LEAST) -> str:
    """The digest in DuckDB's SQL."""
    lengths = template_lengths()
    rows = ", ".join(f"({k}, '{name}', {len(bs)}, {lengths[k] - 1}, '{b}')" for k, (name, bs) in enumerate(template_bigrams()) for b in bs)
    return f"""
WITH t(k, id, n, l, b) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS v FROM (SELECT r, string_split(text, chr(10)) AS x FROM d)),
u AS (SELECT r, line, v FROM l
      UNION ALL SELECT r, -1, text FROM d WHERE contains(text, chr(10))),
w AS (SELECT r, line, list_filter(regexp_split_to_array(lower(v), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u),
b AS (SELECT r, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
e AS (SELECT r, line, len(b) AS a, unnest(b) AS b FROM b),
s AS (SELECT r, line, k, id, round(2.0 * count(*) / (any_value(a) + any_value(n)), 6) AS dice FROM e JOIN t USING (b) GROUP BY r, line, k, id),
m AS (SELECT r, line, id, dice FROM s WHERE dice >= {least}
      QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, id) = 1),
p AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g
      FROM (SELECT r, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM d) WHERE len(w) > 1),
o AS (SELECT r, unnest(g) AS b, generate_subscripts(g, 1) - 1 AS i FROM p),
z AS (SELECT DISTINCT r, i, k, id, n, l FROM o JOIN t USING (b)),
y AS (SELECT z.r, z.i, z.k, any_value(z.id) AS id, round(2.0 * count(DISTINCT o.b) FILTER (t.b IS NOT NULL) / (count(DISTINCT o.b) + any_value(z.n)), 6) AS dice
      FROM z JOIN o ON o.r = z.r AND o.i BETWEEN z.i AND z.i + z.l - 1 LEFT JOIN t ON t.k = z.k AND t.b = o.b GROUP BY z.r, z.i, z.k),
v AS (SELECT r, k, id, i, dice FROM y WHERE dice >= {least} QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, i) = 1),
g AS (SELECT r, count(*) AS n_matches FROM m GROUP BY r),
f AS (SELECT r, count(*) AS n_windows, string_agg(k || ':' || i, ',' ORDER BY k) AS windows FROM v GROUP BY r),
x AS (SELECT r, string_agg(DISTINCT id, ',' ORDER BY id) AS licences, max(dice) AS best_dice FROM (SELECT r, id, dice FROM m UNION ALL SELECT r, id, dice FROM v) GROUP BY r)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(n_windows, 0) AS n_windows, coalesce(licences, '') AS licences,
       coalesce(best_dice, 0.0)::DOUBLE AS best_dice, coalesce(windows, '') AS windows
FROM d LEFT JOIN g USING (r) LEFT JOIN f USING (r) LEFT JOIN x USING (r)
"""

"""License scans, native: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

A template of m shingles of 5 words belongs to the scale s of the least 2**s >= 1.25 * m. Texts are cut, for each scale,
into windows of 2 * 2**s shingles that start every 2**s, so an occurrence with up to a quarter of inserted words lies
whole in one window. Such a window and its template have a Jaccard similarity of at least 0.8 * 0.4 / 2.08 = 0.153; with
BANDS bands of one row each they collide in some band with a probability of at least 1 - (1 - 0.153) ** BANDS, 0.9996.
A match is then a window that holds at least 80 % of the template's distinct shingles.

A band can collide only where the window holds the template's own minimum of that band, so signatures are computed only
for windows that hold one of these shingles (pivots); a broadcast join finds them while the texts stream by, and the
candidates are the same as if every window had been signed. Templates are a short list, and their tables are broadcast
below a checked number of rows.

Defined cases: null and empty texts and those under 5 words match nothing; templates under 5 words take no part; rows
are documents, so repeated rows and null ids give rows of their own. No templates: no document matches. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.decontamination import words

SHINGLE = 5
CONTAINED = 0.8
BANDS = 48

#: Licence notices and texts (fixed values).
TEMPLATES = [
    ("MIT-notice", "Released under the MIT License."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def _key(array: str, position: Column) -> Column:
    return F.xxhash64(*(F.get(F.col(array), position + i) for i in range(SHINGLE)))


def _shingles(array: str) -> Column:
    """The distinct shingles of an array of words, as text."""
    last = F.size(F.col(array)) - SHINGLE
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(F.col(array), i + 1, SHINGLE), " ")))


def _keys(array: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(F.col(array)) - SHINGLE), lambda i: _key(array, i)))


def _least(keys: str, band: int) -> Column:
    return F.array_min(F.transform(F.col(keys), lambda x: F.xxhash64(x, F.lit(band))))


def _signature(keys: str) -> Column:
    """One (band, least hash) for each band."""
    return F.array(*(F.struct(F.lit(b).alias("band"), _least(keys, b).alias("least")) for b in range(BANDS)))


def prepared(templates: DataFrame) -> DataFrame:
    """(license, scale, shingles, keys) of the templates that take part; repeated rows count once."""
    t = templates.where("license is not null").select("license", words(F.col("text")).alias("w")).distinct()
    t = t.where(F.size("w") >= SHINGLE).withColumn("scale", F.ceil(F.log2((F.size("w") - SHINGLE + 1) * 1.25)).cast("int"))
    return t.select("license", "scale", _shingles("w").alias("shingles"), _keys("w").alias("keys"))


def windows(documents: DataFrame, pivots: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, scale, start, w): one row a document without scale, and one for each window that holds a pivot of its scale."""
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    last = F.greatest(F.size("w") - SHINGLE, F.lit(-1))
    at = docs.select("row", "doc_id", "w", F.explode_outer(F.sequence(F.lit(-1), last)).alias("pos"))
    at = at.select("row", "doc_id", "w", "pos", F.when(F.col("pos") >= 0, _key("w", F.col("pos"))).alias("key"))
    hit = at.join(pivots, "key", "left").where((F.col("pos") < 0) | F.col("scales").isNotNull())
    step = lambda s: F.call_function("shiftleft", F.lit(1), s)
    starts = F.flatten(F.transform("scales", lambda s: F.transform(F.array(F.lit(1), F.lit(0)), lambda back: F.struct(s.alias("scale"), ((F.floor(F.col("pos") / step(s)) - back) * step(s)).cast("int").alias("start")))))
    each = hit.select("row", "doc_id", "w", F.explode_outer(F.filter(starts, lambda x: x["start"] >= 0)).alias("at"))
    each = each.select("row", "doc_id", F.size("w").alias("n_words"), F.col("at.scale").alias("scale"), F.col("at.start").alias("start"), F.when(F.col("at").isNotNull(), F.slice("w", F.coalesce(F.col("at.start"), F.lit(0)) + 1, 2 * step(F.coalesce(F.col("at.scale"), F.lit(0))) + SHINGLE - 1)).alias("w"))
    return each.dropDuplicates(["row", "scale", "start"])


def matches(documents: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows (row, doc_id, n_words), one a document, and found (row, license, start, contained), one for each
    window and template that match; start is the window's first word."""
    known = common.written(prepared(templates), "templates")
    signed = known.select("license", "scale", F.explode(_signature("keys")).alias("s")).select("license", "scale", "s.*")
    pivot = known.select("scale", F.explode("keys").alias("key")).select("scale", "key", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64("key", F.lit(b)).alias("least")) for b in range(BANDS)))).alias("s"))
    pivot = pivot.select("scale", "key", "s.*").join(signed.select("scale", "band", "least").distinct(), ["scale", "band", "least"], "left_semi")
    pivot = pivot.groupBy("key").agg(F.sort_array(F.collect_set("scale")).alias("scales"))
    small = known.count() <= common.BROADCAST_ROWS // (BANDS * 100)  # each template has BANDS bands and pivots
    hint = F.broadcast if small else (lambda x: x)
    held = common.written(windows(documents, hint(pivot)), "windows")
    own = held.where("scale is not null").withColumn("keys", _keys("w"))
    bands = own.select("row", "scale", "start", F.explode(_signature("keys")).alias("s")).select("row", "scale", "start", "s.*")
    retrieved = bands.join(hint(signed), ["scale", "band", "least"]).select("row", "scale", "start", "license").distinct()
    both = own.select("row", "scale", "start", "w").join(retrieved, ["row", "scale", "start"]).join(hint(known.select("license", F.col("shingles").alias("t"))), "license")
    share = F.size(F.array_intersect(_shingles("w"), F.col("t"))) / F.size("t")
    found = both.select("row", "license", "start", share.alias("contained")).where(F.col("contained") >= CONTAINED)
    return held.where("scale is null").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words")), found


def licenses(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_licenses, licenses (sorted, comma-joined) and contained, the largest share of a template (0 without one)."""
    rows, found = matches(documents, templates)
    per = found.groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("l"), F.max("contained").alias("c"))
    out = rows.join(per, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("l", ","), F.lit("")).alias("licenses"), F.round(F.coalesce("c", F.lit(0.0)), 6).alias("contained"))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    low = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t AS (SELECT license, {low} AS w FROM (VALUES {values}) AS v(license, text)),
g AS (SELECT DISTINCT license, CAST(2 ** ceil(log2((len(w) - 4) * 1.25)) AS BIGINT) AS step, unnest(list_transform(generate_series(1, len(w) - 4), lambda p: w[p : p + 4])) AS gram FROM t),
n AS (SELECT license, count(*) AS n FROM g GROUP BY license),
d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS w FROM documents),
s AS (SELECT r, p - 1 AS p, w[p : p + 4] AS gram FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
h AS (SELECT r, license, gram, p // step AS j FROM s JOIN g USING (gram)),
c AS (SELECT r, license, j, count(DISTINCT gram) AS c FROM (SELECT * FROM h UNION ALL SELECT r, license, gram, j - 1 FROM h WHERE j > 0) GROUP BY ALL),
m AS (SELECT r, license, max(c / n) AS share FROM c JOIN n USING (license) WHERE c / n >= 0.8 GROUP BY ALL),
o AS (SELECT r, count(*) AS k, string_agg(license, ',' ORDER BY license) AS l, max(share) AS share FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(k, 0) AS n_licenses, coalesce(l, '') AS licenses, round(coalesce(share, 0.0), 6) AS contained
FROM d LEFT JOIN o USING (r)
"""


SQL = _sql()

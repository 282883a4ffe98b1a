"""Licence scan: lines, paragraphs and whole texts that are a licence notice, by Dice coefficient over word bigrams, in DataFrame functions only.

Text and template are normalised alike: lower case, and runs of anything but letters,
digits and dots between digits become one space. The Dice coefficient of two sets of
neighbouring word pairs is twice the shared ones over the sum of their sizes, so a unit
can only reach THRESHOLD with a template whose size lies between t / (2 - t) and
(2 - t) / t times its own; these bounds prune templates in the join. Of the templates
that reach the threshold the best one is reported.

Units are each line, each paragraph of several lines (blank lines separate them) and
the whole of a text of several paragraphs, so wrapped notices and licence files are
found too. Paragraphs and texts of more words than any template can match are no units.

The join is an inverted index: units meet templates on a shared bigram, so text
that shares none with any template never leaves its task. The templates are a
fixed list (MAX_TEMPLATES at most), so their bigrams are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8
MAX_TEMPLATES = 5000
# Usual notices and whole short licences, with the SPDX identifier each stands for.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "(?:[^\\p{L}\\p{N}.]|\\.(?![0-9])|(?<![0-9])\\.)+", " "))


def _bigrams(words: Column) -> Column:
    """Distinct neighbouring word pairs; null for fewer than two words."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs))


def _words(text: Column) -> Column:
    return F.split(normalised(text), " ")


def units(docs: DataFrame) -> DataFrame:
    """doc_id, unit (line, paragraph or text), place (from 0, of its kind), body."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    paragraphs = F.split("text", "\n[ \t\r]*\n")
    inner = F.transform(paragraphs, lambda p, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("place"), p.alias("body")))
    inner = F.filter(inner, lambda x: F.contains(F.trim(x.body, F.lit("\n\r\t ")), F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("place"), F.col("text").alias("body"))))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("place"), x.alias("body")))
    return rows.select("doc_id", F.explode(F.concat(lines, inner, F.coalesce(whole, F.array()))).alias("u")).select("doc_id", "u.unit", "u.place", "u.body")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, place, license, template (its place in the list), dice: the best template of each unit that reaches the threshold, the first of equals.

    Units of fewer than two words have no bigrams and match nothing; null texts have no units; equal rows give one result; rows
    that share a doc_id are compared by themselves.
    """
    if not 0 < threshold <= 1 or not 0 < len(templates) <= MAX_TEMPLATES:
        raise ValueError("the threshold lies in (0, 1], and the templates are a list of a fixed size")
    listed = docs.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, notice string")
    known = listed.select("template", "license", _bigrams(_words(F.col("notice"))).alias("g"))
    known = known.select("template", "license", F.coalesce(F.size("g"), F.lit(0)).alias("m"), F.explode_outer("g").alias("gram"))
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    longest = int(most * max(len(t.split()) * 2 for _, t in templates))
    split = units(docs).select("doc_id", "unit", "place", F.xxhash64("body").alias("h"), _words(F.col("body")).alias("w"))
    split = split.where((F.col("unit") == "line") | (F.size("w") <= longest))
    # explode_outer and a size that is never null: else the optimizer puts filters on g below, which make g again
    grams = split.select("doc_id", "unit", "place", "h", _bigrams(F.col("w")).alias("g")).withColumn("n", F.coalesce(F.size("g"), F.lit(0)))
    shared = grams.select("doc_id", "unit", "place", "h", "n", F.explode_outer("g").alias("gram")).join(F.broadcast(known), "gram")
    bounded = shared.where((F.col("n") >= F.col("m") * least - 1e-9) & (F.col("n") <= F.col("m") * most + 1e-9))
    counted = bounded.groupBy("doc_id", "unit", "place", "h", "template", "license", "n", "m").agg(F.size(F.collect_set("gram")).alias("both"))
    dice = F.round(2 * F.col("both") / (F.col("n") + F.col("m")), 9)
    found = counted.withColumn("dice", dice).where(F.col("dice") >= threshold - 1e-9)
    best = found.groupBy("doc_id", "unit", "place", "h").agg(F.min(F.struct((-F.col("dice")).alias("d"), "template", "license")).alias("b"))
    return best.select("doc_id", "unit", "place", "b.license", "b.template", (-F.col("b.d")).alias("dice"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    longest = int((2 - THRESHOLD) / THRESHOLD * max(len(t.split()) * 2 for _, t in TEMPLATES))
    # a dot between digits is set aside as one private character, since this dialect has no look-around
    dots = r"regexp_replace(regexp_replace(replace(lower({}), chr(57344), ' '), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g')"
    norm = r"string_split(trim(replace(regexp_replace(" + dots + r", '[^\p{{L}}\p{{N}}' || chr(57344) || ']+', ' ', 'g'), chr(57344), '.')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH t AS (SELECT template, license, {grams} AS g FROM (SELECT template, license, {norm.format("notice")} AS w FROM (VALUES {values}) v(template, license, notice)) WHERE len(w) >= 2),
    paragraphs AS (SELECT doc_id, text, regexp_split_to_array(text, '\n[ \t\r]*\n') AS p FROM documents WHERE text IS NOT NULL),
    each AS (SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents
      UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(p) AS body, generate_subscripts(p, 1) - 1 AS place FROM paragraphs) WHERE contains(trim(body, chr(10) || chr(13) || chr(9) || ' '), chr(10))
      UNION ALL SELECT doc_id, 'text', text, 0 FROM paragraphs WHERE len(p) > 1),
    l AS (SELECT doc_id, unit, place, body, {grams} AS g FROM (SELECT *, {norm.format("body")} AS w FROM each) WHERE len(w) >= 2 AND (unit = 'line' OR len(w) <= {longest})),
    near AS (SELECT doc_id, unit, place, body, license, template, round(2.0::DOUBLE * len(list_intersect(l.g, t.g)) / (len(l.g) + len(t.g)), 9) AS dice FROM l, t
      WHERE len(l.g) BETWEEN len(t.g) * {THRESHOLD / (2 - THRESHOLD)} - 1e-9 AND len(t.g) * {(2 - THRESHOLD) / THRESHOLD} + 1e-9),
    best AS (SELECT doc_id, unit, place, license, template, dice, row_number() OVER (PARTITION BY doc_id, unit, place, body ORDER BY dice DESC, template) AS r FROM near WHERE dice >= {THRESHOLD} - 1e-9)
    SELECT DISTINCT doc_id, unit, CAST(place AS INTEGER) AS place, license, template, dice FROM best WHERE r = 1
    """


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _oracle()}

"""License scans by canonical digests.

A text is canonical when case, punctuation, white space, copyright lines and equivalent
spellings are normalised away. Entire texts are looked up: the digest of a document as
a whole, and of each of its lines, is hash-joined to the digests of known licence texts
and notices, which go through the same expressions. Plain DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import table

# Spellings that count as the same word.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
# Known licence texts and notices, by licence.
KNOWN = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
     "obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
     'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
     "License for the specific language governing permissions and limitations under the License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     'copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
     "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
     "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
     "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
     "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
     "and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you "
     "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
     "required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may "
     "not be removed or altered from any source distribution."),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("WTFPL", "SPDX-License-Identifier: WTFPL"),
]

_COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright|\(c\)|©)"


def canonical_lines(text: F.Column) -> F.Column:
    """The canonical form of each line; '' for a copyright line and one without a word."""
    pairs = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))

    def canonical(line: F.Column) -> F.Column:
        low = F.lower(line)
        plain = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), " ")
        return F.when(F.regexp_like(low, F.lit(_COPYRIGHT)), "").otherwise(F.array_join(F.transform(plain, lambda w: F.coalesce(F.try_element_at(pairs, w), w)), " "))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical)


def digests(texts: DataFrame, *keep: str) -> DataFrame:
    """``line_no`` and ``digest`` of each non-empty line, and of the whole text as line -1."""
    lines = texts.select(*keep, canonical_lines(F.col("text")).alias("lines"))
    whole = F.array_join(F.filter("lines", lambda x: x != ""), " ")
    each = F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), F.when(x != "", F.md5(x)).alias("digest")))
    first = F.array(F.struct(F.lit(-1).alias("line_no"), F.when(whole != "", F.md5(whole)).alias("digest")))
    return lines.select(*keep, F.inline(F.concat(first, each))).where("digest is not null")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(digest, license_id)`` of known texts; a text given twice counts for its first licence by name."""
    rows = spark.createDataFrame(known, "license_id string, text string")
    return digests(rows, "license_id").where("line_no = -1").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(doc_id, line_no, license_id, digest)`` for each document (line -1) or line that is a known text.

    Null, empty and wordless texts match nothing. Equal rows are reported each; a null
    doc_id stays null. A document that is one notice is reported as a whole and as a line.
    """
    table_of = F.broadcast(known_digests(docs.sparkSession, known))  # as many rows as known texts
    found = digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").join(table_of, "digest")
    return found.select("doc_id", "line_no", "license_id", "digest")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB: the list of known texts and spellings is written out."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spell = "CASE x " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in SPELLINGS.items()) + " ELSE x END"
    known = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    canonical = (
        rf"CASE WHEN regexp_matches(lower(l), '{_COPYRIGHT}') THEN '' ELSE array_to_string(list_transform(string_split(trim(regexp_replace(lower(l), "
        rf"'[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: {spell}), ' ') END"
    )
    lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {canonical})"
    return f"""
WITH k0 AS (SELECT * FROM (VALUES {known}) AS t(license_id, text)),
k AS (
  SELECT md5(array_to_string(list_filter({lines}, lambda y: y <> ''), ' ')) AS digest, min(license_id) AS license_id FROM k0 GROUP BY 1
), d AS (
  SELECT doc_id, {lines} AS ls FROM documents
), u AS (
  SELECT doc_id, -1 AS line_no, array_to_string(list_filter(ls, lambda y: y <> ''), ' ') AS c FROM d
  UNION ALL
  SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS c FROM d
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license_id, digest FROM (SELECT doc_id, line_no, md5(c) AS digest FROM u WHERE c <> '') JOIN k USING (digest)
"""

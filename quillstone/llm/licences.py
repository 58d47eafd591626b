"""Licence scans by canonical digest lookup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, written

# Fixed values. Well-known short licence texts and notices, whole, by name. Longer ones stand below by their digests.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENCES = {
    "MIT": _MIT_GRANT,
    "MIT with title": "MIT License\n\nCopyright (c) <year> <copyright holders>\n\n" + _MIT_GRANT,
    "ISC": _ISC_GRANT,
    "ISC with title": "ISC License\n\nCopyright (c) <year> <copyright holders>\n\n" + _ISC_GRANT,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "0BSD": _ISC_GRANT.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
# Fixed values. How notices of one line name licences, and how they begin: each beginning goes with each name.
NOTICES = {
    "MIT": ["the MIT License", "MIT License", "the MIT license (MIT)", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "the LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "the LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "the AGPL v3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-clause BSD license", "the Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-clause BSD license", "the New BSD License", "BSD-3-Clause"],
    "ISC": ["the ISC License", "ISC License", "ISC"],
    "Zlib": ["the zlib License", "zlib License"],
    "Unlicense": ["the Unlicense", "The Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 license"],
    "CC-BY-4.0": ["CC BY 4.0", "the CC BY 4.0 license", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the CC BY-SA 4.0 license", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the CC BY-NC 4.0 license", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the CC BY-ND 4.0 license"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "the CC BY-NC-SA 4.0 license"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "the CC BY-NC-ND 4.0 license"],
}
BEGINNINGS = ["Licensed under", "Released under", "Distributed under", "Available under", "Published under", *(f"This {x} is {y} under" for x in ("work", "software", "project", "file", "program") for y in ("licensed", "released"))]
# Fixed values. Canonical digests of whole licence texts, in the form that Debian's common-licenses have.
DIGESTS = {
    "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0": "Apache-2.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b": "GFDL-1.2",
    "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d": "GFDL-1.3",
    "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6": "MPL-1.1",
    "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56": "MPL-2.0",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause-UC",
}


def notices() -> list[tuple[str, str]]:
    """("<name> line", whole line): every beginning with every spelling, and the SPDX tag."""
    out = []
    for name, spellings in NOTICES.items():
        lines = [f"{b} {s}." for b in BEGINNINGS for s in spellings] + [f"SPDX-License-Identifier: {name}{x}" for x in ("", "-only", "-or-later")]
        out += [(f"{name} line", x) for x in lines]
    return out


#: (name, text) of all texts that are known by more than their digest.
KNOWN = [*LICENCES.items(), *notices()]
# Fixed values. Spellings held to be equal, after case and punctuation are gone: the left becomes the right.
EQUIVALENT = [("licence", "license"), ("sub license", "sublicense"), ("sub licensing", "sublicensing"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"), ("organisation", "organization"), ("authorise", "authorize"), ("https", "http"), ("per cent", "percent"), ("copyright owner", "copyright holder")]
#: Lines that name a holder or a year, or reserve rights, and so differ between copies of one licence.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|:|<|\[|[0-9]{4}|by )|\(c\)[ \t]*|©|all rights reserved)[^\n]*$"
#: ASCII but for letters and digits, and the usual typographic marks.
MARKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f ©‐-―‘-‟•…]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests that are broadcast at once, about 100 bytes each; a larger table is looked up in as many parts as it needs.
MOST_KNOWN = 100_000
#: What a line must have to be looked up: every known notice of one line has it.
HINT = r"(?i)licen|(released|distributed|available|published) under"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, no punctuation, one space between words, one spelling."""
    x = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, " ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, MARKS, " "), F.lit(" "))
    for a, b in EQUIVALENT:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(x)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """_known (digest), license: one row for each known text, by default KNOWN and DIGESTS; of texts with one canonical
    form, the first name. `digests`: by digest, the name of a text that is known by that alone."""
    if texts is None:
        texts, digests = KNOWN, DIGESTS if digests is None else digests
    known = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts)], "place int, license string, text string").select("place", "license", digest(F.col("text")).alias("_known"))
    more = spark.createDataFrame([(len(texts) + i, n, x) for i, (x, n) in enumerate((digests or {}).items())], "place int, license string, _known string")
    return known.unionByName(more).groupBy("_known").agg(F.min_by("license", "place").alias("license"))


def licence_scan(docs: DataFrame, known: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest (of the whole canonical text), license (the known text it equals, or null), lines (how many of
    its lines are, each taken whole, a known text), line_licenses (their names, distinct, sorted, joined by ", ").

    `known` comes from known_digests(), or is any table of _known (distinct digests) and license. Only lines that HINT
    finds are looked up: each known single-line notice has it. Null text counts as empty: it matches nothing, its lines
    are 0 and "". Repeated rows and ids: a row each. Null doc_id stays null. Empty tables: no rows, or no licences.
    Other columns are ignored. No shuffle of documents: digests of known texts are broadcast, MOST_KNOWN at a time, and
    documents are joined to them by hash.
    """
    d = doc_rows(docs, text, doc_id).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.regexp_like(x, F.lit(HINT)))
    d = d.select("doc_id", digest(F.col("text")).alias("digest"), F.transform(lines, digest).alias("_lines"))
    known = known.select(F.col("_known").alias("_digest"), F.col("license").alias("_name"))
    parts = max(1, -(-known.count() // MOST_KNOWN))
    known = written(known, "known-licences") if parts > 1 else known
    for i in range(parts):
        part = known.filter(F.pmod(F.xxhash64("_digest"), F.lit(parts)) == i) if parts > 1 else known
        names = part.agg(F.map_from_entries(F.collect_list(F.struct("_digest", "_name"))).alias("_names"))
        d = d.join(F.broadcast(part), F.col("digest") == F.col("_digest"), "left")
        # One row; the product with it is a broadcast of a bounded map, not of documents.
        d = d.join(F.broadcast(names), how="left")
        found = F.filter(F.transform("_lines", lambda x: F.try_element_at("_names", x)), lambda x: x.isNotNull())
        # Most documents have no such line: nothing is looked up for them.
        found = F.when(F.size("_lines") > 0, found).otherwise(F.array().cast("array<string>"))
        name = F.col("_name")
        if i:
            name, found = F.coalesce("license", name), F.concat("_found", found)
        d = d.select("doc_id", "digest", "_lines", name.alias("license"), found.alias("_found"))
    return d.select("doc_id", "digest", "license", F.size("_found").alias("lines"), F.array_join(F.array_sort(F.array_distinct("_found")), ", ").alias("line_licenses"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    x = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {_quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    marks = MARKS.replace("\\u", "\\x{").replace("\\x{00a0", "\\x{00a0}").replace("\\x{00a9", "\\x{00a9}")
    for code in ("2010", "2015", "2018", "201f", "2022", "2026"):
        marks = marks.replace("\\x{" + code, "\\x{" + code + "}")
    x = f"' ' || regexp_replace({x}, '{marks}', ' ', 'g') || ' '"
    for a, b in EQUIVALENT:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim({x}, ' ')"


def oracle_sql() -> str:
    rows = ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(KNOWN))
    more = ", ".join(f"({len(KNOWN) + i}, {_quoted(n)}, {_quoted(x)})" for i, (x, n) in enumerate(DIGESTS.items()))
    return f"""
WITH listed(place, license, body) AS (VALUES {rows}),
digests(place, license, digest) AS (VALUES {more}),
known AS (SELECT digest AS known_digest, arg_min(license, place) AS license FROM (SELECT place, license, sha256({_sql_canonical("body")}) AS digest FROM listed UNION ALL SELECT place, license, digest FROM digests) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
whole AS (SELECT d.r, d.doc_id, sha256({_sql_canonical("text")}) AS digest FROM d),
split_lines AS (SELECT r, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_quoted(HINT)}))) AS line FROM d),
found AS (SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(license))), ', ') AS names FROM split_lines JOIN known ON known_digest = sha256({_sql_canonical("line")}) GROUP BY r)
SELECT w.doc_id, w.digest, k.license, coalesce(f.n, 0)::INTEGER AS lines, coalesce(f.names, '') AS line_licenses
FROM whole w LEFT JOIN known k ON k.known_digest = w.digest LEFT JOIN found f ON f.r = w.r"""

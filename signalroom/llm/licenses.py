"""License scans by canonical digest.

A text is brought to a canonical form (lower case, equivalent spellings, copyright lines and
punctuation gone, single spaces) and its SHA-256 is looked up among the digests of known licences.
Two units are looked up, each as an entire text: the document, by a hash join, and each of its lines,
which finds one-line notices. Everything is a Spark expression.

The table of known licences is counted. Up to ``MAX_BROADCAST`` rows it is broadcast, and lines look it up
where they stand; a larger table is joined by a shuffle, whole texts and exploded lines alike. Both ways
give the same rows.

Covered by KNOWN, as texts: MIT, ISC, 0BSD, Zlib, BSD-2-Clause, BSD-3-Clause and usual notices; by
DIGESTS, as whole files: Apache-2.0, GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0, MPL-2.0, CC0-1.0.

Cases: null and empty texts have the digest of the empty canonical text, which no licence has, so they
match nothing; long texts are hashed whole; repeated rows are looked up once each; an empty table
gives no rows; input columns named like the four that are added give way to them, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_BROADCAST = 10_000

# The wording of public licences and of their usual one-line notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
CLAUSE_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS"""
BSD_3 = BSD_2.replace("THIS SOFTWARE IS", CLAUSE_3, 1)
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "", 1)
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: (licence id, a whole text or notice that stands for it)
KNOWN = [
    ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("MIT", MIT),
    ("ISC", "ISC License\n\n" + ISC), ("ISC", ISC), ("0BSD", ZERO_BSD), ("Zlib", ZLIB),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2), ("BSD-2-Clause", BSD_2),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3), ("BSD-3-Clause", BSD_3), ("Apache-2.0", APACHE_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]
# SHA-256 of the canonical form of whole public licence files, and of the same without what follows the end of their terms.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "7673026933f81fb36faca44699be948a2153b9e719461e7d2cde299c64e0858a"),
    ("Apache-2.0", "a2b68e8e90b0895c2903b3700afc6f39880427e48c9b3512eb4bd8ff8913ff5a"),
    ("GPL-2.0", "2ce6548c36ed5515006dbb0a983cbb329eb73dd206ebafb74593e9a069f339f7"),
    ("GPL-2.0", "15e6f5a4cb4144843cc2cc461105e9a3dec03b517ffe86fcb3931204bf7f33b4"),
    ("GPL-3.0", "e5d450eee65b3b7088759b9fb7814766e5632dd585291dec480b67de137965dd"),
    ("GPL-3.0", "687e35485959cebb78afc97d0ef9a10ec32b345e3f8cd24afd5093c5b6d41741"),
    ("LGPL-2.1", "1baa049afce6711f85dd992372e2a92e1b0073935e3e25fd74b6c79e1fd022f9"),
    ("LGPL-2.1", "0480f8b7dd43ba30ed34659d7bce0c3c59107f0b89b5429b55b1a573c6eca437"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "a975c79c4e706e8418d3869e1b4193888eeabd618c0014a6e60b49d59de2ab2f"),
    ("MPL-2.0", "b839637772c7e90d3706cc729c774502420ea09441d63e6e083477f88a8ce95a"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
]
#: A line that is a copyright line without a year, by its capitals: applied to the text as it stands, twice, as neighbours share a line end.
UNDATED = ("(^|\\n)[^A-Za-z0-9\\n]*[Cc]opyright( by)?( [A-Z][^ \\n]*){1,4}[ \\t\\r]*(\\n|$)", "\\1")
#: The canonical form, as regular expressions that RE2 and Java read alike, applied in this order to
#: lower-cased text. After the fourth, each word stands between two spaces of its own.
RULES = [
    ("(^|\\n)[^a-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*([0-9]{4}|[\\[<{](year|yyyy|full|name|owner|author|copyright))[^\\n]*", "\\1"),
    ("(^|\\n)[^a-z0-9\\n]*copyright[ \\t]*(\\(c\\)|©)[^\\n]*", "\\1"),
    ("(^|\\n)[^a-z0-9\\n]*all rights reserved[^a-z0-9\\n]*(\\n|$)", "\\1"),
    ("[^\\p{L}\\p{N}]+", "  "),
    (" (licence|licenses|licences) ", " license "),
    (" (sub  license|sub  licence|sublicence) ", " sublicense "),
    (" acknowledgement ", " acknowledgment "),
    (" non  infringement ", " noninfringement "),
    (" copyright  owner ", " copyright  holder "),
    (" https ", " http "),
    (" +", " "),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for _ in range(2):
        out = F.regexp_replace(out, UNDATED[0], "$1")
    out = F.lower(out)
    for pattern, put in RULES:
        out = F.regexp_replace(out, pattern, put.replace("\\", "$"))
        out = F.concat(F.lit(" "), out, F.lit(" ")) if put == "  " else out
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    out = f"coalesce({text}, '')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{UNDATED[0]}', '{UNDATED[1]}', 'g')"
    out = f"lower({out})"
    for pattern, put in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
        out = f"concat(' ', {out}, ' ')" if put == "  " else out
    return f"trim({out})"


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """canonical_sha256 and license_id of the known texts and digests, one row for each digest."""
    rows = [F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("body"), F.lit(None).cast("string").alias("told")) for i, t in (KNOWN if known is None else known)]
    rows += [F.struct(F.lit(i).alias("license_id"), F.lit("").alias("body"), F.lit(d).alias("told")) for i, d in digests]
    found = spark.range(1).select(F.inline(F.array(*rows)))
    return found.groupBy(F.coalesce("told", digest(F.col("body"))).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))


ADDED = ("canonical_sha256", "license_id", "notice_lines", "notices")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds canonical_sha256, license_id (of the whole text, or null), notice_lines and notices (ids found in lines)."""
    rows = known.limit(MAX_BROADCAST + 1).collect()
    small = len(rows) <= MAX_BROADCAST
    docs = common.without(docs, *ADDED)
    names = [common.free(docs.columns, n) for n in ("_known", "_id", "_lines")]
    lookup = known.toDF(*names[:2])
    whole = docs.withColumn("canonical_sha256", digest(F.col("text")))
    whole = whole.join(F.broadcast(lookup) if small else lookup, F.col("canonical_sha256") == F.col(names[0]), "left")
    whole = whole.withColumn("license_id", F.col(names[1])).drop(*names[:2])
    if small:
        found = whole.withColumn(names[2], line_matches(F.col("text"), rows))
    else:
        found = joined_lines(whole, lookup, *names)
    ids = F.col(names[2])
    return found.withColumn("notice_lines", F.size(ids).cast("long")).withColumn("notices", F.array_join(F.array_sort(F.array_distinct(ids)), ",")).drop(names[2])


def line_matches(text: Column, rows: list) -> Column:
    """The licence ids of the lines that are themselves known texts, in order, with repeats."""
    table = F.map_from_arrays(F.split(F.lit(",".join(r[0] for r in rows)), ","), F.split(F.lit(",".join(r[1] for r in rows)), ","))
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    ids = F.transform(lines, lambda x: F.try_element_at(table, digest(x)))
    return F.filter(ids, lambda x: x.isNotNull())


def joined_lines(docs: DataFrame, lookup: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """The same by a hash join: each different text's lines are looked up, and texts get back what was found."""
    text_key = common.free([*docs.columns, key, value, to], "_text")
    lines = docs.select(F.sha2("text", 256).alias(text_key), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    hits = lines.withColumn("digest", digest(F.col("line"))).join(lookup, F.col("digest") == F.col(key)).groupBy(text_key, "n").agg(F.min(value).alias(value))
    found = hits.groupBy(text_key).agg(F.collect_list(value).alias(to)).withColumnRenamed(text_key, key)
    out = docs.withColumn(text_key, F.sha2("text", 256)).join(found, F.col(text_key) == F.col(key), "left").drop(text_key, key)
    return out.withColumn(to, F.coalesce(to, F.array().cast("array<string>")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, known_licenses(spark)).drop("text")


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    told = "".join(f" UNION ALL SELECT '{i}', '{d}'" for i, d in DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({canonical_sql("body")}) AS digest FROM (VALUES {quoted}) v(license_id, body){told}) GROUP BY 1),
whole AS (SELECT doc_id, text, sha256({canonical_sql("text")}) AS canonical_sha256, row_number() OVER () AS n FROM documents),
lines AS (SELECT n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM whole),
found AS (
  SELECT n, count(*) AS notice_lines, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
  FROM lines l JOIN known k ON k.digest = sha256({canonical_sql("l.line")}) GROUP BY n)
SELECT w.doc_id, w.canonical_sha256, k.license_id, coalesce(f.notice_lines, 0) AS notice_lines, coalesce(f.notices, '') AS notices
FROM whole w LEFT JOIN known k ON k.digest = w.canonical_sha256 LEFT JOIN found f ON f.n = w.n"""


SQL = _sql()

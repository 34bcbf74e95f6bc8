"""Operator 8: license scan by canonical digest.

A text is brought to a canonical form: lower case, copyright lines taken out,
equivalent spellings made one, runs of anything but letters and digits made one
space.  Its digest meets the digests of known licenses in an equi-join: the
whole text of a document, and also each of its lines and each of its blocks (the
lines between blank ones, or between ones of comment marks only), so that a
license or a notice inside a longer document is found too.

What is known is a parameter of any size: a table (license, text), and a table
(license, n_chars, digest) of canonical forms for texts too long to stand here,
such as the full standard licenses.  Known digests are broadcast where they are
at most ``BROADCAST`` rows; units of a length that no known form has are then
left out before they are hashed.  With more of them the digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import fresh, saved

#: Equivalent spellings, applied in this order to lower-cased text.
SPELLINGS = (("licence", "license"), ("sub-licens", "sublicens"), ("https://", "http://"), ("organisation", "organization"), ("whilst", "while"), ("wilful", "willful"), ("merchantibility", "merchantability"))
#: A line that begins with a copyright statement, and "all rights reserved" with it.
COPYRIGHT = r"(?m)^[ \t#/*;-]*(?:portions )?(?:copyright|\(c\)|©)[^\n]*$"
RIGHTS = r"(?m)^[ \t#/*;-]*all rights reserved\.?[ \t]*$"

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."

#: Known licenses and notices: (license, text).
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", f"MIT License\n{_MIT}\n{_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}\n{_WARRANTY}"),
    ("MIT", f"{_MIT}\n{_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", f"ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC}"),
    ("BSD-2-Clause", f"{_BSD_TWO}\n{_BSD}"),
    ("BSD-3-Clause", f"{_BSD_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


#: Full standard texts by their canonical form: (license, characters, MD5).
STANDARD: tuple[tuple[str, int, str], ...] = (
    ("Apache-2.0", 9701, "bb90ddb921a4bcfa8bbc590c5f5577e2"),
    ("Artistic-1.0-Perl", 5683, "882c9d9e5b46fdd406c17541866e89a0"),
    ("BSD-3-Clause", 1361, "ddcd765ed0a3236bf96e15f76c36983a"),
    ("CC0-1.0", 6692, "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", 19514, "fd920ddc37a3d7e8c50763b83c95353c"),
    ("GFDL-1.3", 21882, "69253b6f159e4a07012cc5d95badaa85"),
    ("GPL-1.0", 11765, "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-2.0", 17053, "e374d0b43c25aed1a2b28951fe92a546"),
    ("GPL-3.0", 33274, "4e2a5fb39fd6441859c05e128799e2e1"),
    ("LGPL-2.0", 23937, "63ac11b5b2fcfe811ff161b9e5def0c5"),
    ("LGPL-2.1", 25024, "b0e44c745072418c0ff11407a0bc4ffc"),
    ("LGPL-3.0", 7104, "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", 22339, "a708f02208e9c42d3644490185833425"),
    ("MPL-2.0", 14271, "35fb4d2625087f7fd780039aa7b4ebb2"),
)
#: Known digests that are sent to all tasks at most: some 60 bytes each.
BROADCAST = 100_000


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line of a text: words of a-z and 0-9, and letters beyond ASCII, one space between."""
    low = F.lower(text)
    rights = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights reserved")
    low = F.when(rights, F.regexp_replace(F.regexp_replace(low, COPYRIGHT, ""), RIGHTS, "")).otherwise(low)
    for spelling, standard in SPELLINGS:
        low = F.replace(low, F.lit(spelling), F.lit(standard))
    return F.transform(F.split(F.regexp_replace(low, r"[\x00-\x09\x0b-/:-`{-\x7f]+", " "), "\n"), lambda x: F.btrim(x))


def joined(lines: Column) -> Column:
    """The canonical form of a text from those of its lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def blocks(lines: Column) -> Column:
    """The canonical forms of a text's blocks: lines between empty ones."""
    marked = F.array_join(F.transform(lines, lambda x: F.when(x == "", "\n").otherwise(x)), " ")
    return F.transform(F.split(marked, "\n"), lambda x: F.btrim(x))


def known_digests(spark: SparkSession, known=KNOWN, standard=STANDARD) -> DataFrame:
    """(digest, n_chars, license) of the known texts and forms, one row for each digest; of several names the first."""
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license string, text string")
    ready = standard if isinstance(standard, DataFrame) else spark.createDataFrame(standard, "license string, n_chars int, digest string")
    forms = table.select("license", joined(canonical_lines(F.col("text"))).alias("form")).where("form <> ''")
    forms = forms.select("license", F.length("form").alias("n_chars"), F.md5(F.col("form").cast("binary")).alias("digest"))
    return forms.unionByName(ready.select("license", "n_chars", "digest")).groupBy("digest").agg(F.min("license").alias("license"), F.min("n_chars").alias("n_chars"))


def scan(df: DataFrame, known=KNOWN, doc_id: str = "doc_id", text: str = "text", standard=STANDARD) -> DataFrame:
    """df with ``license``, of the whole text, and ``notices``, of single lines and blocks: names in order, joined by a comma.

    Where nothing is known, license is null and notices is empty.  Null and
    empty texts, and those of which nothing is left, match nothing.  Rows with
    the same doc_id share what any of them matches; the license is then the
    first by name.  Columns of df named as a result are replaced.
    """
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in ("license", "notices")])
    digests = saved(known_digests(df.sparkSession, known, standard), "known-licenses")
    few = digests.limit(BROADCAST + 1).count() <= BROADCAST
    lengths = [r[0] for r in digests.select("n_chars").distinct().collect()] if few else None
    # Names inside lambdas must not meet an alias of the same select.
    rows = kept.select(F.col(f"`{doc_id}`").alias("doc_id"), canonical_lines(F.col(f"`{text}`")).alias("ls"))
    usable = lambda x: x != "" if lengths is None else F.length(x).isin(*lengths)
    unit = lambda whole: lambda x: F.struct(F.lit(whole).alias("whole"), x.alias("form"))
    some = lambda xs, whole: F.transform(F.filter(xs, usable), unit(whole))
    units = rows.select("doc_id", F.inline(F.concat(some(F.array(joined(F.col("ls"))), True), some(F.concat(F.col("ls"), blocks(F.col("ls"))), False))))
    units = units.where("form <> ''").select("doc_id", "whole", F.md5(F.col("form").cast("binary")).alias("digest"))
    hits = units.join(F.broadcast(digests.select("digest", "license")) if few else digests.select("digest", "license"), "digest")
    key, names = fresh(kept.columns, "license_id"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",")
    found = hits.groupBy("doc_id").agg(F.min(F.when(F.col("whole"), F.col("license"))).alias("license"), names.alias("notices")).withColumnRenamed("doc_id", key)
    out = kept.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col(key)), "left")
    return out.select(*[f"`{c}`" for c in kept.columns], "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql(expression: str) -> str:
    """The canonical forms of a text's lines in DuckDB's SQL."""
    low = f"lower({expression})"
    for pattern in (COPYRIGHT, RIGHTS):
        low = f"regexp_replace({low}, '{pattern}', '', 'g')"
    for spelling, standard in SPELLINGS:
        low = f"replace({low}, '{spelling}', '{standard}')"
    return f"list_transform(string_split(regexp_replace({low}, '[\\x00-\\x09\\x0b-/:-`{{-\\x7f]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' '))"


def oracle(known=KNOWN, standard=STANDARD) -> str:
    values = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in known)
    ready = ", ".join(f"('{digest}', '{name}')" for name, _, digest in standard)
    whole = "array_to_string(list_filter(ls, lambda x: x <> ''), ' ')"
    return f"""
WITH known(license, text) AS (VALUES {values}),
known_lines AS (SELECT license, {_sql("text")} AS ls FROM known),
digests AS (SELECT digest, min(license) AS license FROM (SELECT md5({whole}) AS digest, license FROM known_lines UNION ALL SELECT * FROM (VALUES {ready}) t(digest, license)) GROUP BY 1),
lines AS (SELECT doc_id, {_sql("text")} AS ls FROM documents),
units AS (
  SELECT doc_id, true AS whole, {whole} AS form FROM lines
  UNION ALL SELECT doc_id, false, unnest(ls) FROM lines
  UNION ALL SELECT doc_id, false, trim(unnest(string_split(array_to_string(list_transform(ls, lambda x: CASE WHEN x = '' THEN chr(10) ELSE x END), ' '), chr(10))), ' ') FROM lines
),
hits AS (SELECT doc_id, whole, license FROM units JOIN digests ON md5(form) = digest WHERE form <> ''),
found AS (
  SELECT doc_id, min(license) FILTER (WHERE whole) AS license, coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE NOT whole), '') AS notices
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, f.license, coalesce(f.notices, '') AS notices FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""

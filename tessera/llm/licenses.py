"""Licence scans by canonical digests.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space) and its SHA-256
digest is hash-joined with the digests of known licence texts, which go through the same steps. The whole text has to be the
licence; where its digest is not known, it is looked up again without any line that begins with a copyright or reserves all rights. Its lines that speak of a licence are looked up in the same way, which finds notices inside other texts.

Everything is DataFrame expressions over one scan, in which a text is put in lower case once, and steps that only some texts need are taken for those with their words. The digests of the texts known here
are a broadcast row of some dozens of entries, so no document is exchanged; further texts are hash-joined.

Defined cases: a null text counts as an empty one; a text that is empty after normalisation has the empty text's digest and no
licence; repeated rows get a row each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, table

# Spellings that count as equal, replaced in this order.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("https:", "http:"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("analyse", "analyze"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("version 3.0", "version 3"),
    ("v3.0", "v3"),
)

# Public licence texts and notices.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
"""
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC + _ISC_TAIL),
    ("ISC", "ISC License\n" + _ISC + _ISC_TAIL),
    ("0BSD", _0BSD + _ISC_TAIL),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)
#: A letter in parentheses also numbers a clause; it is a copyright sign only before a year or the word.
_COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(?:copyright \(c\)|copyright [0-9]|copyright ©|\(c\) (?:[12][0-9][0-9][0-9]|copyright)|© )[^\n]*"
#: Lines, in lower case, that are dropped for the second look: such lines, those that begin with the word and any name, and those that only reserve all rights. A line
#: may begin with the word within a sentence, by its width: not before these words.
_NAMED = r"^[^\p{L}\p{N}]*copyright([^\p{L}\p{N}]|$)"
_WITHIN = r"^[^\p{L}\p{N}]*copyright (holder|owner|notice|law|license|licence|interest|disclaimer|statement|term|treat|protect|permission|right|act|claim|infring|and|or|on|in|of|to|is|are|as|that|this|the software|for|which|with|from|applies|has|have|may|can|shall)(s|es|ies|ion|ement)?([^\p{L}\p{N}]|$)"
_RESERVED = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
_LINE = _COPYRIGHT.replace(r"(^|\n)", "^", 1).removesuffix(r"[^\n]*")
TEXTS = Path(__file__).parent / "data" / "licenses"
_SPEAKS = "licen[cs]"


def texts() -> list[tuple[str, str]]:
    """Id and text of the licences shipped whole: also without what follows the terms, and without the postal address below the copyright."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        whole = path.read_text(encoding="utf-8")
        ends = [m.start() for m in re.finditer(r"(?m)^\W*(?:END OF TERMS AND CONDITIONS|APPENDIX: How to|Appendix: How to|How to Apply These|ADDENDUM: How to)", whole)]
        for form in (whole, *(whole[:end] for end in ends)):
            out += [(path.stem, form), (path.stem, re.sub(r"(?m)^\W*\d+ Franklin St.*\n", "", form, count=1))]
    return list(dict.fromkeys(out))


def _spelled(out: Column) -> Column:
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def _canonical(low: Column) -> Column:
    """The normal form of a text in lower case."""
    return _spelled(F.when(low.rlike(r"copyright|\(c\)|©"), F.regexp_replace(low, _COPYRIGHT, "$1")).otherwise(low))


def digest(text: Column) -> Column:
    """The digest of a text's normal form."""
    return F.sha2(_canonical(F.lower(F.coalesce(text, F.lit("")))), 256)


def _bare(low: Column, words: str = "") -> Column:
    """The digest of the normal form without any copyright line; null for a text that has none, or nothing else, or none of the words of which each known text has one (if these are given)."""
    dropped = lambda x: x.rlike(_LINE) | x.rlike(_NAMED) & ~x.rlike(_WITHIN) | x.rlike(_RESERVED)
    body = let(_spelled(F.array_join(F.filter(F.split(low, "\n", -1), lambda x: ~dropped(x)), "\n")), lambda b: F.when(b != "", F.sha2(b, 256)))
    return F.when(low.rlike(words) & low.rlike(r"copyright|all rights reserved|\(c\)|©"), body)


#: Each known text has one of these.
_WORDS = "warrant|licen[cs]"


def _normal(text: str, bare: bool = False) -> str:
    """The same normal forms of a known text."""
    low = text.lower()
    if bare:
        low = "\n".join(x for x in low.split("\n") if not (regex.search(_LINE, x) or regex.search(_NAMED, x) and not regex.search(_WITHIN, x) or regex.search(_RESERVED, x)))
    else:
        low = regex.sub(_COPYRIGHT, r"\1", low)
    for other, usual in SPELLINGS:
        low = low.replace(other, usual)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", low).strip(" ")


@cache
def known() -> dict[str, str]:
    """Licence by digest of KNOWN and of the texts shipped; of equal digests the first counts. Both the query and its SQL take their known texts from here."""
    out: dict[str, str] = {}
    for name, text in (*KNOWN, *texts()):
        if not regex.search(_WORDS, text.lower()):
            raise ValueError(f"{name}: a known text without any of the words {_WORDS}")
        for form in (_normal(text), _normal(text, bare=True)):
            if form:
                out.setdefault(hashlib.sha256(form.encode()).hexdigest(), name)
    return out


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license and notices (ids of licences that lines of the text name, sorted, by commas).

    more (license, text): further whole texts to be known, however many; of those with equal digests the first by name counts.
    """
    spark = docs.sparkSession
    entries = spark.createDataFrame(list(known().items()), "known_digest string, license string")
    lookup = entries.agg(F.map_from_entries(F.collect_list(F.struct("known_digest", "license"))).alias("known"))  # a row of some dozens of entries
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    at = lambda d: F.try_element_at("known", d)

    def found(low: Column) -> Column:
        lines = F.when(low.rlike(_SPEAKS), F.filter(F.split(low, "\n", -1), lambda x: x.rlike(_SPEAKS))).otherwise(F.array().cast("array<string>"))
        ids = F.sort_array(F.array_distinct(F.filter(F.transform(lines, lambda x: at(F.sha2(_canonical(x), 256))), lambda x: x.isNotNull())))
        return F.struct(F.sha2(_canonical(low), 256).alias("digest"), _bare(low, _WORDS if more is None else "").alias("bare"), F.array_join(ids, ",").alias("notices"))

    rows = docs.select("doc_id", "text").join(F.broadcast(lookup)).select("doc_id", let(low, found).alias("f"), "known")
    rows = rows.select("doc_id", "f.digest", "f.bare", "f.notices", F.coalesce(at(F.col("f.digest")), at(F.col("f.bare"))).alias("license"))
    if more is not None:
        forms = F.explode(F.array(digest(F.col("text")), _bare(F.lower("text"))))
        others = more.where("license is not null and text is not null").select("license", forms.alias("d")).where((F.col("d") != hashlib.sha256(b"").hexdigest())).groupBy("d").agg(F.min("license").alias("other"))
        for by in ("digest", "bare"):
            rows = rows.join(others.withColumnsRenamed({"d": by, "other": f"by_{by}"}), by, "left")
        rows = rows.withColumn("license", F.coalesce("license", "by_digest", "by_bare"))
    return rows.select("doc_id", "digest", "license", "notices")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def spelled(out: str) -> str:
        for other, usual in SPELLINGS:
            out = f"replace({out}, '{other}', '{usual}')"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    normal = lambda x: f"sha256({spelled(f"regexp_replace({x}, '{_COPYRIGHT}', '\\1', 'g')")})"
    dropped = f"(regexp_matches(x, '{_LINE}') OR regexp_matches(x, '{_NAMED}') AND NOT regexp_matches(x, '{_WITHIN}') OR regexp_matches(x, '{_RESERVED}'))"
    bare = spelled(f"array_to_string(list_filter(string_split(low, chr(10)), lambda x: NOT {dropped}), chr(10))")
    rows = ",\n".join(f"('{d}', '{n}')" for d, n in known().items())
    return f"""
WITH known(known_digest, license) AS (VALUES {rows}),
docs AS (SELECT doc_id, row_number() OVER () AS r, lower(coalesce(text, '')) AS low FROM documents),
lines AS (SELECT r, unnest(string_split(low, chr(10))) AS line FROM docs),
found AS (
  SELECT r, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices
  FROM (SELECT r, {normal('line')} AS d FROM lines WHERE regexp_matches(line, '{_SPEAKS}')) l JOIN known k ON l.d = k.known_digest GROUP BY r),
forms AS (
  SELECT doc_id, r, {normal('low')} AS digest,
         CASE WHEN regexp_matches(low, 'copyright|all rights reserved|\\(c\\)|©') THEN nullif({bare}, '') END AS bare FROM docs)
SELECT d.doc_id, d.digest, coalesce(k.license, b.license) AS license, coalesce(f.notices, '') AS notices
FROM forms d LEFT JOIN known k ON d.digest = k.known_digest LEFT JOIN known b ON sha256(d.bare) = b.known_digest LEFT JOIN found f ON f.r = d.r
"""


SQL = _sql()

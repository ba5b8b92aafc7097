"""Licence scan by canonical digests.

A text is brought to a canonical form: small letters, no copyright lines, no punctuation, one
spelling of words that licences write in several ways. The digest of the whole canonical text
is joined with the digests of known licences, and the digests of its single lines with those of
known licence notices, so a licence is found by equality and never by likeness.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters outside ASCII that count as punctuation.
MARKS = "‘’“”«»–—…•·\u00a0\u202f"
#: As the SQL has it: whatever begins with the mark, also a body line.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*"
#: Words that follow in the body of a licence and not in a notice, unless a year or sign does too.
_BODY = "(?:holder|owner|notice|law|licen[sc]e|statement|interest|protection|permission|treat(?:y|ie))s?|and|or|in|to"
#: A notice: its mark, then a year, a sign or a name. A wrapped body line may begin with the same word.
NOTICE_LINE = (
    r"(^|\n)[^a-z0-9\n]*(?:copyright(?![a-z])"
    rf"(?:(?=[^\n]*(?:\b(?:19|20)[0-9]{{2}}\b|©|\(c\)))|(?![^a-z0-9\n]*(?:{_BODY})\b))|\(c\)|©)[^\n]*"
)
RIGHTS_LINE = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: Spellings that matching guidelines for licences hold equal, after punctuation.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial",
    "non infringement": "noninfringement", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "copyright owner": "copyright holder",
}

_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Whole licence texts, without their copyright lines.
LICENSES = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software.\n" + _DISCLAIMER),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software.\n" + _DISCLAIMER),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
     "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
     "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     'granted.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
     "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
     "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
     "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
     "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software "
     "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
     "following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote "
     "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
     "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
     "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source "
     "distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
]

#: Single lines that state a licence.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    low = F.translate(text, UPPER, LOWER)
    low = F.when(low.rlike("copyright|©|\\(c\\)"), F.regexp_replace(low, NOTICE_LINE, "$1")).otherwise(low)
    low = F.when(F.contains(low, F.lit("all rights reserved")), F.regexp_replace(low, RIGHTS_LINE, "$1$2")).otherwise(low)
    plain = F.trim(F.regexp_replace(F.translate(low, MARKS, " " * len(MARKS)), NOT_WORD, " "))
    spelled = plain
    for odd, usual in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, rf"\b{odd}\b", usual)
    return F.when(plain.rlike(rf"\b({'|'.join(SPELLINGS)})\b"), spelled).otherwise(plain)


def canonical_sql(text: str) -> str:
    """The same as DuckDB SQL, for checks."""
    def again(inner: str, pattern: str, to: str) -> str:
        return f"regexp_replace({inner}, '{pattern}', '{to}', 'g')"

    low = again(again(f"translate({text}, '{UPPER}', '{LOWER}')", COPYRIGHT_LINE, r"\1"), RIGHTS_LINE, r"\1\2")
    out = f"trim({again(f"translate({low}, '{MARKS}', '{' ' * len(MARKS)}')", NOT_WORD, ' ')})"
    for odd, usual in SPELLINGS.items():
        out = again(out, rf"\b{odd}\b", usual)
    return out


def known(spark: SparkSession, texts: list[tuple[str, str]], name: str) -> DataFrame:
    """``digest`` and licence of known texts; of equal texts the first id counts."""
    rows = spark.createDataFrame(texts, f"{name} string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min(name).alias(name))


def license_scan(docs: DataFrame, licenses: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, digest, license, notices`` per row of ``docs``.

    ``digest`` is the SHA-256 of the whole canonical text, ``license`` the known licence with
    that digest, if any, and ``notices`` the distinct ids, sorted, of known notices that make up
    a line of the text. A null text has neither digest nor notices; rows are judged one by one.
    """
    spark = docs.sparkSession
    whole = F.broadcast(known(spark, licenses or LICENSES, "license"))
    lines = known(spark, notices or NOTICES, "notice")
    # the notices are few by definition: a literal map is their hash table, and needs no shuffle
    table = {r["digest"]: r["notice"] for r in lines.collect()}
    by_digest = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    # lines that lack a word which all notices have are not worth a digest
    word = "(?i)licen[sc]e" if all(re.search("(?i)licen[sc]e", t) for _, t in notices or NOTICES) else ""
    stating = F.filter(F.split("text", "\n"), lambda line: line.rlike(word))
    named = F.transform(stating, lambda line: F.try_element_at(by_digest, F.sha2(canonical(line), 256)))
    found = F.when(F.col("text").rlike(word), F.array_sort(F.array_distinct(F.filter(named, lambda n: n.isNotNull()))))
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.coalesce(found, F.array().cast("array<string>")).alias("notices"))
    return rows.join(whole, "digest", "left").select("doc_id", "digest", "license", "notices")

"""License scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form: lower case, equivalent spellings made one, copyright lines and
punctuation taken out, white space made single. Its SHA-256 digest is joined by hash to those of known
licence texts and notices, canonicalised by the same expression. The units that are looked up are the
whole text, its lines, its blocks between blank lines, and runs of as many blocks as a known text has; each is looked up
entire. Blocks of which the canonical form leaves nothing, such as a copyright line by itself, do not part a run.

Only texts that have one of the known texts' anchors can match, so the others are passed over after a plain search:
ANCHORS, and for known texts without one of these their longest word. Null texts match nothing. A unit that occurs
again in a text is a row of its own, by its place; a unit that is block and line at once, or the whole text, is
reported for each. Of KNOWN, Apache-2.0, MPL-2.0 and the GPL family are there by their notices, the others in full.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same in licence texts.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "colour": "color",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "modelled": "modeled",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "recognise": "recognize",
    "sub license": "sublicense",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "copyright owner": "copyright holder",
}
#: Words that nearly all known texts have.
ANCHORS = ("licen", "redistribut", "permission", "public domain")
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu(name: str, version: str, later: bool = True, thing: str = "program") -> str:
    """The notice of a licence of the GPL family."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {which}.

This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."""


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
#: Known licences and notices, as (identifier, text).
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", _gnu(_GPL, "2", False)),
    ("GPL-2.0-or-later", _gnu(_GPL, "2")),
    ("GPL-3.0-only", _gnu(_GPL, "3", False)),
    ("GPL-3.0-or-later", _gnu(_GPL, "3")),
    ("LGPL-2.1-or-later", _gnu(_LGPL, "2.1", thing="library")),
    ("LGPL-3.0-or-later", _gnu(_LGPL, "3", thing="library")),
    ("AGPL-3.0-only", _gnu(_AGPL, "3", False)),
    ("AGPL-3.0-or-later", _gnu(_AGPL, "3")),
    ("MPL-2.0", _MPL),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _BSD_THIRD + _BSD_AS_IS),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
)


#: A line that begins with a copyright sign, or with the word and then a sign, a year or nothing.
COPYRIGHT_LINE = r"^[ \t]*(?:copyright[ \t\r]*$|copyright[ \t]+(?:\(c\)|©|[0-9])|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), f"(?md){COPYRIGHT_LINE}", "")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for spelling, same in EQUIVALENT.items():
        out = F.regexp_replace(out, rf"\b{spelling}\b" if spelling != "copyright owner" else r"\bcopyright owner", same)
    return out


#: Lines without any text part blocks.
BLANK = r"\n[ \t\r]*\n"


def _blocks(text: Column) -> Column:
    """place and canonical form of the blocks of which something is left."""
    each = F.transform(F.split(text, BLANK), lambda p, i: F.struct(i.alias("place"), canonical(p).alias("c")))
    return F.filter(each, lambda x: x.c != "")


def known(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """digest, license and n_blocks of the known texts, one row per digest."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in texts])
    each = spark.range(1).select(F.explode(rows).alias("_r")).select("_r.license", F.col("_r.text").alias("text"))
    each = each.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.size(_blocks(F.col("text"))).alias("n_blocks"))
    return each.groupBy("digest").agg(F.min("license").alias("license"), F.max("n_blocks").alias("n_blocks"))


def anchors(texts=KNOWN) -> list[str] | None:
    """Words of which every known text has one, in lower case; none if a text has no word to search for."""
    out = list(ANCHORS)
    spelled = {w for pair in EQUIVALENT.items() for x in pair for w in x.split()}
    for _, text in texts:
        low = text.lower()
        if not any(x in low for x in out):
            words = [w for w in re.findall("[a-z0-9]+", low) if w not in spelled]
            if not words:
                return None
            out.append(max(words, key=len))
    return out


def scan(docs: DataFrame, texts=KNOWN) -> DataFrame:
    """doc_id, scope (text, blocks, block or line), place (of the first line or block, from 0), license, digest, for every unit that is a known text."""
    spark = docs.sparkSession
    low, searched = F.lower("text"), anchors(texts)
    rows = docs.select("doc_id", "text").filter("text is not null")
    if searched is not None:
        rows = rows.filter(reduce(lambda a, b: a | b, [low.contains(x) for x in searched]))
    digests = known(spark, texts)
    runs = sorted(r.n_blocks for r in digests.select("n_blocks").filter("n_blocks > 1").distinct().collect())  # as many as known texts at most
    part = lambda scope, parts: F.transform(parts, lambda p, i: F.struct(F.lit(scope).alias("scope"), i.alias("place"), canonical(p).alias("c")))

    def of_length(b: Column, k: int) -> Column:
        run = lambda i: F.struct(F.lit("blocks").alias("scope"), F.get(b, i - 1).place.alias("place"), F.array_join(F.transform(F.slice(b, i, k), lambda x: x.c), " ").alias("c"))
        return F.when(F.size(b) >= k, F.transform(F.sequence(F.lit(1), F.size(b) - k + 1), run)).otherwise(F.array().cast("array<struct<scope:string,place:int,c:string>>"))

    def of_blocks(b: Column) -> Column:
        return F.concat(F.transform(b, lambda x: F.struct(F.lit("block").alias("scope"), x.place.alias("place"), x.c.alias("c"))), *[of_length(b, k) for k in runs])

    blocks = F.get(F.transform(F.array(_blocks(F.col("text"))), of_blocks), 0)
    units = F.concat(part("text", F.array("text")), blocks, part("line", F.split("text", "\n")))
    units = rows.select("doc_id", F.explode(units).alias("_u")).select("doc_id", "_u.scope", "_u.place", F.sha2("_u.c", 256).alias("digest"))
    # as many rows as known texts: a constant
    found = units.join(F.broadcast(digests.select("digest", "license")), "digest")
    return found.select("doc_id", "scope", F.col("place").cast("long").alias("place"), "license", "digest")


def op9_licenses(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', '', 'g')"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for spelling, same in EQUIVALENT.items():
        out = f"regexp_replace({out}, '\\b{spelling}{'' if spelling == 'copyright owner' else chr(92) + 'b'}', '{same}', 'g')"
    return out


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    blocks = "regexp_split_to_array({}, '\\n[ \\t\\r]*\\n')"
    return f"""
WITH known AS (
    SELECT sha256({_canonical_sql("t")}) AS digest, min(l) AS license FROM (VALUES {quoted}) AS v(l, t) GROUP BY 1
), lengths AS (
    SELECT DISTINCT len([x FOR x IN {blocks.format("t")} IF {_canonical_sql("x")} <> '']) AS k FROM (VALUES {quoted}) AS v(l, t)
), rows AS (
    SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL
), blocks AS (
    SELECT r, doc_id, p - 1 AS place, {_canonical_sql("parts[p]")} AS c
    FROM (SELECT r, doc_id, {blocks.format("text")} AS parts FROM rows), unnest(range(1, len(parts) + 1)) AS t(p)
), lists AS (
    SELECT r, doc_id, list(c ORDER BY place) AS cs, list(place ORDER BY place) AS places FROM blocks WHERE c <> '' GROUP BY r, doc_id
), units AS (
    SELECT doc_id, 'text' AS scope, 0 AS place, {_canonical_sql("text")} AS c FROM rows
    UNION ALL SELECT doc_id, 'block', place, c FROM blocks WHERE c <> ''
    UNION ALL SELECT doc_id, 'blocks', places[i], array_to_string(cs[i : i + k - 1], ' ') FROM lists, lengths, unnest(range(1, len(cs) - k + 2)) AS t(i) WHERE k > 1 AND len(cs) >= k
    UNION ALL SELECT doc_id, 'line', p - 1, {_canonical_sql("parts[p]")} FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM rows), unnest(range(1, len(parts) + 1)) AS t(p)
), digests AS (
    SELECT doc_id, scope, place, sha256(c) AS digest FROM units
)
SELECT doc_id, scope, place::BIGINT AS place, license, digest FROM digests JOIN known USING (digest)
"""


SQL = _sql()

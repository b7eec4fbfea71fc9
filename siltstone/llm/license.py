"""License scans by canonical digests; DataFrame functions only.

A text's canonical form is lower-case, without copyright lines, with every run of signs and spaces one space, equivalent
spellings made one, and holders' names in the usual clauses left out.  So it doesn't depend on how a text is wrapped.  Entire texts are
joined by the sha256 of this form with the digests of known licences.  Paragraphs and lines of a text are joined in the same way, each
entire: with known notices, and with the paragraphs of known licences, of which a text must hold all (BSD-3-Clause holds BSD-2-Clause).  Only units with a
word that every known unit has one of are digested; nothing that could match is left out.  The known side is a fixed list, so
it is broadcast; hits are counted per row of the stored digests.

Defined results: a null text counts as empty; empty units match nothing; repeated rows each get their row; ids may be null; a digest
known under several names goes by the first in order; very long texts are digested whole; an empty table gives an empty result;
columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.license_digests import DIGESTS
from siltstone.llm.textops import documents, let, stored

# Licence texts, their usual titles, notices and headers.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ISC_TERMS = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
MIT_0 = MIT.split("\n")[0].replace(", subject to the following conditions:", ".") + "\n" + MIT.split("\n")[2]
ZERO_BSD = ISC_TERMS + ".\n" + ISC.split("\n")[1]
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_ADVERTISING = """
3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.

4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE_END = "\n\nFor more information, please refer to <https://unlicense.org>"
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_HEADER = "This program is free software{c} you can redistribute it and/or modify it under the terms of the GNU {k} as published by the Free Software Foundation{e} version {v} of the License, or (at your option) any later version."
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: Entire texts: name, usual titles, text.
TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), MIT),
    ("MIT-0", ("MIT No Attribution",), MIT_0),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), ISC),
    ("0BSD", ("Zero-Clause BSD", "BSD Zero Clause License"), ZERO_BSD),
    ("BSD-2-Clause", ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), BSD_TERMS + BSD_DISCLAIMER),
    ("BSD-3-Clause", ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD License", "New BSD License"), BSD_TERMS + BSD_NAMES + BSD_DISCLAIMER),
    ("BSD-4-Clause", ("BSD 4-Clause License",), BSD_TERMS + BSD_ADVERTISING + BSD_DISCLAIMER),
    ("Unlicense", ("The Unlicense",), UNLICENSE),
    ("Unlicense", ("The Unlicense",), UNLICENSE + UNLICENSE_END),
    ("Zlib", ("zlib License", "The zlib/libpng License"), ZLIB),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",), BOOST),
    ("WTFPL", ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",), WTFPL),
)
#: Notices: a line or a paragraph of its own.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", GPL_HEADER.format(c=";", k="General Public License", e="; either", v="2")),
    ("GPL-3.0", GPL_HEADER.format(c=":", k="General Public License", e=", either", v="3")),
    ("LGPL-3.0", GPL_HEADER.format(c=":", k="Lesser General Public License", e=", either", v="3")),
    ("AGPL-3.0", GPL_HEADER.format(c=":", k="Affero General Public License", e=", either", v="3")),
    ("MPL-2.0", MPL_HEADER),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
#: Names that SPDX tags may give; those of the GNU licences with -only and -or-later too.
TAGGED = ("MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Unlicense", "Zlib", "BSL-1.0", "WTFPL", "Apache-2.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Artistic-2.0", "EPL-2.0")
GNU = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3")
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("v 2 0", "version 2 0"), ("http", "https"), ("copyright owner", "copyright holder"))
#: Clauses whose holders' names don't count, in canonical form.
HOLDERS = (("provided by .{1,120}? as is", "provided by x as is"), ("in no event shall .{1,160}? be liable", "in no event shall x be liable"), ("neither the names? of .{1,120}? nor the names of .{1,80}? may be used", "neither the name of x may be used"), ("software developed by .{1,120}? 4 neither", "software developed by x 4 neither"))
WORDS = ("licen", "rights reserved", "public domain", "permi", "redistribut", "copyright", "warrant", "neither the name", "free of charge", "misrepresented", "source distribution", "acknowledg", "what the fuck", "compiled binary")
# End of fixed values.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(?:(?i:copyright)[ \t]*(?:\((?i:c)\)|©|[0-9:<\[{]|(?i:by)[ \t]|[ \t](?:The[ \t]+)?\p{Lu}[\p{L}.]*\p{Ll}[^\n]*(?i:authors|contributors|developers|foundation|project|team|inc|ltd|llc|gmbh)[.]?[ \t\r]*$)|\((?i:c)\)[ \t]*(?:[0-9]|(?i:copyright))|©)[^\n]*(?:\n|\z)"
SIGNS = r"[^\p{L}\p{N}]+"
PARAGRAPHS = r"\n[ \t\r]*\n\s*"


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of everything that is known entire."""
    out = [(n, t) for n, t in NOTICES]
    for name, titles, text in TEXTS:
        for title in ("", *(f"{t}\n\n" for t in titles)):
            out += [(name, title + text), (name, f"{title}All rights reserved.\n\n{text}")]
    tags = [(n, n) for n in TAGGED] + [(n, f"{n}{end}") for n in GNU for end in ("", "-only", "-or-later")]
    return [*out, *((n, f"SPDX-License-Identifier: {t}") for n, t in tags), ("Apache-2.0", APACHE_HEADER)]


def known_parts() -> list[tuple[str, int, str]]:
    """(name, number of parts, text of a part): the paragraphs of the texts that have several; a text that holds all of one's has it."""
    out = []
    for name, text in [*((n, t) for n, _, t in TEXTS), ("Apache-2.0", APACHE_HEADER)]:
        parts = [p for p in re.split(r"\n\s*", text) if re.search("|".join(map(re.escape, WORDS)), re.sub(r"[^\w]+", " ", p.lower()))]
        if len(parts) > 1:
            out += [(name, len(parts), p) for p in parts]
    return out


SPEAKS = "|".join(WORDS)


def flat(text: Column) -> Column:
    """Lower-case words, one space apart, without copyright lines."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "(?md)" + COPYRIGHT_LINE, "")), SIGNS, " "))


def equivalent(flat_: Column) -> Column:
    """A flat text with equivalent spellings made one and without holders' names, if it speaks of licences at all."""
    out = F.concat(F.lit(" "), flat_, F.lit(" "))
    for a, b in SPELLINGS * 2:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    out = F.trim(out)
    for a, b in HOLDERS:
        out = F.regexp_replace(out, a, b)
    return F.when(F.regexp_like(flat_, F.lit(SPEAKS)), out).otherwise(flat_)


def canonical(text: Column) -> Column:
    """The canonical form; '' if nothing is left."""
    return let(flat(text), equivalent)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def _listed(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    one = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, r))) for r in rows))
    return spark.range(1, numPartitions=1).select(F.explode(one).alias("k")).select("k.*")


def known(spark: SparkSession) -> DataFrame:
    """(digest, license) of the known entire texts and of DIGESTS."""
    given = _listed(spark, known_texts(), ("license", "text")).select(digest(F.col("text")).alias("digest"), "license")
    more = _listed(spark, [(d, n) for n, own in DIGESTS.items() for d in own], ("digest", "license"))
    return given.union(more).groupBy("digest").agg(F.min("license").alias("license"))


def known_units(spark: SparkSession) -> DataFrame:
    """(digest, license, parts) of units: those that count by themselves, and those of which a text must hold all ``parts``."""
    single = known(spark).withColumn("parts", F.lit(1))
    several = _listed(spark, known_parts(), ("license", "parts", "text")).select(digest(F.col("text")).alias("digest"), "license", "parts").distinct()
    return single.unionByName(several)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 (of the canonical whole text), license (of the whole text; null if unknown), notices (licences of its
    paragraphs and lines, sorted, distinct, comma-joined) and n_notices (how many of these matched)."""
    spark = docs.sparkSession
    spoken = lambda x: F.regexp_like(flat(x), F.lit(SPEAKS))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    own = docs.select("doc_id", text.alias("text_")).withColumn("flat_", flat(F.col("text_")))
    lines = F.split("text_", "\n")
    paragraphs = F.split("text_", PARAGRAPHS)
    units = F.concat(F.filter(lines, spoken), let(paragraphs, lambda p: F.when(F.size(p) > 1, F.filter(p, lambda x: F.contains(x, F.lit("\n")) & spoken(x))).otherwise(none)))
    digests = F.when(F.regexp_like("flat_", F.lit(SPEAKS)), F.transform(units, digest)).otherwise(none)
    rows = stored(own.select(F.monotonically_increasing_id().alias("row_"), "doc_id", F.sha2(equivalent(F.col("flat_")).cast("binary"), 256).alias("digest"), digests.alias("units")), "digests")
    # Both known sides are fixed lists of some hundred rows.
    met = rows.where(F.size("units") > 0).select("row_", F.explode("units").alias("digest")).join(F.broadcast(known_units(spark)), "digest")
    each = met.groupBy("row_", "license", "parts").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("different")).where("different >= parts")
    n = F.when(F.col("parts") > 1, F.lit(1).cast("long")).otherwise(F.col("n"))
    each = each.groupBy("row_", "license").agg(F.max(n).alias("n"))
    found = each.groupBy("row_").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.sum("n").alias("n_notices"))
    whole = rows.drop("units").join(F.broadcast(known(spark)), "digest", "left").join(found, "row_", "left")
    return whole.select("doc_id", F.col("digest").alias("text_sha256"), "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))


def _sql_canonical(text: str) -> str:
    own = f"trim(regexp_replace(lower(regexp_replace({text}, '(?m){COPYRIGHT_LINE}', '', 'g')), '{SIGNS}', ' ', 'g'))"
    out = f"' ' || {own} || ' '"
    for a, b in SPELLINGS * 2:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    out = f"trim({out})"
    for a, b in HOLDERS:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"CASE WHEN regexp_matches({own}, '{SPEAKS}') THEN {out} ELSE {own} END"


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``query``."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    texts = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known_texts())
    more = ", ".join(f"('{d}', '{n}')" for n, own in DIGESTS.items() for d in own)
    parts = ", ".join(f"({quoted(n)}, {k}, {quoted(t)})" for n, k, t in known_parts())
    return f"""WITH k AS (SELECT digest, min(n) AS license FROM (SELECT sha256({_sql_canonical('t')}) AS digest, n FROM (VALUES {texts}) AS v(n, t) UNION ALL SELECT * FROM (VALUES {more}) AS w(digest, n)) GROUP BY 1),
    ku AS (SELECT digest, license, 1 AS parts FROM k UNION SELECT sha256({_sql_canonical('t')}), n, parts FROM (VALUES {parts}) AS v(n, parts, t)),
    d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
    p AS (SELECT rn, text, string_split_regex(text, '{PARAGRAPHS}') AS p FROM d WHERE regexp_matches(text, '(?i){'|'.join(w.replace(' ', SIGNS) for w in WORDS)}')),
    u AS (SELECT rn, unnest(list_concat(string_split(text, chr(10)), CASE WHEN len(p) > 1 THEN list_filter(p, lambda x: contains(x, chr(10))) ELSE [] END)) AS unit FROM p),
    h AS (SELECT rn, sha256({_sql_canonical('unit')}) AS digest FROM u),
    e AS (SELECT rn, license, CASE WHEN parts > 1 THEN 1 ELSE count(*) END AS n FROM h JOIN ku USING (digest) GROUP BY rn, license, parts HAVING count(DISTINCT digest) >= parts),
    g AS (SELECT rn, license, max(n) AS n FROM e GROUP BY ALL),
    m AS (SELECT rn, string_agg(license, ',' ORDER BY license) AS notices, sum(n)::BIGINT AS n FROM g GROUP BY 1)
    SELECT doc_id, sha256({_sql_canonical('text')}) AS text_sha256, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices FROM d LEFT JOIN k ON sha256({_sql_canonical('text')}) = digest LEFT JOIN m USING (rn)"""

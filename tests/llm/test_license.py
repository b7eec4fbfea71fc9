import hashlib
import os
import textwrap

import duckdb
import regex

from siltstone.llm import license as L
from siltstone.llm.license import ISC, MIT, SPELLINGS, TEXTS, known_texts, scanned

SF = "/root/testdata/sf0.001"
NAME = r"(?:The[ \t]+)?\p{Lu}[\p{L}.]*\p{Ll}.*(?i:authors|contributors|developers|foundation|project|team|inc|ltd|llc|gmbh)[.]?[ \t\r]*"
MARKED = regex.compile(r"[^\p{L}\p{N}]*(?:(?i:copyright)[ \t]*(?:\([cC]\)|©|[0-9:<\[{]|(?i:by)[ \t]).*|(?i:copyright)[ \t]+" + NAME + r"|\([cC]\)[ \t]*(?:[0-9]|(?i:copyright)).*|©.*)")


def form(text):
    """The canonical form, line by line and word by word."""
    kept = "\n".join(line for line in text.split("\n") if not MARKED.fullmatch(line))
    flat = " ".join(regex.findall(r"[\p{L}\p{N}]+", kept.lower()))
    if not any(w in flat for w in L.WORDS):
        return flat
    flat = f" {flat} "
    for a, b in SPELLINGS * 2:
        flat = flat.replace(f" {a} ", f" {b} ")
    flat = flat.strip()
    for a, b in L.HOLDERS:
        flat = regex.sub(a, b, flat)
    return flat


def test_digests_and_names(spark):
    texts = [
        (1, MIT), (2, "Copyright (c) 2020 A. B.\n\n" + MIT.replace("\n", "\n\n").upper()), (3, "prose\nReleased under the  MIT Licence!!\nmore"), (4, "x\n\n" + ISC + "\n\ny"), (5, "Released under the MIT License by us."),
        (6, None), (7, ""), (7, ""), (None, "All rights reserved."), (8, "© 2001 X\nAll rights reserved."), (9, "Ünïcode © licence\n(c) me\n日本"), (10, "a" * 100000),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'d' AS digest", "'l' AS license", "1 AS found")
    rows = scanned(docs).collect()
    assert len(rows) == len(texts)
    assert sorted((str(r.doc_id), r.text_sha256) for r in rows) == sorted((str(i), hashlib.sha256(form(t or "").encode()).hexdigest()) for i, t in texts)
    got = {r.doc_id: (r.license, r.notices, r.n_notices) for r in rows}
    assert got[1][0] == got[2][0] == "MIT" and got[3] == (None, "MIT", 1) and got[4] == (None, "ISC", 1) and got[5] == (None, "", 0)
    assert got[6] == got[7] == got[10] == (None, "", 0) and got[None][0] == got[8][0] == "proprietary" and got[8][2] == 1
    assert scanned(docs.limit(0)).count() == 0


def test_every_known_text_is_found_whole(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(known_texts())], "doc_id long, text string")
    assert {r.doc_id: r.license for r in scanned(docs).collect()} == {i: n for i, (n, _) in enumerate(known_texts())}


BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
MPL2 = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def test_common_full_texts_and_headers(spark):
    texts = [BSD2.format(""), "BSD 3-Clause License\n\nCopyright (c) 2020, A. B.\nAll rights reserved.\n\n" + BSD2.format(NAMES), GPL3, MPL2, "SPDX-License-Identifier: LGPL-2.1-or-later"]
    want = ["BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "MPL-2.0", "LGPL-2.1"]
    if os.path.isdir(TEXTS := "/usr/share/common-licenses"):
        for name in ("Apache-2.0", "MPL-2.0", "LGPL-3", "GPL-2", "GPL-3", "CC0-1.0"):
            texts.append(open(f"{TEXTS}/{name}", encoding="utf-8").read())
            want.append(name if "." in name else name + ".0")
    texts.append(f"prose\n{GPL3}\nmore")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in scanned(docs).collect()}
    assert [got[i][0] for i in range(len(want))] == want
    assert got[len(texts) - 1] == (None, "GPL-3.0")


WIDTHS = (40, 60, 72, 100)


def wrapped(text, width):
    return "\n\n".join("\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in regex.split(r"\n\s*", text))


def rewrapped(paragraph, width):
    """A copyright line stays a line of its own, the other lines flow together."""
    own = [line for line in paragraph.split("\n") if regex.match(r"\s*Copyright ([(\[]|[0-9])", line)]
    rest = " ".join(line for line in paragraph.split("\n") if line not in own)
    return "\n".join([*own, *textwrap.wrap(rest, width, break_long_words=False, break_on_hyphens=False)])


def test_any_wrapping_and_holder(spark):
    """Each licence, wrapped to several widths, under a copyright line, with a holder's own name; and inside a longer text."""
    rows, want = [], []
    for name, titles, text in TEXTS:
        own = text.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "JANE ROE AND FRIENDS").replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "JANE ROE").replace("the copyright holder nor the names of its contributors", "Roe Labs Inc. nor the names of its staff")
        for width in WIDTHS:
            rows.append(f"{titles[0]}\n\nCopyright (c) 2019-2024, Jane Roe\n\n{wrapped(own, width)}\n")
            want.append((name, None))
            rows.append(f"Some prose.\n\n{wrapped(own, width)}\n\nMore prose.")
            want.append((None, name))
    long = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "GFDL-1.3"}
    for name in long if os.path.isdir("/usr/share/common-licenses") else ():
        file = name.removesuffix(".0") if "GPL" in name else name
        text = open(f"/usr/share/common-licenses/{file}", encoding="utf-8").read()
        for width in WIDTHS:
            rows.append("\n\n".join(rewrapped(p, width) for p in regex.split(r"\n[ \t]*\n", text)))
            want.append((name, None))
    got = {r.doc_id: (r.license, r.notices.split(",")) for r in scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, (whole, part) in enumerate(want):
        assert got[i][0] == whole, (want[i], rows[i][:300])
        assert part is None or part in got[i][1], (want[i], got[i])
    assert len({n for n, _ in want if n}) >= 15


def test_planted_whole_texts_change_the_query(spark, tmp_path):
    """Whole licences among ordinary documents; the query and its SQL agree on them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = [(10_000 + i, f"Copyright 2020 A. B.\n{wrapped(t, 66)}") for i, (_, _, t) in enumerate(TEXTS)] + [(None, MIT), (20_000, None), (20_001, "")] + [(30_000, ISC)] * 3
    docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = L.query(spark, str(tmp_path)).collect()
    assert sum(r.license is not None for r in rows) == len(TEXTS) + 4
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(L.oracle_sql())
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r[c] for c in sorted(want.columns)) for r in rows) == key(tuple(dict(zip(want.columns, r))[c] for c in sorted(want.columns)) for r in want.fetchall())

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatline.llm import languages, licenses, toxicity, warc


# Languages


def test_language_of_held_out_texts(spark):
    pick = random.Random(1)
    words = {"aa": ["the", "and", "house", "thing"], "bb": ["über", "schön", "straße", "ich"], "cc": ["que", "niño", "año"]}
    rows = [(k, " ".join(pick.choices(words[lang], k=8)), lang) for k, lang in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.train(docs.filter("doc_id % 2 = 0"))
    found = languages.predict(docs.filter("doc_id % 2 = 1"), model).collect()
    assert model.names == ("aa", "bb", "cc")
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in found)


def test_scores_are_those_of_naive_bayes(spark):
    rows = [(0, "ab ba", "x"), (1, "bb", "y"), (2, "aab", "x")]
    model = languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return languages._grams(data, np.array([0, len(data)]))[0]

    counts = {n: np.zeros(languages.BUCKETS) for n in "xy"}
    for _, text, lang in rows:
        np.add.at(counts[lang], grams(text), 1)
    total = {
        n: np.log(p) + np.log((counts[n] + 0.1) / (counts[n] + 0.1).sum())[grams("abb")].sum()
        for n, p in (("x", 2 / 3), ("y", 1 / 3))
    }
    want = 1 / (1 + np.exp(-abs(total["x"] - total["y"])))
    row = languages.predict(spark.createDataFrame([("abb",)], "text string"), model).first()
    assert row.lang_pred == max(total, key=total.get) and row.score == pytest.approx(want)


def test_batch_and_single_texts_agree():
    texts = ["Ärger", "", "12 .", "naïve  x", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    bucket, row, some = languages._grams(data, at)
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert sorted(bucket[row == k]) == sorted(languages._grams(raw, np.array([0, len(raw)]))[0])
    assert some.tolist() == [True, False, False, True, True]


def test_language_of_odd_rows(edge_docs, no_docs):
    model = languages.train(edge_docs)
    rows = languages.predict(edge_docs, model, lang_pred="found").collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        letter = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.found != "und") == letter and 0 <= r.score <= 1
    empty = languages.train(no_docs)
    assert empty.names == ()
    assert {(r.lang_pred, r.score) for r in languages.predict(edge_docs, empty).collect()} == {("und", 0.0)}
    assert languages.predict(no_docs, model).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(str(k), "text") for k in range(3)], "lang string, text string")
    with pytest.raises(ValueError):
        languages.train(docs)


# Licences


def test_every_rule_can_be_met():
    for _, parts in licenses.RULES:
        assert set(parts) <= set(licenses.SENTENCES.values())


def scanned(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return [tuple(r) for r in licenses.scan(rows, keep=[]).collect()]


def test_sequences_and_rules(spark):
    bsd = [k for k, v in licenses.SENTENCES.items() if v.startswith("bsd-")]
    found = scanned(
        spark,
        "Code.\nReleased under the MIT License.\nMore",
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License,\nVersion 2.0. Licensed under CC BY-NC 4.0.",
        ". ".join(s.capitalize() for s in bsd) + ".",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that\n"
        "the following conditions are met:",
        "All rights reserved. You may obtain a copy of the License at: here",
        "Nothing here",
    )
    assert found[0] == (1, "mit-name", "MIT", "", "matched")
    assert found[1][1:3] == ("cc-by-nc4-name,apache2-name,cc-by-nc4-name", "Apache-2.0,CC-BY-NC-4.0") or found[1][0] == 2
    assert found[2] == (5, "bsd-grant,bsd-source,bsd-binary,bsd-endorse,bsd-warranty", "BSD-3-Clause", "", "matched")
    assert found[3] == (1, "bsd-grant", "", "bsd-grant", "unknown")
    assert found[4] == (2, "rights-reserved,apache2-copy", "LicenseRef-all-rights-reserved", "apache2-copy", "partial")
    assert found[5] == (0, "", "", "", "none")


MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
"""
APACHE = """   Copyright 2020 A. Author

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
NOTICES = {
    MIT: (5, "mit-title,mit-grant,mit-notice,mit-warranty,mit-liability", "MIT", "", "matched"),
    BSD: (5, "bsd-grant,bsd-source,bsd-binary,bsd-endorse,bsd-warranty", "BSD-3-Clause", "", "matched"),
    APACHE: (
        5, "apache2-name,apache2-condition,apache2-copy,apache2-warranty,apache2-see", "Apache-2.0", "", "matched",
    ),
    GPL3: (4, "gpl3-later,gpl-warranty,gpl-see,gpl-copy", "GPL-3.0-or-later", "", "matched"),
    MPL2: (1, "mpl2-name", "MPL-2.0", "", "matched"),
}


def wrapped(text, width):
    import textwrap

    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


def test_whole_notices(spark):
    def commented(text):
        return "/*\n" + "".join(f" * {line}".rstrip() + "\n" for line in text.split("\n")) + " */\nint x;"

    ways = [str, commented, lambda t: t.replace("\n", "\r\n"), *[lambda t, w=w: wrapped(t, w) for w in (40, 61, 10_000)]]
    ways.append(lambda t: " ".join(t.removeprefix("   Copyright 2020 A. Author").split()))
    ways.append(lambda t: t.replace("at\n\n", "at\n"))
    texts = [way(notice) for way in ways[:-2] for notice in NOTICES]
    assert scanned(spark, *texts) == [row for _ in ways[:-2] for row in NOTICES.values()]
    assert scanned(spark, *[way(n) for way in ways[-2:] for n in (APACHE, GPL3)]) == [NOTICES[APACHE], NOTICES[GPL3]] * 2


def test_cuts(spark):
    found = scanned(
        spark,
        "Copyright X\nAll rights reserved.\nMIT License\nCopyright Y",
        "It is not\nlicensed under the MIT License.",
        "Released under the Apache. License, Version 2.0",
        "Released under the Apache License. Version 2.0",
        "Licensed under the Apache License,\nVersion 2.0 of\nit",
        ". " * 50_000 + "\n" * 50_000 + "Licensed under CC BY 4.0" + " é. É" * 20_000,
    )
    assert [row[1] for row in found] == ["rights-reserved,mit-title", "", "", "", "", "cc-by4-name"]


def test_no_text_is_dropped_before_it_is_cut(spark):
    spaced = ["All rights\nreserved.", "All  rights   reserved", "All rights-reserved.", "ALL RIGHTS\n * RESERVED."]
    assert [row[1] for row in scanned(spark, *spaced)] == ["rights-reserved"] * 4
    free = "This is free and unencumbered software released into the public\ndomain."
    assert scanned(spark, free)[0][1:3] == ("unlicense-name", "Unlicense")
    rows = spark.createDataFrame([("Do as\nyou like.",), ("Do v. 2 it",)], "text string")
    own = licenses.scan(rows, known={"do as you like": "x", "do v. 2 it": "y"}, rules=[("X", ["x"])], keep=[])
    assert [(r.sequence, r.status) for r in own.collect()] == [("x", "matched"), ("y", "unknown")]


def test_licences_of_odd_rows(edge_docs, no_docs):
    rows = licenses.scan(edge_docs).collect()
    assert len(rows) == edge_docs.count() and {r.status for r in rows} == {"none"}
    assert licenses.scan(no_docs).count() == 0
    clashing = edge_docs.withColumns({"status": F.lit(1), "ids": F.lit(2), "Licenses": F.lit("x")})
    found = licenses.scan(clashing)
    assert found.columns == [*clashing.columns, "n_known", "sequence", "_licenses", "left_over", "_status"]
    assert {(r.status, r.Licenses, r._status) for r in found.collect()} == {(1, "x", "none")}


def test_short_forms_of_licences(spark):
    lines = ["SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: GPL-2.0-or-later\nint x;",
             "/* SPDX-License-Identifier: LGPL-2.1-only */", "SPDX-License-Identifier: None-Such", "SPDX-License-Identifier:\nEPL-2.0"]
    assert [row[2] for row in scanned(spark, *lines)] == ["MIT", "GPL-2.0-or-later", "LGPL-2.1-only", "", "EPL-2.0"]


def plain_runs(parts, known):
    """Left to right, the longest known run of pieces at each place."""
    out, at = [], 0
    while at < len(parts):
        size = next((n for n in range(len(parts) - at, 0, -1) if " ".join(parts[at : at + n]) in known), 0)
        if size:
            out.append(known[" ".join(parts[at : at + size])])
        at += max(size, 1)
    return out


def plain_rules(ids, rules):
    names, left, at = [], [], 0
    table = {tuple(parts): name for name, parts in reversed(rules)}
    while at < len(ids):
        size = next((n for n in range(len(ids) - at, 0, -1) if tuple(ids[at : at + n]) in table), 0)
        if size:
            names.append(table[tuple(ids[at : at + size])])
        else:
            left.append(ids[at])
        at += max(size, 1)
    return [n for n in dict.fromkeys(n for n, _ in rules) if n in names], left


def test_runs_and_rules_like_a_plain_walk(spark):
    """A register of many sentences, some inside or across others, read from tables."""
    pick = random.Random(8)
    words = [f"w{k}" for k in range(12)]
    known = {" ".join(pick.choices(words, k=pick.choice([1, 2, 2, 3, 5, 9]))): f"s{k % 300}" for k in range(1500)}
    rules = [(f"L{k % 40}", [f"s{pick.randrange(300)}" for _ in range(pick.choice([1, 1, 2, 3]))]) for k in range(200)]
    sentences = spark.createDataFrame(list(known.items()), "sentence string, identifier string")
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "place int, license string, parts array<string>")
    known_again, rules_again = licenses.register(sentences, table)
    assert (known_again, rules_again) == (known, rules)
    texts, wanted = [], []
    for k in range(200):
        lines = [" ".join(pick.choices(words, k=pick.randint(1, 4))) for _ in range(pick.randint(1, 12))]
        if k % 3 == 0:
            lines[0] = pick.choice(list(known))
        texts.append((k, "\n- ".join(lines)))
        ids = plain_runs(lines, known)
        names, left = plain_rules(ids, rules)
        wanted.append((k, ",".join(ids), ",".join(names), ",".join(left)))
    found = licenses.scan(spark.createDataFrame(texts, "k int, text string"), known=known_again, rules=rules_again)
    assert sorted((r.k, r.sequence, r.licenses, r.left_over) for r in found.collect()) == wanted


def test_sql_finds_wrapped_notices_too(spark):
    import duckdb

    notices = [wrapped(t, w) for t in NOTICES for w in (30, 61)] + list(NOTICES) + ["", None, "x", "SPDX-License-Identifier: ISC"]
    rows = list(enumerate(notices))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = connection.execute(licenses.scan_sql())
    names = [c[0] for c in cursor.description]
    wanted = sorted(tuple(dict(zip(names, r)).values()) for r in cursor.fetchall())
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(frame, keep=["doc_id"]).select(names)
    assert sorted(map(tuple, found.collect())) == wanted


# WARC derivatives


def test_records_of_a_page(spark):
    import base64
    import hashlib

    html = (
        "<html><head><title>A &amp; B\n C</title><script>x('</p>')</script></head><body><!-- no --><p>One <b>two</b>"
        "<br>three&nbsp;&lt;</p><a class=x href=\"/u\">link</a><A HREF=\"/v w\">v</A></body></html>"
    )
    pages = spark.createDataFrame([(1, "http://x/", html)], "page_id long, url string, html string")
    rows = {r.record_type: r for r in warc.derivatives(warc.responses(pages)).collect()}
    text, meta = rows["conversion"], rows["metadata"]
    assert text.block == "A & B\nC\nOne two\nthree <\nlinkv"
    assert meta.block.split("\r\n")[:4] == [
        "title: A & B C", "http-content-type: text/html; charset=utf-8", "outlink: /u", "outlink: /v w",
    ]
    digest = lambda s: "sha1:" + base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert text.block_digest == digest(text.block) and text.source_digest == meta.source_digest == digest(html)
    assert text.refers_to == meta.refers_to and len({text.record_id, meta.record_id, text.refers_to}) == 3
    assert text.content_length == len(text.block.encode())
    header = text.warc_header.split("\r\n")
    assert header[0] == "WARC/1.1" and f"WARC-Refers-To: {text.refers_to}" in header and header[-2:] == ["", ""]


def test_links_and_references(spark):
    html = (
        "<a href='x1'>a</a><a href=x2>b</a><a data-href=\"no\">c</a><a class=\"k\"  HREF = \"x?a=1&amp;b=href=2\">d</a>"
        "<area href=no><a>e</a><a\nhref=x3\ntarget=t>&eacute;&#8217;&#x2014;&mdash;&nope;&amp;lt;&#xD800;&#0;&#99999999;&copy &apos;&</a>"
    )
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    rows = {r.record_type: r for r in warc.derivatives(warc.responses(pages)).collect()}
    text, meta = rows["conversion"], rows["metadata"]
    assert [x[9:] for x in meta.block.split("\r\n") if x.startswith("outlink")] == ["x1", "x2", "x?a=1&b=href=2", "x3"]
    assert text.block == "abcdeé’——&nope;&lt;\ufffd\ufffd&#99999999;&copy '&"
    assert (text.concurrent_to, meta.concurrent_to) == (meta.record_id, text.record_id)
    assert f"WARC-Concurrent-To: {meta.record_id}" in text.warc_header


def test_files_round_trip(spark, tmp_path):
    rows = [(1, None, None), (2, "http://u/", "<p>é" + "x" * 100_000), (3, "v", "a\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\nb\r\n")]
    rows += [(4, "w", "WARC/1.1\r\n" * 3), rows[1]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sent = warc.responses(pages)
    warc.write(warc.response_records(sent), str(tmp_path / "in"))
    back = warc.read(spark, str(tmp_path / "in"))
    assert [r.intact for r in warc.verified(back).collect()] == [True] * 5
    again = warc.read_responses(back)
    names = ["record_id", "target_uri", "date", "http_header", "payload", "payload_digest"]
    assert Counter(map(tuple, again.select(names).collect())) == Counter(map(tuple, sent.select(names).collect()))
    made = warc.derivatives(again)
    warc.write(made, str(tmp_path / "out"))
    found = warc.verified(warc.read(spark, str(tmp_path / "out"))).collect()
    wanted = made.select("record_type", "record_id", "warc_header", "block").collect()
    assert Counter((r.record_type, r.record_id, r.header, bytes(r.block), r.intact) for r in found) == Counter(
        (r.record_type, r.record_id, r.warc_header[:-4].removeprefix(warc.VERSION), r.block.encode(), True) for r in wanted
    )
    import gzip

    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").glob("*.gz"))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "a.warc").write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception, match="within a record"):
        warc.read(spark, str(broken)).count()
    warc.write(warc.response_records(sent.limit(0)), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<p" * 50_000), (3, "v", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.derivatives(warc.responses(pages)).collect()
    assert len(found) == 2 * len(rows)
    assert Counter(r.block for r in found if r.record_type == "conversion" and r.key in (1, 3)) == {"": 2, "plain": 1}
    assert all(r.warc_header.startswith("WARC/1.1\r\nWARC-Type: ") for r in found)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


# Toxicity


@pytest.fixture(scope="module")
def toxic_rows():
    pick = random.Random(2)
    common = ["house", "river", "stone", "window", "morning", "letter", "garden", "simple", "common", "people"]
    rows = []
    for k in range(400):
        words = pick.choices(common, k=12)
        bad = k % 5 == 0
        if bad:
            words[pick.randrange(12)] = pick.choice(["idiot", "moron"])
        rows.append((k, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark, toxic_rows):
    rows = spark.createDataFrame(toxic_rows, "doc_id long, text string, toxic int")
    return toxicity.train(rows, rows)


def test_toxic_words_are_learned(toxic_model):
    assert set(toxic_model.words) == {"idiot", "moron"} and 0 < toxic_model.base < 0.05


def test_labels_meet_their_texts(spark):
    docs = spark.createDataFrame([(1, "a", 9), (1, "b", 9), (2, None, 9), (None, "c", 9)], "doc_id long, text string, toxic int")
    labels = [(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (2, None), (2, 7)]
    labels = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, toxic int, text string")
    rows = toxicity.labelled_texts(docs, labels)
    found = sorted(map(str, (tuple(r) for r in rows.collect())))
    assert found == sorted(map(str, [("a", 1, 2), ("b", 1, 2), ("a", 0, 1), ("b", 0, 1), (None, 0, 1)]))
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().toString()
    many = spark.range(3000).selectExpr("id AS doc_id", "'a' AS text", "1 AS toxic")
    assert 700 < toxicity.labelled_texts(many, many, most=1000).count() < 1300
    copies = docs.limit(0).selectExpr("text", "toxic", "1 AS copies")
    assert toxicity.train(docs, copies, copies="copies").words == {}


def plain_cover(sets, names, rows):
    """Words by explained rows, every count made anew each time."""
    weight, left = {}, list(sets)
    z = 1.96

    def bound(hits, n):
        rate = hits / max(n, 1)
        n = max(n, 1)
        spread = z * math.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
        return (rate + z * z / (2 * n) - spread) / (1 + z * z / n)

    while True:
        best = None
        for k, name in enumerate(names):
            hits = sum(n for words, y, n in left if k in words and y)
            clean = sum(n for words, y, n in left if k in words and not y)
            sure = bound(hits, hits + clean)
            if hits >= toxicity.LEAST_ROWS and sure >= 0.5 and (best is None or (hits * sure, name) > best[0]):
                best = ((hits * sure, name), k, (hits + 0.5) / (hits + clean + 1))
        if best is None:
            break
        weight[names[best[1]]] = best[2]
        left = [s for s in left if best[1] not in s[0]]
    done = {y: rows[y] - sum(n for _, label, n in sets if label == y) + sum(n for _, label, n in left if label == y) for y in (0, 1)}
    return weight, (done[1] + 0.5) / (done[0] + done[1] + 1)


def test_words_cover_rows_like_a_plain_count():
    pick = random.Random(6)
    for _ in range(40):
        names = [f"w{k}" for k in range(pick.randint(1, 12))]
        sets = [
            (sorted(pick.sample(range(len(names)), pick.randint(1, len(names)))), int(pick.random() < 0.8), pick.randint(1, 9))
            for _ in range(pick.randint(0, 25))
        ]
        rows = {y: sum(n for _, label, n in sets if label == y) + 5 for y in (0, 1)}
        weight, base = toxicity._cover(sets, names, rows)
        wanted, floor = plain_cover(sets, names, rows)
        assert weight == pytest.approx(wanted) and base == pytest.approx(floor)


def test_obfuscated_words_are_restored(spark, toxic_model):
    texts = {
        "an 1d10t here": 1, "such a m0r0n": 1, "i d i o t again": 1, "m.o.r.o.n": 1, "what an idiiiot": 1, "IDIOT!": 1,
        "id!ot": 1, "a b house": 0, "the window 12 of 100": 0, "river.stone": 0, "": 0, "mooor": 0, "5th house": 0,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.text: r.score for r in toxicity.score(rows, toxic_model).collect()}
    assert {t: int(s >= 0.3) for t, s in found.items()} == texts


def test_marks_at_the_ends_of_words_are_read(spark, toxic_model):
    texts = {
        "an idio7 here": 1, "idio+": 1, "!diot": 1, "|diot": 1, "you |d10+": 1, "1 d 1 0 t": 1, "! d i o t": 1,
        "an 1.d.i.o.7": 1, "idiot!!": 1, "(idiot": 1, "moron<": 1, "m0r0n5 moron1": 1, "5 i d i o t": 1,
        "house! (river": 0, "1 2 3 4 5": 0, "5 a day": 0, "7 window+": 0,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.text: r.score for r in toxicity.score(rows, toxic_model).collect()}
    assert {t: int(s >= 0.3) for t, s in found.items()} == texts
    # Each one alone, so that no other text of the batch makes it a suspect.
    for text in ("!diot", "idio7", "a55"):
        assert toxicity._suspects(np.frombuffer(text.encode(), np.uint8)).any()
        assert toxicity._MARKED.fullmatch(text)


def test_toxicity_of_odd_rows(edge_docs, no_docs, toxic_model):
    rows = toxicity.score(edge_docs, toxic_model, name="found").collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.found < 0.3 for r in rows)
    labelled = edge_docs.withColumn("toxic", F.lit(1))
    model = toxicity.train(edge_docs, labelled.limit(0))
    assert model.words == {} and model.base == 0.0
    assert {r.score for r in toxicity.score(edge_docs, model).collect()} == {0.0}
    assert toxicity.score(no_docs, toxicity.train(no_docs, labelled)).count() == 0

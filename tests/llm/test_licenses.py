from frames import by_id, docs
from meterlake.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
See the License for the specific language governing permissions and limitations under the License."""


def test_sentences_become_identifiers_and_rules_licences(spark):
    rows = [
        (1, "Text. Released under the MIT License. More text."),
        (2, APACHE),
        (3, "LICENSED UNDER CC BY-NC 4.0!\nThis work is licensed under the GNU General Public License, version 3."),
        (4, "A license is a fine thing. Copyright too."),
        (5, "You may obtain a copy of the License at\nreleased -- under the MIT   licen" + "se\r\n"),
        (6, None),
        (7, ""),
        (8, "word " * 30_000 + "\nReleased under the MIT License."),
        (None, "Licensed under CC BY 4.0."),
        (1, "Text. Released under the MIT License. More text."),
    ]
    found = licenses.scan(docs(spark, rows).selectExpr("*", "1 as sentences", "2 as marked"))
    assert found.count() == len(rows)
    got = by_id(found)
    licences = {i: r.licences for i, r in got.items()}
    assert licences == {
        1: ["MIT"],
        2: ["Apache-2.0"],
        3: ["CC-BY-NC-4.0", "GPL-3.0-only"],
        4: [],
        5: ["MIT"],
        6: [],
        7: [],
        8: ["MIT"],
        None: ["CC-BY-4.0"],
    }
    assert got[2].sentences == ["apache2-may-not", "apache2-obtain", "apache2-see"] and got[2].unmatched == []
    assert got[5].unmatched == ["apache2-obtain"]


def test_order_of_rules_decides(spark):
    sentences = {"a": "license a", "b": "license b"}
    rules = ((("a", "b"), "AB"), (("a",), "A"), (("b",), "B"))
    rows = [(1, "license a\nlicense b\nlicense a"), (2, "license b\nlicense a"), (3, "license a\nother words\nlicense b")]
    got = by_id(licenses.scan(docs(spark, rows), sentences=sentences, rules=rules))
    assert {i: r.licences for i, r in got.items()} == {1: ["AB", "A"], 2: ["B", "A"], 3: ["AB"]}


def test_columns_and_plain_python_normalise_alike(spark):
    for text in licenses.SENTENCES.values():
        assert licenses.normal_sentence(text) in licenses.known_sentences()
    rows = [(k, t) for k, t in enumerate(licenses.SENTENCES.values()) if not any(x in t[:-1] for x in (". ", "! ", "? "))]
    got = by_id(licenses.scan(docs(spark, rows)))
    names = list(licenses.SENTENCES)
    assert all(got[k].sentences == [names[k]] for k, _ in rows)


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>."""

WRAPPED_APACHE = """/*
 * Copyright 2020 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""

MIT = """MIT License

Copyright (c) 2020 Somebody

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
SOFTWARE."""

BSD2 = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


def test_published_texts_in_wrapped_lines(spark):
    names = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
    rows = [(1, GPL), (2, WRAPPED_APACHE), (3, MIT.replace("\n", "\r\n")), (4, BSD2), (5, BSD2 + names), (6, isc)]
    rows += [(7, "Words. All rights reserved. More"), (8, "under the mit license we walk, all rights reserved by them"), (9, None), (10, "a | b" * 9000)]
    rows += [(11, "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy"), (12, GPL.replace("GNU General", "GNU\nGeneral") + "\n" + MIT)]
    got = by_id(licenses.scan_texts(docs(spark, rows)))
    assert {i: r.licences for i, r in got.items()} == {
        1: ["GPL-3.0-or-later"],
        2: ["Apache-2.0"],
        3: ["MIT"],
        4: ["BSD-2-Clause"],
        5: ["BSD-3-Clause"],
        6: ["ISC"],
        7: [],
        8: [],
        9: [],
        10: [],
        11: ["MPL-2.0"],
        12: ["GPL-3.0-or-later", "MIT"],
    }
    assert got[7].sentences == got[7].unmatched == ["rights"] and got[8].sentences == []
    assert all(got[i].unmatched == [] for i in (1, 2, 3, 6)) and got[4].unmatched == ["rights"]


def test_wrapped_texts_match_their_sql(spark):
    import random

    import duckdb

    rng = random.Random(4)
    parts = [GPL, WRAPPED_APACHE, MIT, BSD2, *licenses.PUBLISHED.values(), "Plain words; more.", "|", "\n", "\r\n", " ", "// ", "é", "", "2."]
    texts = [None, "", "All rights reserved", *(("".join if k % 2 else "\n".join)(rng.choices(parts, k=rng.randint(1, 6))) for k in range(300))]
    texts += [t.replace(" ", rng.choice(["\n", " | ", ".\n", "  "]), rng.randint(1, 9)) for t in texts[3:]]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    expected = {i: (n, l, u) for i, n, l, u in con.execute(licenses.scan_texts_sql()).fetchall()}
    got = by_id(licenses.scan_texts(docs(spark, rows)))
    assert {i: (len(r.sentences), ",".join(r.licences), ",".join(r.unmatched)) for i, r in got.items()} == expected
    assert len({l for _, l, _ in expected.values()}) > 15


def test_every_published_sentence_is_found(spark):
    rows = list(enumerate(licenses.PUBLISHED.values()))
    got = by_id(licenses.scan_texts(docs(spark, rows)))
    assert [got[k].sentences for k, _ in rows] == [[i] for i in licenses.PUBLISHED]
    assert licenses.scan_texts(docs(spark, rows), sentences={}, rules=()).where("size(sentences) > 0").count() == 0


def test_empty_table(spark):
    assert licenses.scan(docs(spark, [])).collect() == []

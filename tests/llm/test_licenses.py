"""Licence scans on the public texts of licences, wrapped and in comments, alone and among other text."""

import re
import textwrap

import duckdb
import pytest

from stainloom.llm import licenses, queries
from stainloom.llm.licenses import license_scan

MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Copyright (c) 2020, A. Person

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE"
BSD3 = BSD2.replace("THIS SOFTWARE", THIRD, 1)
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
TEXTS = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0": GPL3, "GPL-2.0": GPL2}


def wrapped(text, width, mark=""):
    return "\n".join(mark + x for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""]))


def cases():
    for name, text in TEXTS.items():
        for width in (60, 72, 79):
            yield name, wrapped(text, width)
        yield name, wrapped(text, 76, " * ")
        yield name, wrapped(text, 70, "# ")
        yield name, f"Some story goes here. It has an end\n\n{wrapped(text, 72)}\n\nAnd more. " + "word " * 500
    yield "", "The design of this software was permitted to change; nothing else."
    yield "", "No license.\n" * 30
    yield "", None
    yield "", ""
    yield "", " \n \n"
    yield "Public-Domain", "This work is dedicated to the public  domain."
    yield "All-Rights-Reserved", "prose without an end\nAll rights, reserved.\nmore prose"
    yield "MIT,All-Rights-Reserved", "Released under the MIT License.\nx y z\nAll rights reserved."
    yield "CC-BY-NC-4.0", "prose before\nLicensed under CC BY-NC 4.0.\nprose after"
    yield "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."
    yield "MIT,Apache-2.0", MIT + "\n\n" + APACHE
    yield "MIT", MIT + "\n\n" + MIT


def test_standard_texts(spark):
    docs = list(cases())
    df = spark.createDataFrame([(i, t, "clash") for i, (_, t) in enumerate(docs)], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r for r in license_scan(df).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {i: n for i, (n, _) in enumerate(docs)}
    kinds = {"MIT": "permissive", "GPL-2.0": "copyleft", "": "none", "CC-BY-NC-4.0": "restricted", "MIT,All-Rights-Reserved": "restricted"}
    assert all(r["kind"] == kinds.get(r["licenses"], r["kind"]) for r in got.values())
    first = next(i for i, (_, t) in enumerate(docs) if t and t.startswith("Released"))
    assert got[first]["sentence_places"] == [0, docs[first][1].index("All")]
    assert license_scan(df.limit(0)).count() == 0


def test_long_and_repeated_rows(spark):
    long = "the licence of a word; " * 60_000 + "Released under the MIT License."
    df = spark.createDataFrame([(1, long), (1, long), (None, MIT)], "doc_id long, text string")
    assert [r["licenses"] for r in license_scan(df).collect()] == ["MIT"] * 3


def test_every_sentence_has_an_anchor_and_every_rule_its_sentences():
    assert all(any(a in t for a in licenses.ANCHORS) for of in licenses.SENTENCES.values() for t in of)
    assert all(re.sub(r"[^a-z0-9]+", " ", t).strip() == t for of in licenses.SENTENCES.values() for t in of)
    assert {x for _, _, of in licenses.RULES for x in of} <= set(licenses.SENTENCES)


@pytest.mark.parametrize("order", [1, -1])
def test_other_tables_and_order(spark, order):
    """The earliest place wins, then the longest rule, then the order of the table."""
    known = {x: [f"sentence {x}"] for x in "abcdef"}
    rules = [("AB", "copyleft", ["a", "b"]), ("ABC", "permissive", ["a", "b", "c"]), ("B", "restricted", ["b"]), ("A", "permissive", ["a"]), ("AA", "permissive", ["a"])][::order]
    texts = ["a. b. c.", "a. d. b.", "b. a. d. e. f. b.", "a. c. b. e. d. f. c.", "c."]
    df = spark.createDataFrame([(i, " ".join(f"Sentence {x}" for x in t.split())) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan(df, sentences=known, rules=rules, anchors=["sentence"]).collect()}
    one = "A" if order == 1 else "AA"
    assert got == {0: "ABC", 1: "AB", 2: f"B,{one}", 3: "AB", 4: ""}


def test_sql_twin(spark):
    docs = list(cases())
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string").toPandas()
    con = duckdb.connect()
    con.register("documents", df)
    got = {r[0]: r[3] for r in con.execute(queries.SQL["op3_license_scan"]).fetchall()}
    assert got == {i: n for i, (n, _) in enumerate(docs)}

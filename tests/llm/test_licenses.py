"""License rules: rows against SQL, rules over made-up texts."""

import re

from gridloom.llm import licenses

MIT = """Copyright (c) 2020 Someone

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


def test_rows_against_sql(spark, sf_dir, same_rows):
    assert same_rows(licenses.op7_sentence_rules(spark, sf_dir), licenses.OP7_SQL) > 0


def test_every_sentence_has_a_hint_and_a_rule_for_its_identifier():
    used = {i for _, ids in licenses.RULES for i in ids}
    for sentence, identifier in licenses.SENTENCES.items():
        assert re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", sentence) and not re.match("[0-9]+ ", sentence)
        assert identifier in used
        raw = sentence.replace("licenses license", "licenses/LICENSE")
        assert re.search(licenses.HINT, raw), sentence


def test_rules(spark):
    bsd = [s for s, i in licenses.SENTENCES.items() if i.startswith("bsd-") and "short" not in i and i != "bsd-advertising"]
    order = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability"]
    bsd.sort(key=lambda s: order.index(licenses.SENTENCES[s]))
    listed = "\n".join(f"{n}. {s}." for n, s in enumerate(bsd))
    two = "\n".join(f"* {s}." for s in bsd if licenses.SENTENCES[s] != "bsd-names")
    rows = [
        (1, MIT, "MIT"),
        (2, listed, "BSD-3-Clause"),
        (3, two, "BSD-2-Clause"),
        (4, "Title without a stop\nReleased under the MIT License.\nMore words", "MIT"),
        (5, "Some text. Licensed under the\nApache License, Version 2.0. Released under the MIT license", "Apache-2.0,MIT"),
        (6, "# SPDX-License-Identifier: GPL-3.0-or-later\ncode()", "GPL-3.0-or-later"),
        (7, MIT[:400], ""),
        (8, "// You may obtain a copy of the License at\n\n   http://www.apache.org/licenses/LICENSE-2.0\n", ""),
        (9, None, ""),
        (10, "", ""),
        (10, "", ""),
        (11, listed.replace("the copyright holder nor", "Some University nor").replace("the copyright holders and contributors as", "THE REGENTS as"), "BSD-3-Clause"),
        (12, two.replace("* redistributions in", "* You must send us a card each year.\n* redistributions in"), ""),
        (13, "conditions are met:\n1. ".join([two.split("conditions are met")[0].removeprefix("* "), two.split("are met.\n* ")[1]]), "BSD-2-Clause"),
        (14, "SPDX-License-Identifier: LGPL-2.1-or-later\n\nAll rights reserved.", "LGPL-2.1-or-later,All-rights-reserved"),
        (None, "Released under the MIT License." + " word" * 200_000, "MIT"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["licenses"]) for r in licenses.scan_licenses(df).collect())
    assert got == sorted((i or 0, n) for i, _, n in rows)
    eight = licenses.scan_licenses(df.filter("doc_id = 8")).first()
    assert eight["sentence_ids"] == "apache-2-copy,apache-2-url" and eight["n_sentences"] == 2
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_own_sentences(spark):
    """A caller's sentences are found in texts that hold no word of the fixed ones."""
    df = spark.createDataFrame([(1, "Title\n\nDo what you\nWANT to. More."), (2, "Nothing here."), (3, "Free for all!")], "doc_id long, text string")
    out = licenses.scan_licenses(df, {"do what you want to": "want", "free for all": "free"}, [("WTFPL", ["want"]), ("Free", ["free"])], [])
    assert sorted((r["doc_id"], r["licenses"]) for r in out.collect()) == [(1, "WTFPL"), (2, ""), (3, "Free")]

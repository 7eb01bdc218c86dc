import textwrap

from pyspark.sql import functions as F

from tokenloom.llm import licenses

MIT = """Some software. Permission is hereby granted, free of charge, to any person obtaining a copy
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


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rules string")
    return {r.doc_id: r for r in licenses.recognise(df).collect()}


def test_rules_in_order(spark):
    swapped = "\n".join(reversed(MIT.split("\n\n")))
    got = found(spark, [
        MIT, swapped, "prose.\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.", "x Licensed under CC BY-NC 4.0 y.",
        "Licensed under the Apache License, Version 2.0. And: All rights reserved.", "", None, "word " * 30000 + "\nreleased UNDER the mit license", "This work is licensed under the GNU General Public License, version 3!",
    ])
    assert got[0].licence == "MIT" and got[0].rules == "mit-text"
    assert got[0].sentence_ids == "mit-text-1,mit-text-2,mit-text-3,mit-text-4"
    assert "mit-text" not in got[1].rules
    assert [got[i].licence for i in range(2, 10)] == ["MIT", "CC-BY-NC-4.0", None, "Apache-2.0", None, None, "MIT", "GPL-3.0"]
    assert got[5].licences == "Apache-2.0,proprietary" and got[7].sentence_ids == "" and got[7].licences == ""


def forms(notice):
    """A notice as it stands in files: its paragraphs on long lines, wrapped, and in comments of several styles."""
    parts = [" ".join(p.split()) for p in notice.split("\n\n")]
    for start in ("", " * ", "# ", "// ", ";; ", "-- "):
        for width in (10_000, 60):
            lines = []
            for part in parts:
                lines += [start + line for line in textwrap.wrap(part, width, break_on_hyphens=False)] + [start.rstrip()]
            yield "\n".join([start + "Copyright (c) 2020, The Regents", start + "All rights reserved.", start.rstrip(), *lines, "code follows"])


def test_every_listed_notice_is_found_wrapped_and_commented(spark):
    texts, want = [], []
    for _, licence, notice in licenses.NOTICES:
        for text in forms(notice):
            texts.append(text)
            want.append(licence)
    got = found(spark, texts)
    missed = [(want[i], texts[i][:200], got[i].sentence_ids) for i in range(len(texts)) if got[i].licence != want[i]]
    assert not missed, (len(missed), missed[0])
    assert all(set(got[i].licences.split(",")) <= {want[i], "proprietary"} for i in range(len(texts)))
    assert all("proprietary" not in got[i].licences for i in range(len(texts)) if want[i].startswith("BSD"))


def test_tags(spark):
    styles = ("SPDX-License-Identifier: {}", "// SPDX-License-Identifier: {}", "/* SPDX-License-Identifier: {} */\nint x;", "code\n# SPDX-License-Identifier:\t{}\nmore")
    texts = [style.format(tag) for tag in licenses.TAGS for style in styles]
    got = found(spark, texts)
    assert [got[i].licence for i in range(len(texts))] == [tag for tag in licenses.TAGS for _ in styles]
    both = found(spark, ["SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: ISC AND MIT AND Zlib AND 0BSD", "SPDX-License-Identifier: Own"])
    assert set(both[0].licences.split(",")) == {"MIT", "Apache-2.0"} and len(both[1].licences.split(",")) == 4 and both[2].licence is None


def test_slots_take_names(spark):
    texts = [
        licenses.BSD3.replace("the copyright holder nor the names of its contributors", "the University of X, Y nor the names of its contributors"),
        licenses.BSD3.replace("3. Neither", "* Neither").replace("1. Red", "* Red").replace("2. Red", "* Red"),
        licenses.BSD2,
        licenses.CC0.replace("the author", "Jane Doe").replace("this work", "the Work of Art"),
        licenses.MPL.replace("https", "http"),
        licenses.APACHE.replace("http:", "https:"),
        licenses.APACHE.replace("\n\n", "\n"),
        "Neither the name of X nor the names of its contributors may be used to endorse.",
    ]
    got = found(spark, texts)
    assert [got[i].licence for i in range(8)] == ["BSD-3-Clause", "BSD-3-Clause", "BSD-2-Clause", "CC0-1.0", "MPL-2.0", "Apache-2.0", "Apache-2.0", None]
    assert got[0].licences == "BSD-3-Clause" and got[5].rules == "apache-notice"


TITLES = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007"""


def test_titles(spark):
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS"
    got = found(spark, [TITLES, TITLES.replace("GENERAL", "AFFERO GENERAL").replace("29 June", "19 November"), apache, "Mozilla Public License Version 2.0\n====="])
    assert [got[i].licence for i in range(4)] == ["GPL-3.0", "AGPL-3.0", "Apache-2.0", "MPL-2.0"]


def test_sentences_are_normal_told_apart_and_reachable(spark):
    for s in licenses.SENTENCES.values():
        assert s == licenses.normal(s)
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    assert {x for _, _, p in licenses.RULES for x in p.split(" * ")} <= set(licenses.SENTENCES)
    assert len({n for n, _, _ in licenses.RULES}) == len(licenses.RULES) and set(licenses.YIELDS) <= {n for n, _, _ in licenses.RULES}
    names = list(licenses.SENTENCES)
    got = found(spark, [licenses.SENTENCES[n] + "." for n in names])
    assert [got[i].sentence_ids for i in range(len(names))] == names


def test_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")] * 3 + [(None, "x")], "doc_id long, text string")
    assert [r.licence for r in licenses.licence_query(df).orderBy(F.desc("doc_id")).collect()] == ["MIT"] * 3 + [None]
    assert licenses.licence_query(df.limit(0)).collect() == []
    plan = licenses.licence_query(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan

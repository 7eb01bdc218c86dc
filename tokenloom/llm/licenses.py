"""Licence recognition by sentences: known sentences become identifiers, rules match their sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: A sentence ends at a sign before white space, or at the end of its part.
SENTENCE_END = r"[.!?:;]+[ \t\r\n]+"
#: Parts in which sentences are looked for: single lines, and paragraphs, whose lines are joined. A line that holds only
#: the marks of a comment is an empty one.
LINE, PARAGRAPH = r"\r?\n", r"\r?\n[ \t]*(?:[*#;%/|-]+[ \t]*)?\r?\n\s*"
#: Semicolons that begin a line are comment marks, and end no sentence; nor does the colon of a tag.
LEAD = r"(?m)^[ \t]*;+"
TAG, TAG_WORDS = r"SPDX-License-Identifier:[ \t]*", "SPDX-License-Identifier "
#: Names of a tag that are joined are tags of their own, up to four of them.
JOINED = r"(SPDX-License-Identifier [A-Za-z0-9.+-]+) (?:OR|AND) "

#: Public licence texts and notices, by licence. Their sentences are entries of the table, and the rule of a
#: notice is the sequence of its sentences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:"""
BOOST = "Distributed under the Boost Software License, Version 1.0."
ECLIPSE = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."


def gnu(kind: str, version: str, sign: str, what: str = "program") -> str:
    """The notice of a GNU licence; `sign` stands before the version in one of its two styles."""
    return f"""This {what} is free software{":" if sign == "," else ";"} you can redistribute it and/or modify it under the terms of the GNU
{kind} Public License as published by the Free Software Foundation{sign} either version {version} of the License, or (at your
option) any later version."""


NOTICES = (
    ("mit-text", "MIT", MIT),
    ("apache-notice", "Apache-2.0", APACHE),
    *((f"agpl3-notice{n}", "AGPL-3.0-or-later", gnu("Affero General", "3", sign)) for n, sign in (("", ","), ("-2", ";"))),
    *((f"lgpl{v[0]}-notice{n}-{w}", f"LGPL-{v if '.' in v else v + '.0'}-or-later", gnu("Lesser General", v, sign, w)) for v in ("3", "2.1") for n, sign in (("", ","), ("-2", ";")) for w in ("library", "program")),
    *((f"gpl{v}-notice{n}", f"GPL-{v}.0-or-later", gnu("General", v, sign)) for v in ("3", "2") for n, sign in (("", ","), ("-2", ";"))),
    ("bsd3-text", "BSD-3-Clause", BSD3),
    ("bsd2-text", "BSD-2-Clause", BSD2),
    ("isc-text", "ISC", ISC),
    ("0bsd-text", "0BSD", ZERO_BSD),
    ("mpl-notice", "MPL-2.0", MPL),
    ("unlicense-text", "Unlicense", UNLICENSE),
    ("zlib-text", "Zlib", ZLIB),
    ("boost-notice", "BSL-1.0", BOOST),
    ("epl-notice", "EPL-2.0", ECLIPSE),
    ("cc0-notice", "CC0-1.0", CC0),
)

#: One-line statements and titles, normalised, with their licences.
LINES = (
    ("mit-tag", "MIT", "released under the mit license"),
    ("mit-tag-2", "MIT", "licensed under the mit license"),
    ("mit-tag-3", "MIT", "this project is licensed under the mit license"),
    ("mit-tag-4", "MIT", "distributed under the mit license"),
    ("apache-tag", "Apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-tag-2", "Apache-2.0", "released under the apache license version 2 0"),
    ("apache-tag-3", "Apache-2.0", "licensed under the apache license version 2 0 the license"),
    ("apache-tag-4", "Apache-2.0", "licensed under the apache license 2 0"),
    ("agpl-tag", "AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("lgpl-tag", "LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("gpl3-tag", "GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-tag-2", "GPL-3.0", "licensed under the gnu general public license version 3"),
    ("gpl3-tag-3", "GPL-3.0", "licensed under the gnu general public license v3 0"),
    ("gpl2-tag", "GPL-2.0", "licensed under the gnu general public license version 2"),
    ("bsd3-tag", "BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("bsd2-tag", "BSD-2-Clause", "licensed under the bsd 2 clause license"),
    ("isc-tag", "ISC", "licensed under the isc license"),
    ("cc-by-nc-sa-tag", "CC-BY-NC-SA-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-tag", "CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-long", "CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd-tag", "CC-BY-ND-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-sa-tag", "CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-sa-long", "CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-tag", "CC-BY-4.0", "licensed under cc by 4 0"),
    ("cc-by-long", "CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("apache-name", "Apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses"),
    ("agpl3-name", "AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("lgpl3-name", "LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl21-name", "LGPL-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("gpl3-name", "GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("gpl2-name", "GPL-2.0", "gnu general public license version 2 june 1991"),
    ("mpl-name", "MPL-2.0", "mozilla public license version 2 0"),
    ("mit-name", "MIT", "the mit license"),
    ("mit-name-2", "MIT", "mit license"),
    ("mit-name-3", "MIT", "the mit license mit"),
    ("reserved", "proprietary", "all rights reserved"),
)
#: The licence names whose tags are known.
TAGS = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "MPL-2.0", "EPL-2.0", "Unlicense",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0",
)
#: Sentences with a slot for a name or an address, and the entry each stands for.
SLOTS = (
    ("^neither the name of .+ nor the names of (its |any )?contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^(redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer) in the documentation.*$", "\\1 in the documentation and or other materials provided with the distribution"),
    ("^to the extent possible under law .+ has waived all copyright and related or neighboring rights to .+$", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("^if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0$", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("^(you may obtain a copy of the license at )?https? www apache org licenses license 2 0$", "http www apache org licenses license 2 0"),
)
#: A rule yields to others that contain it, or that quote its line.
YIELDS = {"apache-start": ("apache-notice",), "apache-tag-3": ("apache-notice", "apache-start"), "bsd2-text": ("bsd3-text",), "0bsd-text": ("isc-text",), "reserved": ("bsd3-text", "bsd2-text")}


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def cut(notice: str) -> list[str]:
    """The normalised sentences of a notice, as `known_ids` finds them in its paragraphs."""
    found = [normal(x) for part in re.split(PARAGRAPH, notice) for x in re.split(SENTENCE_END, re.sub(LINE, " ", part))]
    for pattern, entry in SLOTS:
        found = [re.sub(pattern, entry, x) for x in found]
    return [x for x in found if not x.replace(" ", "").isdigit() and x]


def _tables() -> tuple[dict[str, str], tuple]:
    """Sentences by identifier, and rules (name, licence, identifiers in order; `*` for any between). Whole notices come
    first, then tags, statements and titles."""
    sentences, ids, rules = {}, {}, []
    for name, licence, notice in NOTICES:
        sequence = []
        for n, sentence in enumerate(cut(notice), 1):
            if sentence not in ids:
                ids[sentence] = f"{name}-{n}"
                sentences[ids[sentence]] = sentence
            sequence.append(ids[sentence])
        rules.append((name, licence, " * ".join(sequence)))
    tags = [(f"spdx-{x.lower()}", x, normal(TAG_WORDS + x)) for x in TAGS]
    rules.append(("apache-start", "Apache-2.0", "apache-notice-1 * apache-notice-2"))
    for name, licence, sentence in (*tags, *LINES):
        if sentence not in ids:
            ids[sentence], sentences[name] = name, sentence
        rules.append((name, licence, ids[sentence]))
    return sentences, tuple(rules)


SENTENCES, RULES = _tables()


def rule_pattern(sequence: str) -> str:
    """Regular expression over ' id id id ': the rule's identifiers in order, any others in between."""
    return " " + " (.* )?".join(sequence.split(" * ")) + " "


def known_ids(text: Column, parts: str, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in their order."""
    table = F.create_map(*[F.lit(x) for name, s in sentences.items() for x in (s, name)])
    cut_up = F.split(F.regexp_replace(text, parts, ". "), SENTENCE_END)
    normal_ones = F.transform(cut_up, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))

    def slotted(s: Column) -> Column:
        for pattern, entry in SLOTS:
            start = "" if pattern.startswith("^(you") else re.match(r"\^\(?([a-z ]+)", pattern)[1].removesuffix(" https")
            filled = F.regexp_replace(s, pattern, entry.replace("\\1", "$1"))
            s = F.when(s.startswith(start), filled).otherwise(s) if start else F.when(s.endswith("www apache org licenses license 2 0"), filled).otherwise(s)
        return s

    known = F.filter(F.transform(normal_ones, slotted), lambda s: s.isin(*sentences.values()))
    return F.transform(known, lambda s: F.element_at(table, s))


def recognise(df: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Add `sentence_ids` (known sentences found line by line, then those found only across lines), `rules` and
    `licences` (comma-joined, in the order of the rules) and `licence` (the first rule's, or null).

    Each text is scanned twice, as lines and as paragraphs, so wrapped licence texts and one-line tags are both
    seen, also inside comments. A rule yields to one that contains it (YIELDS). Everything is an expression of one row: no exchange, and a hot source or group of copies is spread as the
    scan is. Null and empty texts know no sentence; repeated rows are recognised each; an empty table gives an empty one.
    Columns named like the added ones are replaced.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LEAD, ""), TAG, TAG_WORDS)
    for _ in range(3):
        body = F.regexp_replace(body, JOINED, "$1. " + TAG_WORDS)
    lined = df.withColumn("_lines", known_ids(body, LINE, sentences)).withColumn("_joined", known_ids(F.regexp_replace(F.regexp_replace(body, PARAGRAPH, ". \u0000"), LINE, " "), "\u0000", sentences))
    one, other = (F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")) for c in ("_lines", "_joined"))
    hits = F.array(*[F.when(one.rlike(p) | other.rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(licence).alias("licence"))) for n, licence, p in ((n, x, rule_pattern(s)) for n, x, s in rules)])
    some = (F.size("_lines") > 0) | (F.size("_joined") > 0)
    found = lined.withColumn("_all", F.when(some, F.filter(hits, lambda h: h.isNotNull())))
    keeps = lambda h: F.coalesce(~F.array_contains(F.lit(list(YIELDS)), h["rule"]) | ~F.arrays_overlap("_all.rule", element(h["rule"])), F.lit(True))
    element = lambda rule: F.element_at(F.create_map(*[x for k, v in YIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), rule)
    found = found.withColumn("_hits", F.filter("_all", keeps))
    return found.withColumns(
        {
            "sentence_ids": F.array_join(F.concat("_lines", F.filter("_joined", lambda x: ~F.array_contains("_lines", x))), ","),
            "rules": F.coalesce(F.array_join("_hits.rule", ","), F.lit("")),
            "licences": F.coalesce(F.array_join(F.array_distinct("_hits.licence"), ","), F.lit("")),
            "licence": F.get("_hits.licence", F.lit(0)),
        }
    ).drop("_lines", "_joined", "_hits", "_all")


def licence_query(documents: DataFrame) -> DataFrame:
    found = recognise(documents.select("doc_id", "text"))
    return found.select("doc_id", "sentence_ids", "rules", "licences", "licence")


def _sql() -> str:
    values = ", ".join(f"('{s}', '{n}')" for n, s in SENTENCES.items())
    rules = ", ".join(f"({i}, '{n}', '{x}', '{rule_pattern(s)}')" for i, (n, x, s) in enumerate(RULES))
    yields = ", ".join(f"('{k}', '{x}')" for k, v in YIELDS.items() for x in v)
    one = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, entry in SLOTS:
        one = f"regexp_replace({one}, '{pattern}', '{entry}')"
    ids = "list_filter(list_transform(list_transform(string_split_regex({0}, '[.!?:;]+[ \\t\\r\\n]+'), lambda s: " + one + "), lambda s: m[s]), lambda x: x is not null)"
    lines = ids.format("regexp_replace(t, '\\r?\\n', '. ', 'g')")
    body = f"regexp_replace(regexp_replace(coalesce(text, ''), '{LEAD}', '', 'g'), '{TAG}', '{TAG_WORDS}', 'g')"
    for _ in range(3):
        body = f"regexp_replace({body}, '{JOINED}', '\\1. {TAG_WORDS}', 'g')"
    joined = ids.format(f"regexp_replace(regexp_replace(t, '{PARAGRAPH}', '. ', 'g'), '\\r?\\n', ' ', 'g')")
    return f"""
with k(s, id) as (values {values}), g as (select map(list(s), list(id)) as m from k),
r(n, rule, licence, p) as (values {rules}), y(rule, other) as (values {yields}),
d as (select row_number() over () as u, doc_id, {body} as t from documents),
f as (select u, doc_id, {lines} as a, {joined} as b from d, g),
c as (
  select u, n, rule, licence from f, r
  where len(a) + len(b) > 0 and (regexp_matches(' ' || array_to_string(a, ' ') || ' ', p) or regexp_matches(' ' || array_to_string(b, ' ') || ' ', p))
),
h as (
  select u, list(rule order by n) as rules, list(licence order by n) as licences from c
  where not exists (select 1 from y join c o on o.rule = y.other where y.rule = c.rule and o.u = c.u)
  group by u
)
select doc_id, array_to_string(a || list_filter(b, lambda x: not list_contains(a, x)), ',') as sentence_ids,
  coalesce(array_to_string(rules, ','), '') as rules,
  coalesce(array_to_string(list_filter(licences, lambda x, i: list_position(licences, x) = i), ','), '') as licences,
  licences[1] as licence
from f left join h using (u)
"""


SQL = _sql()

"""Brute force, standard notices in all wrappings, statements, denials, other sentences, and a plan without Python."""

import math
import re
import textwrap

import numpy as np
import pytest
import xxhash

from sigilframe.llm import licences as lc

DOCS = "doc_id long, text string, want string"


def scan(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    return lc.scan_licences(df).join(df, "doc_id").collect()


def test_sentences_and_statements_are_found(spark):
    rows = [(f"Some text here.\n{t.capitalize()}.\nAnd more.", f) for f, own in lc.SENTENCES.items() for t in own]
    frames = ("Licensed under the {}.", "The code is made available under the {}, see the file.", "SPDX-License-Identifier: {}", "{} licensed")
    rows += [(f"Some words.\n{frame.format(n.upper())}\nMore words here.", f) for f, own in lc.NAMES.items() for n in own for frame in frames]
    rows += [(t, "") for t in lc.OTHERS]
    out = scan(spark, rows)
    missed = [(r.text, r.want, r.families) for r in out if r.want and r.want not in r.families.split(",")]
    assert len(missed) <= 0.02 * len(rows), missed
    assert not [(r.text, r.families) for r in out if not r.want and r.families]
    more = [r.families for r in out if "," in r.families]
    assert set(more) <= {"public-domain,unlicense"}  # whose text says so
    assert all(f.line == 1 and f.paragraph == 0 and f.probability >= 0.5 and f.match >= 0.8 for r in out for f in r.found)


def test_unseen_wording(spark):
    rows = [
        ("This project is released under the MIT License, see LICENSE.", "mit"),
        ('Licensed under the Apache License, Version 2.0 (the "License")', "apache"),
        ("License: MIT", "mit"),
        ("MIT licensed", "mit"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
        ("Distributed under the GNU LGPL v3.", "lgpl"),
        ("Distributed under the Boost Software License, Version 1.0.", "boost"),
        ("This data is available under a CC BY-SA 4.0 licence.", "cc"),
        ("Licensed under the Eclipse Public License v2.0", "epl"),
        ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "apache,mit"),
        ("The license was MIT.", ""),
        ("Apache helicopters flew over the city under the moon", ""),
        ("This file is not licensed under the MIT license", ""),
        ("The code isn't released under the Apache License, it is no longer distributed under the GPL.", ""),
        ("Licensed under the terms of our own agreement", ""),
        ("Mit der Lizenz unter der Brücke, under the licence of the town", ""),
        ("All rights reserved.", ""),
    ]
    out = scan(spark, rows)
    assert not [(r.text, r.want, r.families) for r in out if r.families != r.want]


def test_planted_lines(spark):
    fixed = {
        "apache": "Licensed under the Apache License, Version 2.0.",
        "cc": "Licensed under CC BY-NC 4.0.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "mit": "Released under the MIT License.",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = lc.scan_licences(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        lines = set(r.text.split("\n"))
        assert r.families == ",".join(sorted(f for f, line in fixed.items() if line in lines))
        assert all(r.text.split("\n")[f.line] == fixed[f.family] for f in r.found)


def test_no_python_and_no_shuffle(spark, odd_docs):
    plan = lc.scan_licences(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd_docs, no_docs):
    rows = lc.scan_licences(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.n_licensed == 0 for r in rows)
    blank = [r.n_paragraphs for r in rows if r.doc_id in (2, 3, 4)]
    assert blank == [0, 0, 0]
    assert lc.scan_licences(no_docs).count() == 0
    spark = no_docs.sparkSession
    twice = scan(spark, [("Released under the MIT License.\n \n# \nReleased under the MIT License.\nReleased under the MIT License.", "")])[0]
    assert (twice.n_paragraphs, twice.n_licensed, twice.families) == (2, 2, "mit")
    assert [(f.paragraph, f.line) for f in twice.found] == [(0, 0), (1, 3)]
    long = scan(spark, [("word " * 200_000 + "\nReleased under the MIT License.\n" + "more\n" * 50_000, "")])[0]
    assert long.families == "mit" and long.n_paragraphs == 1


#: Notices as they are published; none of them is a line of the templates.
NOTICES = {
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. You should have received a copy of the GNU General Public License along with this program.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. You
should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Foundation.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software. The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.""",
}


def test_notices_in_all_wrappings(spark):
    rows = []
    for family, text in NOTICES.items():
        for width in (30, 45, 60, 72, 78, 10_000):
            for lead in ("", " * ", "# ", "// ", ";; ", "-- "):
                wrapped = textwrap.fill(" ".join(text.split()), width, initial_indent=lead, subsequent_indent=lead)
                rows.append((f"Some words first.\n{wrapped}\nOther words.", family))
    rows.append(("This work is under\n\nway, the GNU general", ""))  # words on both sides of a blank line
    rows.append(("Released under the\n\nMIT License.", ""))
    out = scan(spark, rows)
    assert not [(r.want, r.text, r.families) for r in out if r.families != r.want]
    assert all(len(r.found) == 1 and r.found[0].match >= 0.8 for r in out if r.want)


def plain(text, model, slot_of, confirm=0.8, least=0.5):
    """Passages one by one, in Python."""
    weights = {}
    for gram, w in zip(model.grams, model.weights):
        weights[slot_of(gram)] = weights.get(slot_of(gram), 0) + w
    lines = (text or "").lower().split("\n")
    has_word = [bool(re.search("[a-z0-9]", x)) for x in lines]
    starts = [i for i, h in enumerate(has_word) if h and not (i and has_word[i - 1])]
    found = {}
    for number, start in enumerate(starts):
        words = []
        for i in range(start, len(lines)):
            if not has_word[i]:
                break
            words += [(w.strip("."), i) for w in re.findall("[a-z0-9.]+", lines[i]) if w.strip(".")]
        for at, (w, line) in enumerate(words):
            if not re.match(lc.ANCHOR, w):
                continue
            for reach in (lc.NEAR, lc.FAR):
                passage = [x for x, _ in words[max(0, at - reach) : at + reach + 1]]
                pairs = set(zip(passage, passage[1:]))
                slots = {slot_of(g) for g in [*passage, *(" ".join(p) for p in pairs)]}
                z = model.bias + sum((weights[s] for s in slots if s in weights), np.zeros(len(model.bias)))
                p = 1 / (1 + np.exp((z[-1] - z[:-1]) / model.temperature))
                hits = []
                if reach == lc.NEAR:
                    joined = f" {' '.join(passage)} "
                    for k, family in enumerate(model.classes[:-1]):
                        if p[k] >= least and re.search(lc.statement(family), joined) and not re.search(lc.denial(family), joined):
                            hits.append((family, p[k], 1.0))
                elif p.max() >= least:
                    family = model.classes[int(p.argmax())]
                    of = [[tuple(x.split(" ")) for x in lc.pairs_of(lc.words_of(t))] for t in lc.SENTENCES[family]]
                    match = max(sum(x in pairs for x in t) / len(t) for t in of)
                    if match >= confirm:
                        hits.append((family, p.max(), match))
                for family, v, match in hits:
                    key = number, family
                    found[key] = min(found.get(key, (math.inf,)), (line, round(v, 5), round(match, 9)))
    return len(starts), sorted((n, *rest, f) for (n, f), rest in found.items())


def test_scan_equals_brute_force(spark):
    rows = [(r.text, "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(f"First words.\n\n{t}\nLicense: MIT\n\n\nMore under the licence.\n{t[:200]}", "") for t in NOTICES.values()]
    rows += [(" / ".join(lc.OTHERS), ""), ("\n".join(lc.OTHERS[::-1]), ""), (None, ""), ("", "")]
    model = lc.train()
    slot_of = lambda g: xxhash.xxh64(g.encode(), seed=42).intdigest() % lc.BUCKETS
    some = 0
    for r in scan(spark, rows):
        n, want = plain(r.text, model, slot_of)
        got = sorted((f.paragraph, f.line, round(f.probability, 5), round(f.match, 9), f.family) for f in r.found)
        assert r.n_paragraphs == n and [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want], r.text[:300]
        assert all(abs(g[2] - w[2]) < 1e-3 for g, w in zip(got, want))
        some += len(want)
    assert some > 20


def test_held_out_templates_are_calibrated():
    """What is left out whole is told from unknown, with probabilities that mean something."""
    model = lc.train()
    assert 0.05 < model.temperature < 20 and model.classes[-1] == lc.UNKNOWN  # not at the edge of the grid
    data = lc.examples()
    assert len({k for _, _, k in data}) > 300 and {c for _, c, _ in data} == set(model.classes)


@pytest.mark.parametrize("family", sorted(lc.NAMES))
def test_patterns_are_linear(family):
    """Bounded repeats only, on passages of a few words."""
    assert re.search(lc.statement(family), f" licensed under the {lc.NAMES[family][0]} ")
    assert re.search(lc.denial(family), f" it is not licensed under the {lc.NAMES[family][0]} ")
    assert "*" not in lc.statement(family)

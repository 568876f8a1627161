"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a run of lines with words; its lines are joined, as notices are wrapped, and marks of comments fall away
with all that is neither letter nor digit. Passages are the words around each anchor (a word such as `license`,
`redistribution` or `gpl`) in a paragraph: NEAR words on both sides for statements that name a licence, FAR for
sentences of licences. The words and pairs of neighbouring words of a passage are hashed to features; a logistic
regression with one output for each licence family and one for `unknown` gives probabilities. They are calibrated by a
temperature and a bias of the unknown class, fitted on templates that training left out whole, with all their variants.
What they call more probable than unknown is confirmed by comparison with the family's templates. A statement is
confirmed if a name of the family follows a phrase such as `released under the`, without a negation; so a passage may
state several licences. A sentence is confirmed if it is one of the most probable family, as those of some families
differ in a word, and enough of its pairs of neighbouring words stand in the passage. Only confirmed families count,
once in a paragraph.

The regression is fitted on the driver, on the templates below in some variants and on other sentences, so its size is
fixed. Scoring is one projection over documents: nothing is shuffled, and the weights are literals of the plan. Texts
without an anchor are told by one regular expression, and cut no further.

Defined results: a null or empty text has no paragraphs; repeated rows get equal results; an empty table gives an
empty result; extra columns are not looked at; whole texts are scanned, however long. Reserved rights are no family.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Names of licences, as works write them.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl", "agplv3"),
    "apache": ("apache license", "apache software license", "apache 2.0", "apache"),
    "artistic": ("artistic license", "perl artistic license", "artistic"),
    "boost": ("boost software license", "bsl 1.0"),
    "bsd": ("bsd license", "3 clause bsd", "2 clause bsd", "bsd 3 clause", "bsd 2 clause", "new bsd license", "simplified bsd license", "bsd"),
    "cc": ("creative commons attribution", "cc by"),
    "cc0": ("cc0", "creative commons zero", "creative commons cc0"),
    "cddl": ("common development and distribution license", "cddl"),
    "epl": ("eclipse public license", "epl"),
    "eupl": ("european union public licence", "eupl"),
    "gfdl": ("gnu free documentation license", "gfdl"),
    "gpl": ("gnu general public license", "gnu gpl", "gpl", "gplv2", "gplv3"),
    "isc": ("isc license", "isc"),
    "lgpl": ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl", "lgplv2.1", "lgplv3"),
    "mit": ("mit license", "expat license", "mit"),
    "mpl": ("mozilla public license", "mpl"),
    "ofl": ("sil open font license", "open font license", "ofl"),
    "psf": ("python software foundation license", "psf license", "psf"),
    "public-domain": ("public domain",),
    "unlicense": ("unlicense",),
    "wtfpl": ("do what the fuck you want to public license", "wtfpl"),
    "zlib": ("zlib license", "zlib"),
}
#: Sentences of licences and of the notices that they ask for.
SENTENCES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
    ),
    "apache": (
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ),
    "artistic": ("this is free software you can redistribute it and or modify it under the same terms as perl itself",),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "cc": (
        "this work is licensed under a creative commons attribution 4.0 international license",
        "to view a copy of this license visit http creativecommons.org licenses by 4.0 or send a letter to creative commons",
    ),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license",),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license",),
    "eupl": ("you may not use this work except in compliance with the licence you may obtain a copy of the licence at joinup.ec.europa.eu",),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "the software is provided as is and the author disclaims all warranties with regard to this software",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    ),
    "ofl": ("this font software is licensed under the sil open font license version 1.1",),
    "psf": ("the python software foundation hereby grants licensee a nonexclusive royalty free world wide license",),
    "public-domain": ("this work is released into the public domain", "this file is hereby placed in the public domain"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "wtfpl": ("this program is free software it comes without any warranty you just do what the fuck you want to",),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
}
#: Sentences of no licence, some with words that licences use.
OTHERS = (
    "the license plate of the car was not readable",
    "he lost his driving license under the bridge last year",
    "the licensed taxi drivers of the city are available under this number",
    "her fishing licence was released to the press under her name",
    "this work is under way and will be released in spring",
    "version 2.0 of the game was released on friday",
    "the general public is free to visit the museum",
    "students at mit built a small satellite",
    "the license was mit",
    "the apache were a people of the southwest",
    "apache helicopters flew over the city under the moon",
    "all rights reserved by the management of the hotel",
    "copies of the report are available at the front desk",
    "the software update is provided to all users of the phone",
    "a creative idea needs a common language",
    "the above notice was posted in the hall",
    "the permission of the owner is required to enter",
    "the foundation published its terms and conditions for the prize",
    "please contact the copyright holder for a license to use this photograph",
    "he was granted permission to leave free of charge",
    "the library is open to the public without charge",
    "the public domain of the town was sold to a company",
    "the domain name is available under a new owner",
    "a boost of the economy was expected under the government",
    "the warranty of the washing machine covers two years",
    "products are sold with a warranty and without any other liability",
    "the eclipse was visible under a clear sky",
    "an artistic gymnast trained under her coach",
    "the redistribution of income is a question of policy",
    "the terms of the agreement were not made public",
    "it is the first of the many and the last of the few",
    "as it was in the beginning so it is with this one",
    "copyright law protects the authors of books and songs",
    "der mann und die frau sind mit dem hund in dem haus",
    "le chat est sur la table et le chien est dans la cour",
    "la casa de la playa es de los abuelos",
    "the and of to in is with for that on by it as are was be this from or an at",
)
VERBS = "licensed licenced released distributed available published provided covered redistributed issued offered shipped made".split()
LABELS = ("license", "licence", "licenses", "license identifier")
DENIALS = "not never isn aren wasn weren longer neither nor cannot".split()
#: Beginnings of the words that passages are looked for around.
ANCHORS = (
    "licen[cs]e unlicense spdx [al]?gpl mpl gfdl bsd bsl cc creative mozilla apache redistribut permi[ts] copyright warrant domain "
    "wtfpl epl eupl cddl artistic boost zlib expat psf ofl isc eclipse unencumbered foundation"
).split()
BUCKETS = 1 << 16
NEAR, FAR = 15, 30
WORD_SPLIT = "[^a-z0-9.]+"
HAS_WORD = "[a-z0-9]"
ANCHOR = f"(?:{'|'.join(ANCHORS)})"
#: Between a paragraph and the next, in the flat list of words.
BARRIER = "|"


@dataclass
class LicenceModel:
    """weights: (gram, family) of the grams seen in training; the last of the classes is unknown. bias includes the
    calibration of the unknown class."""

    classes: list[str]
    grams: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def words_of(text: str) -> list[str]:
    """As the scan cuts words: runs of letters, digits and dots, without dots at the ends."""
    cut = (w.strip(".") for w in re.split(WORD_SPLIT, text.lower()))
    return [w for w in cut if w]


def pairs_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def grams_of(words: list[str]) -> list[str]:
    return sorted({*words, *pairs_of(words)})


def statement(family: str) -> str:
    """Regular expression, over words joined and enclosed by single spaces, of a statement that names the licence."""
    names = "|".join(n.replace(".", "[.]") for n in NAMES[family])
    name = rf"(?:{names}) "
    under = rf"(?:{'|'.join(VERBS)}) (?:[^ ]+ ){{0,4}}(?:under|into) (?:[^ ]+ ){{0,5}}?{name}"
    return rf" (?:{under}|(?:{'|'.join(LABELS)}) {name}|{name}licensed )"


def denial(family: str) -> str:
    return rf" (?:{'|'.join(DENIALS)}) (?:[^ ]+ )?{statement(family)[1:]}"


def examples() -> list[tuple[list[str], str, int]]:
    """(words, family, template). Of a template: whole, between strangers, without every eighth word from some starts.
    Other sentences as they are, backwards and in halves, and statements of no known licence."""
    out: list[tuple[list[str], str, int]] = []
    templates = [(s, f) for f, own in SENTENCES.items() for s in own]
    openings = ("licensed under the", "this project is released under the", "distributed under the terms of the", "license", "spdx license identifier")
    templates += [(f"{o} {n}{v}", f) for f, own in NAMES.items() for n in own for o, v in zip(openings, ("", " version 2.0", "", " 1.0", " 3.0 or later"))]
    templates += [(f"{n} licensed", f) for f, own in NAMES.items() for n in own]
    for k, (t, family) in enumerate(templates):
        w = words_of(t)
        before, after = words_of(OTHERS[k % len(OTHERS)]), words_of(OTHERS[(7 * k + 3) % len(OTHERS)])
        out += [(w, family, k), (["notice", *w, "see", "file", "for", "details"], family, k), ([*before, *w, *after], family, k)]
        if len(w) > 7:
            out += [([x for i, x in enumerate(w) if i % 8 != at], family, k) for at in (1, 4, 6)]
    others = [*OTHERS, *(f"{o} {x}" for o in openings[:3] for x in ("agreement of the parties", "rules of the house", "name of the author"))]
    for k, t in enumerate(others, len(templates)):
        w = words_of(t)
        out += [(w, UNKNOWN, k), (w[::-1], UNKNOWN, k), (w[: len(w) // 2 + 1], UNKNOWN, k), (w[len(w) // 2 :], UNKNOWN, k)]
    return out


@lru_cache(maxsize=1)
def train(rounds: int = 150, decay: float = 1e-4, folds: int = 3) -> LicenceModel:
    """Multinomial logistic regression by Nesterov's method. Temperature and the bias of the unknown class make the
    templates of a fold most likely, by the weights that the other folds give."""
    classes = [*NAMES, UNKNOWN]
    data = examples()
    grams = sorted({g for w, _, _ in data for g in grams_of(w)})
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(data), len(grams)), np.float32)
    y = np.zeros((len(data), len(classes)), np.float32)
    for i, (w, c, _) in enumerate(data):
        x[i, [place[g] for g in grams_of(w)]] = 1
        y[i, classes.index(c)] = 1
    prob = lambda z: (e := np.exp(z - z.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)

    def fit(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every class gets the same weight in all."""
        seen, target = x[use], y[use]
        each = (target / np.maximum(target.sum(axis=0), 1)).sum(axis=1)[:, None] / len(classes)
        w = ahead = np.zeros((len(grams), len(classes)), np.float32)
        b = ahead_b = np.zeros(len(classes), np.float32)
        step = np.float32(2.0 / (float((each[:, 0] * seen.sum(axis=1)).sum()) + decay))
        for k in range(rounds):
            pull = each * (prob(seen @ ahead + ahead_b) - target)
            new, new_b = ahead - step * (seen.T @ pull + decay * ahead), ahead_b - step * pull.sum(axis=0)
            push = np.float32(k / (k + 3))
            ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
            w, b = new, new_b
        return w, b

    fold = np.array([k % folds for _, _, k in data])
    z = np.zeros(y.shape)
    for f in range(folds):
        w, b = fit(fold != f)
        z[fold == f] = x[fold == f] @ w + b

    def loss(t: float, shift: float) -> float:
        moved = z / t
        moved[:, -1] += shift
        return -float(np.log(np.maximum((prob(moved) * y).sum(axis=1), 1e-12)).mean())

    _, temperature, shift = min((loss(t, s), t, s) for t in np.geomspace(0.05, 20, 40) for s in np.linspace(-3, 3, 25))
    w, b = fit(np.ones(len(data), bool))
    b[-1] += temperature * shift
    return LicenceModel(classes, grams, w.round(4).astype(np.float64), b.astype(np.float64), float(temperature))


def literal_array(values: list, kind: str) -> Column:
    """An array as one literal: a joined string that the optimizer splits and casts once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def let(value: Column, body) -> Column:
    """Binds a value inside a lambda, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, WORD_SPLIT), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def paragraph_starts(lines: Column) -> Column:
    """Numbers of the lines that begin a paragraph: they have a word, and the one before has none."""
    begins = lambda line, i: F.when(line.rlike(HAS_WORD) & ~F.coalesce(F.get(lines, i - 1).rlike(HAS_WORD), F.lit(False)), i)
    return F.filter(F.transform(lines, begins), lambda i: i.isNotNull())


class Scan:
    """The expressions of a scan. slots: the grams' numbers, by the hash that the scan uses."""

    def __init__(self, model: LicenceModel, slots: list[int], confirm: float, least: float):
        self.model, self.confirm, self.least = model, confirm, least
        merged: dict[int, np.ndarray] = {}
        for slot, w in zip(slots, model.weights, strict=True):
            merged[slot] = merged.get(slot, 0) + w
        rows = {slot: i + 1 for i, slot in enumerate(sorted(merged))}
        self.index = literal_array([rows.get(i, 0) for i in range(BUCKETS)], "int")
        self.per_class = [
            literal_array([0.0, *(round(float(merged[s][c]), 4) for s in sorted(merged))], "double") for c in range(len(model.classes))
        ]
        families = model.classes[:-1]
        self.families = F.array(*map(F.lit, model.classes))
        self.statements = F.array(*[F.lit(statement(f)) for f in families])
        self.denials = F.array(*[F.lit(denial(f)) for f in families])
        templates = [F.array(*[F.split(F.lit(",".join(pairs_of(words_of(t)))), ",") for t in SENTENCES[f]]) for f in families]
        self.templates = F.array(*templates)

    def odds(self, words: Column, use) -> Column:
        """use(probability of each family against unknown, pairs of words)."""
        n = F.size(words)
        first = lambda at: F.slice(words, at, F.greatest(n - 1, F.lit(1)))
        pairs = F.when(n > 1, F.zip_with(first(1), first(2), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
        slot = lambda g: F.get(self.index, F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))

        def scored(active: Column, pairs: Column) -> Column:
            score = lambda c: F.aggregate(active, F.lit(float(self.model.bias[c])), lambda s, k: s + F.get(self.per_class[c], k))
            unknown = score(len(self.model.classes) - 1)
            against = lambda u: F.array(*[1 / (1 + F.exp((u - score(c)) / self.model.temperature)) for c in range(len(self.model.classes) - 1)])
            return let(let(unknown, against), lambda p: use(p, pairs))

        # a gram counts once in a passage; those without weight are left out before anything is added
        active = lambda pairs: F.array_distinct(F.filter(F.transform(F.concat(words, pairs), slot), lambda k: k > 0))
        return let(pairs, lambda p: let(active(p), lambda a: scored(a, p)))

    def passage(self, words: Column, at: Column, reach: int) -> Column:
        """Words from `reach` before to `reach` after a place, of the same paragraph, joined by spaces."""
        before = F.array_join(F.slice(words, F.greatest(at - reach + 1, F.lit(1)), F.least(at, F.lit(reach))), " ")
        after = F.array_join(F.slice(words, at + 1, reach + 1), " ")
        return F.trim(F.concat(F.substring_index(before, BARRIER, -1), F.lit(" "), F.substring_index(after, BARRIER, 1)))

    def hit(self, at: Column, p: Column, match: Column) -> Column:
        return F.struct(F.get(self.families, at).alias("family"), p.alias("probability"), match.alias("match"))

    def of_statement(self, passage: Column) -> Column:
        def judged(p: Column, pairs: Column) -> Column:
            text = F.concat(F.lit(" "), passage, F.lit(" "))

            def named(v: Column, at: Column) -> Column:
                stated = F.rlike(text, F.get(self.statements, at)) & ~F.rlike(text, F.get(self.denials, at))
                return F.when((v >= self.least) & stated, self.hit(at, v, F.lit(1.0)))

            return F.transform(p, named)

        return self.odds(F.split(passage, " "), judged)

    def of_sentence(self, passage: Column) -> Column:
        def judged(p: Column, pairs: Column) -> Column:
            share = lambda t: F.size(F.array_intersect(t, pairs)) / F.size(t)
            match = lambda at: F.array_max(F.transform(F.get(self.templates, at), share))
            best = lambda top: F.array_position(p, top).cast("int") - 1
            told = lambda at, top: let(match(at), lambda m: F.when(m >= self.confirm, self.hit(at, top, m)))
            return F.array(let(F.array_max(p), lambda top: F.when(top >= self.least, let(best(top), lambda at: told(at, top)))))

        return self.odds(F.split(passage, " "), judged)

    def of_lines(self, lines: Column, starts: Column) -> Column:
        """Hits of a text with an anchor."""
        blank = F.array(F.lit(BARRIER))
        own = F.transform(lines, lambda line: let(cut(line), lambda w: F.when(F.size(w) > 0, w).otherwise(blank)))

        def of_words(words: Column, at_line: Column) -> Column:
            anchors = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(f"^{ANCHOR}"), i)), lambda i: i.isNotNull())

            def around(i: Column) -> Column:
                line = F.get(at_line, i)
                place = lambda h: F.struct(
                    (F.size(F.filter(starts, lambda s: s <= line)) - 1).cast("int").alias("paragraph"),
                    h["family"].alias("family"),
                    line.cast("int").alias("line"),
                    h["probability"].alias("probability"),
                    h["match"].alias("match"),
                )
                near = let(self.passage(words, i, NEAR), self.of_statement)
                far = let(self.passage(words, i, FAR), self.of_sentence)
                return F.transform(F.filter(F.concat(near, far), lambda h: h.isNotNull()), place)

            return F.array_sort(F.flatten(F.transform(anchors, around)))

        lined = F.flatten(F.transform(own, lambda w, i: F.transform(w, lambda _: i)))
        return let(own, lambda own: of_words(F.flatten(own), lined))

    def column(self, text: Column) -> Column:
        """array of (paragraph, line, family, probability, match), one for each paragraph and family."""

        def once(hits: Column) -> Column:
            other = lambda h, i: (i == 0) | (h["paragraph"] != F.get(hits, i - 1)["paragraph"]) | (h["family"] != F.get(hits, i - 1)["family"])
            kept = F.transform(F.filter(hits, other), lambda h: F.struct(*[h[c].alias(c) for c in ("paragraph", "line", "family", "probability", "match")]))
            return F.array_sort(kept)

        found = let(F.split(text, "\n"), lambda lines: let(paragraph_starts(lines), lambda s: let(self.of_lines(lines, s), once)))
        none = F.array().cast("array<struct<paragraph:int,line:int,family:string,probability:double,match:double>>")
        return F.when(text.rlike(rf"(?<![a-z0-9.]){ANCHOR}"), found).otherwise(none)


def scan_licences(
    docs: DataFrame, confirm: float = 0.8, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the id, n_paragraphs, n_licensed, families (sorted), and `found`, an array with the details.

    confirm: share of a sentence's pairs of words that must stand in the passage; least: probability of the family.
    """
    model = train()
    grams = F.split(F.lit("\n".join(model.grams)), "\n")
    hashed = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))
    slots = docs.sparkSession.range(1).select(hashed.alias("slots")).first()["slots"]
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = Scan(model, slots, confirm, least).column(text)
    paragraphs = let(F.split(text, "\n"), lambda lines: F.size(paragraph_starts(lines)))
    return docs.select(id_col, paragraphs.cast("long").alias("n_paragraphs"), found.alias("found")).select(
        id_col,
        "n_paragraphs",
        F.size("found").cast("long").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",").alias("families"),
        "found",
    )

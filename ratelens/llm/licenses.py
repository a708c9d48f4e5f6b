"""License scans: Dice coefficient over word bigrams against templates. DataFrame operations only.

A text's units are its lines, and its paragraphs of more than one line. A unit is normalised to
lower-case words and compared with each template by the Dice coefficient of their sets of word bigrams;
``threshold`` or more is a match; a unit matches its best template only. With threshold t, a template of b bigrams can only match units of
b t / (2 - t) to b (2 - t) / t bigrams: other templates are pruned before any bigram is compared.

Licenses that no line or paragraph shows are looked for in windows of the whole text: as many bigrams as the template
has, from each place where one of them stands. Only templates of whose bigrams the text has enough anywhere are tried.

Versions and variants differ in a word or two, which a coefficient doesn't tell. So a unit or window matches only templates
with the same telling bigrams, such as "version 2", "lesser general" or "neither the" (``TELLING``): what names another
version is not named at all unless its own template fits. Wording that licenses share is no template.

Texts without a key word are skipped. Key words are chosen so that no match is lost: a match shares at
least b t / (2 - t) bigrams with the template, and for every template fewer bigrams than that are free
of key words (``key_words`` sees to it).

The scan is one projection: no shuffle, no explode; a document never meets another.

Defined results: null and empty texts, and texts without a match, have no licenses, 0 hits and a null
best license and score. An empty table gives no rows. Ties of the best score go to the first license by name. A license that
windows show counts as one hit. Repeated rows give equal results. Very long texts are arrays of lines and of words in
one row. Other columns pass through; one of the result's name is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import free_name, lower_ascii

#: Notices by SPDX name; fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
)
#: Standard headers and first paragraphs, worded as published, with those that tell versions apart. Paragraphs that several licenses share are left out.
_FSF = "This %s is free software%s you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software Foundation%s either version %s of the License, or (at your option) any later version."
STANDARD: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", _FSF % ("program", ";", "General Public License", ";", "2")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", _FSF % ("program", ":", "General Public License", ",", "3")),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-2.1", _FSF % ("library", ";", "Lesser General Public License", ";", "2.1")),
    ("LGPL-3.0", _FSF % ("library", ":", "Lesser General Public License", ",", "3")),
    ("LGPL-3.0", _FSF % ("program", ":", "Lesser General Public License", ",", "3")),
    ("AGPL-3.0", _FSF % ("program", ":", "Affero General Public License", ",", "3")),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
THRESHOLD = 0.8
#: Bigrams that tell a version or variant.
TELLING = r"^(?:(?:version|v|by|cc) \d+|\d+ \d+|\d+ clause|by (?:sa|nc|nd)|(?:lesser|affero|library) general|attribution (?:sharealike|noncommercial|noderivatives)|neither the)$"
#: What separates words, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Frequent words that can't be key words.
COMMON = frozenset("a an and any are as at be by can charge copy file following for form forms free from general in into is it later may met modify not of on or person program project public provided source subject terms that the this to under use version with without work you".split())


def bigrams(text: str) -> list[str]:
    words = [w for w in re.split(GAP, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def telling(grams: list[str]) -> list[str]:
    return sorted(g for g in grams if re.match(TELLING, g, re.ASCII))


def key_words(grams: list[list[str]], threshold: float) -> list[str]:
    """Words such that every match of every template holds one: a greedy choice, long words first."""
    need = [len(g) * threshold / (2 - threshold) - 1e-9 for g in grams]
    out: list[str] = []
    while True:
        free = [[x for x in g if not set(x.split()) & set(out)] for g in grams]
        open_ = [f for f, n in zip(free, need, strict=True) if len(f) >= n]
        if not open_:
            return out
        gain: dict[str, int] = {}
        for f in open_:
            for w in {w for x in f for w in x.split()} - COMMON - set(out):
                gain[w] = gain.get(w, 0) + sum(w in x.split() for x in f) * (1 if len(w) > 3 else 1e-4 if w.isdigit() else 1e-2)
        best = min(gain, key=lambda w: (-gain[w], w), default="")
        if not best or not gain[best]:
            raise ValueError("a template has too few words that aren't common")
        out.append(best)


def better(a: Column, m: Column) -> Column:
    """The match of the higher score, of equals the first by name."""
    return F.when(a["dice"].isNull() | (m["dice"] > a["dice"]) | ((m["dice"] == a["dice"]) & (m["name"] < a["name"])), m).otherwise(a)


def grams_of(text: Column) -> Column:
    """The bigrams of a text, in order."""
    w = F.split(F.trim(F.regexp_replace(lower_ascii(text), GAP, " ")), " ")
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def telling_of(grams: Column) -> Column:
    return F.array_sort(F.filter(grams, lambda g: g.rlike(TELLING)))


def overlap(g: Column, t: Column) -> Column:
    """struct<dice, name> of distinct bigrams and a template."""
    return F.struct((F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice"), t["name"].alias("name"))


NOTHING = lambda: F.struct(F.lit(None).cast("double").alias("dice"), F.lit(None).cast("string").alias("name"))


def known_templates(templates: tuple[tuple[str, str], ...], threshold: float) -> Column:
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    held = []
    for name, text in templates:
        g = bigrams(text)
        fields = {"name": F.lit(name), "grams": F.array(*map(F.lit, g)), "telling": F.array(*map(F.lit, telling(g))).cast("array<string>"), "n": F.lit(len(g)), "low": F.lit(len(g) * low - 1e-9), "high": F.lit(len(g) * high + 1e-9)}
        held.append(F.struct(*(c.alias(n) for n, c in fields.items())))
    return F.array(*held)


def in_windows(text: Column, known: Column, threshold: float) -> Column:
    """array<struct<dice, name>>: of each template the best window of its size that matches."""

    def best(all_: Column, t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1))), lambda i: F.array_contains(t["grams"], F.get(all_, i - 1)))
        windows = F.filter(F.transform(starts, lambda i: F.array_distinct(F.slice(all_, i, t["n"]))), lambda g: telling_of(g) == t["telling"])
        return F.aggregate(F.transform(windows, lambda g: overlap(g, t)), NOTHING(), better)

    def found(all_: Column) -> Column:
        likely = F.filter(known, lambda t: F.size(F.array_intersect(all_, t["grams"])) >= t["n"] * threshold / (2 - threshold) - 1e-9)
        return F.filter(F.transform(likely, lambda t: best(all_, t)), lambda m: m["dice"] >= threshold - 1e-12)

    return F.get(F.transform(F.array(grams_of(text)), found), F.lit(0))


def matches(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<dice, name>>: the best template of each unit that has one, then licenses that only windows show, one each."""
    grams = [bigrams(t) for _, t in templates]
    known = known_templates(templates, threshold)
    pattern = "(?i)(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, key_words(grams, threshold))) + ")(?![A-Za-z0-9])"
    most = int(max(map(len, grams)) * (2 - threshold) / threshold + 1)
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n", -1)
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n\s*", -1), lambda u: u.contains("\n"))
    units = F.filter(F.concat(lines, paragraphs), lambda u: u.rlike(pattern))
    pairs = F.filter(F.transform(units, lambda u: F.array_distinct(grams_of(u))), lambda g: (F.size(g) > 0) & (F.size(g) <= most))

    def best_of(g: Column) -> Column:
        near = F.filter(known, lambda t: (F.size(g) >= t["low"]) & (F.size(g) <= t["high"]) & (telling_of(g) == t["telling"]))
        return F.aggregate(F.transform(near, lambda t: overlap(g, t)), NOTHING(), better)

    by_unit = F.filter(F.transform(pairs, best_of), lambda m: m["dice"] >= threshold - 1e-12)

    def with_windows(own: Column) -> Column:
        new = F.filter(in_windows(text, known, threshold), lambda m: ~F.exists(own, lambda o: o["name"] == m["name"]))
        names = F.array_distinct(F.transform(new, lambda m: m["name"]))
        return F.concat(own, F.transform(names, lambda n: F.aggregate(F.filter(new, lambda m: m["name"] == n), NOTHING(), better)))

    found = F.get(F.transform(F.array(by_unit), with_windows), F.lit(0))
    none = F.array().cast("array<struct<dice:double,name:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def summary(found: Column) -> Column:
    """struct<hits, licenses, best_license, best_dice> of a text's matches."""
    best = F.aggregate(found, NOTHING(), better)
    return F.struct(F.size(found).cast("long").alias("hits"), F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["name"]))), ",").alias("licenses"), best["name"].alias("best_license"), best["dice"].alias("best_dice"))


def scanned(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, column: str = "license_scan") -> DataFrame:
    """The rows with a struct column of hits, licenses, best_license and best_dice."""
    mark = free_name(docs, "_ratelens_matches")
    rows = docs.select("*", F.explode(F.array(matches(F.col(text), templates, threshold))).alias(mark))  # a generator: else each field of the summary would scan the text anew
    return rows.withColumn(column, summary(F.col(mark))).drop(mark)

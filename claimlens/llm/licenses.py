"""License scan in DataFrame functions only: normalised text compared to licence templates by Dice coefficient over
word bigrams; size bounds prune the templates a text can match.

A text's normal form is lower case with every run of other than a-z and 0-9 as one space, so line ends don't matter. Its
units are the whole text and, for each template, windows as long as the template, laid over the text where an anchor
stands: a bigram of the template with a cue word in it, at its first place there. So a licence is found wherever it
begins, in a file of its own, wrapped over lines before code, or within a sentence. Cue words are the fewest that occur in
every template CUES times (or as often as it has words); a text without any has no unit. A unit's set is its distinct
bigrams; Dice >= t needs a set size between t/(2-t) and (2-t)/t times the template's. Full texts of the long licences are
found by their titles. All of it is a projection of the row: nothing is shuffled, and a text needs memory for itself
only."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.common import documents

THRESHOLD = 0.8
#: Places of cue words in each template.
CUES = 3

# fixed values: notices, grants and titles of public licences
TEMPLATES = {
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "CC0-1.0": (
        "Creative Commons CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT).",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}


def words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(found: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, words) of every template, in order; templates of one word have no bigram and are left out."""
    return [(name, w) for name, texts in sorted(templates.items()) for t in texts if len(w := words(t)) > 1]


def cue_words(templates: list[tuple[str, list[str]]], places: int = CUES) -> list[str]:
    """Words, few and long, of which every template has `places` places (or as many as it has words): again and again the
    word that the most templates still lack; of those the longest."""
    cues: list[str] = []
    while True:
        gain: dict[str, int] = {}
        for _, w in templates:
            if sum(x in cues for x in w) < min(places, len(w)):
                for x in set(w) - set(cues):
                    gain[x] = gain.get(x, 0) + 1
        if not gain:
            return cues
        cues.append(max(gain, key=lambda x: (len(x) > 4, gain[x], len(x), x)))


def anchors(templates: list[tuple[str, list[str]]], cues: list[str]) -> dict[str, list[tuple[int, int]]]:
    """bigram with a cue word: (number of a template, first place in it) of all templates that have it."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t, (_, w) in enumerate(templates):
        seen = set()
        for at, (a, b) in enumerate(zip(w, w[1:], strict=False)):
            if (a in cues or b in cues) and (a, b) not in seen:
                seen.add((a, b))
                found.setdefault(f"{a} {b}", []).append((t, at))
    return found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_hits (licences of which a template is found), licenses (their names, in order, comma-joined; empty without
    any) and license, dice, start and words of the best hit (highest Dice, then the longest unit, then the first, then
    the first template; start counts words from 0) of every row; those are null without a hit, so also for null and empty
    texts. A licence whose template is much like another's may be found with it. Other columns aren't read."""
    known = template_words(templates)
    if not known:
        known = [("", ["", ""])]  # no text has an empty word, so nothing is found
    sets = [sorted(set(bigrams(w))) for _, w in known]
    cues = cue_words(known)
    places = anchors(known, cues)
    # as SQL text, since thousands of literals one by one take the driver seconds
    listed = lambda found: f"array({', '.join(map(str, found))})"
    names, sizes, spans = F.array(*(F.lit(n) for n, _ in known)), F.expr(listed(map(len, sets))), F.expr(listed(len(w) - 1 for _, w in known))
    bags = F.expr(listed(f"split('{'|'.join(b)}', '[|]')" for b in sets))
    where = "map(" + ", ".join(f"'{b}', " + listed(f"struct({t} as t, {at} as at)" for t, at in found) for b, found in sorted(places.items())) + ")"
    anchored = ", ".join(f"'{b}'" for b in sorted(places))
    few, many = threshold / (2 - threshold), (2 - threshold) / threshold

    def fits(n: Column, size: Column) -> Column:
        return (n >= few * size - 1e-9) & (n <= many * size + 1e-9)

    df = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t"))
    cued = reduce(or_, [F.col("t").contains(c) for c in cues])
    df = df.select("doc_id", F.when(cued, F.trim(F.regexp_replace("t", "[^a-z0-9]+", " "))).otherwise("").alias("t"))
    w = F.split("t", " ")
    df = df.select("doc_id", F.when(F.col("t").contains(" "), w).alias("w"))
    df = df.select("doc_id", F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)).alias("b"))
    df = df.select("doc_id", F.filter("b", lambda x: x.isNotNull()).alias("b"))
    at = f"filter(transform(b, (x, i) -> struct(x as b, i as p)), x -> x.b in ({anchored}))"
    laid = F.expr(f"flatten(transform({at}, x -> transform(element_at({where}, x.b), m -> struct(m.t as t, greatest(0, x.p - m.at) as s))))")
    laid = F.transform(laid, lambda u: F.struct(u["t"].alias("t"), u["s"].alias("s"), F.element_at(spans, u["t"] + 1).alias("n")))
    df = df.select("doc_id", "b", F.array_distinct(laid).alias("u"), F.size(F.array_distinct("b")).alias("size"))
    whole = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(known) - 1)), lambda t: F.struct(t.alias("t"), F.lit(0).alias("s"), F.size("b").alias("n"))), lambda u: fits(F.col("size"), F.element_at(sizes, u["t"] + 1)))
    df = df.select("doc_id", "b", F.array_distinct(F.concat("u", whole)).alias("u"))

    bag = F.transform("u", lambda u: F.struct(u["t"].alias("t"), u["s"].alias("s"), F.least(u["n"], F.size("b") - u["s"]).alias("n"), F.array_distinct(F.slice("b", u["s"] + 1, u["n"])).alias("b")))
    bag = F.filter(bag, lambda u: fits(F.size(u["b"]), F.element_at(sizes, u["t"] + 1)))
    df = df.select("doc_id", bag.alias("u"))
    dice = lambda u: 2.0 * F.size(F.array_intersect(u["b"], F.element_at(bags, u["t"] + 1))) / (F.size(u["b"]) + F.element_at(sizes, u["t"] + 1))
    hits = F.filter(F.transform("u", lambda u: F.struct(dice(u).alias("dice"), (u["n"] + 1).alias("words"), (-u["s"]).alias("s"), (-u["t"]).alias("t"))), lambda h: h["dice"] >= threshold)
    df = df.select("doc_id", hits.alias("h"))
    df = df.select("doc_id", F.when(F.size("h") > 0, F.col("h")).alias("h"))
    found = F.array_sort(F.array_distinct(F.transform("h", lambda h: F.element_at(names, 1 - h["t"]))))
    df = df.select("doc_id", found.alias("found"), F.array_max("h").alias("top"))
    top = lambda c: F.when(F.col("found").isNotNull(), c)
    return df.select(
        "doc_id", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_hits"), F.coalesce(F.array_join("found", ","), F.lit("")).alias("licenses"),
        top(F.element_at(names, 1 - F.col("top.t"))).alias("license"), top(F.col("top.dice")).alias("dice"), top((-F.col("top.s")).cast("long")).alias("start"), top(F.col("top.words").cast("long")).alias("words"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    known = template_words()
    cues = cue_words(known)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, {quoted(n)}, {len(w) - 1}, [{', '.join(map(quoted, sorted(set(bigrams(w)))))}])" for t, (n, w) in enumerate(known))
    places = ", ".join(f"({quoted(b)}, {t}, {at})" for b, found in sorted(anchors(known, cues).items()) for t, at in found)
    cued = " OR ".join(f"contains(t, {quoted(c)})" for c in cues)
    fits = f"BETWEEN len(t.b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(t.b) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9"
    return f"""
WITH templates(t, license, n, b) AS (VALUES {rows}), anchors(b, t, off) AS (VALUES {places}), low AS (
  SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents
), w AS (
  SELECT doc_id, string_split(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM low WHERE {cued}
), b AS (
  SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w WHERE len(w) > 1
), p AS (
  SELECT doc_id, unnest(b) AS b, unnest(range(0, len(b))) AS p FROM b
), u AS (
  SELECT p.doc_id, a.t, greatest(0, p.p - a.off) AS s, t.n FROM p JOIN anchors a USING (b) JOIN templates t ON t.t = a.t
  UNION SELECT doc_id, t.t, 0, len(b.b) FROM b JOIN templates t ON len(list_distinct(b.b)) {fits}
), bags AS (
  SELECT doc_id, u.t, u.s, least(u.n, len(b.b) - u.s) AS n, list_distinct(b.b[u.s + 1 : u.s + u.n]) AS b FROM u JOIN b USING (doc_id)
), hits AS (
  SELECT doc_id, license, x.t, x.s, x.n, CAST(2.0 AS DOUBLE) * len(list_intersect(x.b, t.b)) / (len(x.b) + len(t.b)) AS dice FROM bags x JOIN templates t ON x.t = t.t AND len(x.b) {fits}
), good AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, n DESC, s, t) AS r FROM hits WHERE dice >= {THRESHOLD}
), named AS (
  SELECT doc_id, count(DISTINCT license) AS n_hits, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM good GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n.n_hits, 0) AS BIGINT) AS n_hits, coalesce(n.licenses, '') AS licenses, g.license, g.dice, CAST(g.s AS BIGINT) AS start, CAST(g.n + 1 AS BIGINT) AS words
FROM documents d LEFT JOIN named n USING (doc_id) LEFT JOIN (SELECT * FROM good WHERE r = 1) g USING (doc_id)
"""


OP3_SQL = _sql()

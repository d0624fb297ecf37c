"""License scans with DataFrame functions only.

A text is normalised to lower-case words of a-z and 0-9, all of it, whatever its length. Its windows, all runs of words that begin and end in
a template's wording, are compared to every template that shares enough distinct word bigrams with the text to reach the threshold, by the Dice
coefficient of the two bigram sets. A match gives way to a better one in the same place. Only texts with an anchor are looked at closely:
anchors are words or pairs of words chosen so that nothing can reach the threshold with a template without one of them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
THRESHOLD = Fraction(4, 5)

#: The wording of short licence notices and short licences.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "BSD-2-Clause": ("This project is licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("This project is licensed under the BSD 3-Clause License.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "proprietary": ("All rights reserved.", "All rights reserved. No part of this text may be reproduced without permission."),
}

#: The real wording of notices and short licences, as they stand in files (names of holders differ).
NOTICES = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU Affero General Public License Version 3, 19 November 2007",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Boost Software License - Version 1.0 - August 17th, 2003",
    ),
    "CC-BY-NC-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."),
    "CC-BY-NC-SA-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU General Public License Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU General Public License Version 3, 29 June 2007",
    ),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "GNU Lesser General Public License Version 3, 29 June 2007",
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
}


def _words(text: str) -> list[str]:
    import re

    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def _bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def known_templates() -> dict[str, tuple[str, ...]]:
    """All wordings by licence."""
    return {name: TEMPLATES.get(name, ()) + NOTICES.get(name, ()) for name in sorted({*TEMPLATES, *NOTICES})}


def compiled(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    """(licence, sorted distinct bigrams) of each template with two words at least."""
    return [(name, b) for name, texts in sorted(templates.items()) for t in texts if (b := _bigrams(_words(t)))]


def bounds(n: int, threshold: Fraction = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold with a template of ``n``."""
    return -((-n * threshold) // (2 - threshold)), int(n * (2 - threshold) / threshold)


def anchors(templates: list[tuple[str, list[str]]], threshold: Fraction = THRESHOLD, rare: int = 7) -> list[tuple[str, ...]]:
    """Sets of words of which every matching unit has one whole.

    A match shares at least n * t / (2 - t) of a template's n bigrams. For each template, words of ``rare`` letters or more, and where
    they do not suffice single bigrams, are taken until fewer of its bigrams are free of them than any match shares.
    """
    chosen: list[tuple[str, ...]] = []
    for _, grams in templates:
        least = bounds(len(grams), threshold)[0]
        free = [g.split(" ") for g in grams if not any(set(a) <= set(g.split(" ")) for a in chosen)]
        while len(free) >= least:
            counts = {w: sum(w in g for g in free) for g in free for w in g if len(w) >= rare}
            if counts:
                best = (max(sorted(counts), key=lambda w: (counts[w], len(w))),)
            else:
                best = tuple(sorted(max(free, key=lambda g: (len(g[0]) + len(g[1]), g))))
            chosen.append(best)
            free = [g for g in free if not set(best) <= set(g)]
    return sorted(set(chosen))


def _table(templates: list[tuple[str, list[str]]], threshold: Fraction) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n"), F.lit(bounds(len(g), threshold)[0]).alias("lo"), F.lit(bounds(len(g), threshold)[1]).alias("hi")) for name, g in templates])


def _grams(u: Column) -> Column:
    """Word bigrams of a normalised text, in order."""
    w = F.split(u, " ")
    n = F.size(w)
    return F.when(n > 1, F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, f) -> Column:
    """f(value), with the value made once however often f uses it."""
    return F.transform(F.array(value), f)[0]


#: Words of a window, at most, for each bigram of the template.
SPAN = 2


def _window_matches(text: Column, templates: list[tuple[str, list[str]]], threshold: Fraction) -> Column:
    """Array of (dice, shared, both, first, last, name) structs of a normalised text: for each template its best window, if that reaches the threshold.

    A bigram counts in a window where it did not stand in the window before, that is if its previous place in the text lies before the window. So
    both sets' sizes grow by plain sums as a window's end moves on, and every end is measured in one pass for each beginning.
    """
    table = _table(templates, threshold)
    known = sorted({x for _, g in templates for x in g})
    num, den = F.lit(threshold.numerator), F.lit(threshold.denominator)

    def previous(g: Column) -> Column:
        """For each place the last one before with the same bigram, -1 for none."""
        placed = F.array_sort(F.transform(g, lambda x, k: F.struct(x.alias("gram"), k.alias("at"))))

        def linked(o: Column) -> Column:
            before = lambda k: F.get(o, k - 1)
            return F.transform(o, lambda x, k: F.struct(x["at"].alias("at"), F.when(before(k)["gram"] == x["gram"], before(k)["at"]).otherwise(-1).alias("prev")))

        return F.transform(F.array_sort(_let(placed, linked)), lambda x: x["prev"])

    def from_start(prev: Column, own: Column, k: Column, x: Column) -> Column:
        start = own[k]["at"]
        # hits are in order: those of the next places are among as many next hits
        ends = F.filter(F.slice(own, k + 1, x["n"] * SPAN), lambda h: h["at"] < start + x["n"] * SPAN)
        none = F.struct(start.alias("next"), F.lit(0).alias("size"), F.lit(0).alias("shared"), F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("shared"), F.lit(1).alias("both"), F.lit(-1).alias("last")).alias("best"))

        def end(state: Column, h: Column) -> Column:
            more = F.struct(
                (state["size"] + F.size(F.filter(F.slice(prev, state["next"] + 1, h["at"] - state["next"] + 1), lambda v: v < start))).alias("size"),
                (state["shared"] + (h["prev"] < start).cast("int")).alias("shared"),
            )

            def best(m: Column) -> Column:
                both = x["n"] + m["size"]
                dice = m["shared"] * F.lit(2.0) / both
                mine = F.struct(dice.alias("dice"), m["shared"].alias("shared"), both.alias("both"), h["at"].alias("last"))
                better = (dice > state["best"]["dice"]) | ((dice == state["best"]["dice"]) & (m["shared"] > state["best"]["shared"]))
                return F.struct((h["at"] + 1).alias("next"), m["size"].alias("size"), m["shared"].alias("shared"), F.when(better, mine).otherwise(state["best"]).alias("best"))

            return _let(more, best)

        def top(s: Column) -> Column:
            b = s["best"]
            return F.when(b["shared"] * 2 * den >= b["both"] * num, F.struct(b["dice"].alias("dice"), b["shared"].alias("shared"), (-start).alias("first"), (-b["last"]).alias("last"), b["both"].alias("both")))

        return _let(ends, lambda e: F.when(F.size(e) >= x["lo"], _let(F.aggregate(e, none, end), top)))

    def best(prev: Column, own: Column, x: Column) -> Column:
        found = F.array_max(F.transform(own, lambda _, k: from_start(prev, own, k, x)))
        shown = lambda m: F.when(m.isNotNull(), F.struct(m["dice"].alias("dice"), m["shared"].alias("shared"), m["both"].alias("both"), (-m["first"]).alias("first"), (-m["last"]).alias("last"), x["name"].alias("name")))
        return _let(found, shown)

    def measured(g: Column, hits: Column, fits: Column) -> Column:
        def of(prev: Column) -> Column:
            own = lambda x: F.transform(F.filter(hits, lambda h: F.array_contains(x["grams"], h["gram"])), lambda h: F.struct(h["at"].alias("at"), F.get(prev, h["at"]).alias("prev")))
            return F.transform(fits, lambda x: _let(own(x), lambda o: best(prev, o, x)))

        return F.filter(_let(previous(g), of), lambda m: m.isNotNull())

    def of_text(g: Column, hits: Column) -> Column:
        distinct = F.array_distinct(F.transform(hits, lambda h: h["gram"]))
        fits = _let(distinct, lambda d: F.filter(table, lambda x: F.size(F.array_intersect(d, x["grams"])) >= x["lo"]))
        return _let(fits, lambda f: F.when(F.size(f) > 0, measured(g, hits, f)).otherwise(F.array().cast(MATCHES)))

    hits = lambda g: F.filter(F.transform(g, lambda x, k: F.when(x.isin(known), F.struct(k.alias("at"), x.alias("gram")))), lambda h: h.isNotNull())
    return _let(_grams(text), lambda g: _let(hits(g), lambda h: of_text(g, h)))


MATCHES = "array<struct<dice:double,shared:int,both:int,first:int,last:int,name:string>>"


def _standing(found: Column) -> Column:
    """Matches of which no better one covers more than half.

    Better is what shares more bigrams, less those that only the window or only the template has (then the higher dice, then the name): a longer wording with a changed name in
    it is not taken for the shorter one that it begins with, nor that for the longer.
    """
    worth = lambda m: F.struct((3 * m["shared"] - m["both"]).alias("worth"), m["dice"].alias("dice"))
    better = lambda b, a: (worth(b) > worth(a)) | ((worth(b) == worth(a)) & (b["name"] < a["name"]))
    over = lambda b, a: 2 * (F.least(a["last"], b["last"]) - F.greatest(a["first"], b["first"]) + 1) > a["last"] - a["first"] + 1
    return F.filter(found, lambda a: ~F.exists(found, lambda b: better(b, a) & over(b, a)))


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_licenses, license, dice, shared, licenses: licences whose wording stands anywhere in a text.

    The words of the whole text are one sequence: line ends, comment signs and other words around a notice do not matter, nor does the
    length of the text. Windows begin and end at bigrams of a template and are as long as twice its distinct bigrams at most; all of them are measured. The
    one with the highest coefficient (then the most shared bigrams, then the first) is the template's match, if it reaches the threshold. A match of which
    a better one covers more than half gives way to that: where several licences share their wording, the one that is there is reported. license: of the
    match that shares most bigrams (then the higher dice, then the alphabetically first), dice and shared: its figures, null
    without a match; licenses: all found, sorted, comma-joined, empty without; n_licenses: how many. Null and empty texts have no match;
    repeated rows are scanned one by one; other columns are ignored; upper case is A-Z only.
    """
    ready = compiled(known_templates() if templates is None else templates)
    if not ready:
        raise ValueError("no template has two words")
    plain = F.replace(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" "))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.lower(plain).alias("low"))
    low = F.col("low")
    has = None
    for anchor in anchors(ready, threshold):
        one = F.contains(low, F.lit(anchor[0]))
        for w in anchor[1:]:
            one = one & F.contains(low, F.lit(w))
        has = one if has is None else has | one
    norm = lambda c: F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))
    found = F.when(has, _let(_window_matches(norm(low), ready, threshold), _standing)).otherwise(F.array().cast(MATCHES))
    # made once, below a generator that keeps every row
    rows = docs.select("doc_id", F.explode(F.array(found)).alias("found"))
    dice = lambda x: x["shared"] * F.lit(2.0) / x["both"]
    # least of (-shared, -dice, name)
    top = F.array_min(F.transform("found", lambda x: F.struct((-x["shared"]).alias("s"), (-dice(x)).alias("d"), x["name"].alias("name"))))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"])))
    return rows.select("doc_id", F.size(names).cast("bigint").alias("n_licenses"), top["name"].alias("license"), (-top["d"]).alias("dice"), (-top["s"]).cast("bigint").alias("shared"), F.array_join(names, ",").alias("licenses"))


def oracle_sql(table: str = "documents", templates: dict[str, tuple[str, ...]] | None = None, threshold: Fraction = THRESHOLD) -> str:
    """The same rows in DuckDB's SQL, without anchors and without any limit of length."""
    ready = compiled(known_templates() if templates is None else templates)
    values = ", ".join(f"({i}, '{n}', {len(g)}, {bounds(len(g), threshold)[0]}, {bounds(len(g), threshold)[1]}, [{', '.join(repr(x) for x in g)}])" for i, (n, g) in enumerate(ready))
    reached = f"{2 * threshold.denominator} * shared >= {threshold.numerator} * both_n"
    return f"""
WITH t(tid, name, n, lo, hi, grams) AS (VALUES {values}),
tg AS (SELECT tid, unnest(grams) AS gram FROM t),
d AS (SELECT row_number() OVER () AS row_no, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM {table}),
whole AS (SELECT row_no, string_split(trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM d),
g AS (SELECT row_no, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams FROM whole WHERE len(w) > 1),
p AS (SELECT row_no, unnest(grams) AS gram, unnest(range(0, len(grams))) AS at FROM g),
h AS (SELECT p.row_no, tg.tid, p.at, p.gram FROM p JOIN tg ON p.gram = tg.gram),
enough AS (SELECT h.row_no, h.tid FROM h JOIN t ON h.tid = t.tid GROUP BY h.row_no, h.tid, t.lo HAVING count(DISTINCT h.gram) >= t.lo),
hs AS (SELECT h.* FROM h JOIN enough e ON h.row_no = e.row_no AND h.tid = e.tid),
pp AS (SELECT p.*, coalesce(lag(p.at) OVER (PARTITION BY p.row_no, p.gram ORDER BY p.at), -1) AS prev FROM p),
run AS (
  SELECT a.row_no, a.tid, a.at AS first, q.at AS last, q.gram, q.prev < a.at AS new, c.gram IS NOT NULL AS hit
  FROM hs a JOIN t ON a.tid = t.tid JOIN pp q ON a.row_no = q.row_no AND q.at >= a.at AND q.at < a.at + {SPAN} * t.n LEFT JOIN tg c ON c.tid = a.tid AND c.gram = q.gram
),
win AS (SELECT row_no, tid, first, last, hit, sum(CAST(new AS INT)) OVER w AS size, sum(CAST(new AND hit AS INT)) OVER w AS shared FROM run WINDOW w AS (PARTITION BY row_no, tid, first ORDER BY last)),
wm AS (SELECT win.row_no, win.tid, t.name, first, last, shared, t.n + size AS both_n, 2.0::DOUBLE * shared / (t.n + size) AS dice FROM win JOIN t ON win.tid = t.tid WHERE hit),
wb AS (SELECT * FROM wm WHERE {reached} QUALIFY row_number() OVER (PARTITION BY row_no, tid ORDER BY dice DESC, shared DESC, first, last) = 1),
k AS (SELECT * FROM wb a WHERE NOT EXISTS (SELECT 1 FROM wb b WHERE a.row_no = b.row_no AND (3 * b.shared - b.both_n > 3 * a.shared - a.both_n OR 3 * b.shared - b.both_n = 3 * a.shared - a.both_n AND (b.dice > a.dice OR b.dice = a.dice AND b.name < a.name))
  AND 2 * (least(a.last, b.last) - greatest(a.first, b.first) + 1) > a.last - a.first + 1)),
best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY shared DESC, dice DESC, name) = 1),
r AS (SELECT row_no, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM k GROUP BY row_no)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, best.name AS license, best.dice, best.shared::BIGINT AS shared, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN r ON d.row_no = r.row_no LEFT JOIN best ON d.row_no = best.row_no"""

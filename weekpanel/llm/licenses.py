"""License scan in DataFrame functions only.

Units of a text are its lines and its paragraphs of several lines (a notice that is
wrapped over lines, a block of a licence file).  A unit and the templates (notices,
SPDX tags, paragraphs and titles of licence files) are sparse TF-IDF vectors of
lower-case words, document frequencies taken over the templates.  Their cosines are
worked out inside the row, since the templates are a constant of fixed size: nothing
is shuffled but directories.  Units whose share of template words rules out the
threshold are left out first, by a bound that no unit which reaches it can miss.

A text is a licence file of its directory if it begins with the title of one, or if the
units found in it (lines, or paragraphs) hold ``file_share`` of its words.  A text
without a license of its own inherits from the licence file in its nearest ancestor
directory, found by joining the ancestor paths of the distinct directories to the
directories of licence files.

Defined cases: NULL and empty texts have no header and may inherit; a NULL path
inherits nothing; of several units in a text the most similar wins, then the
license first in alphabetical order; the same order decides among the licence
files of one directory; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.text import SPACE, word_column
from weekpanel.session import materialize

# Notices of public licenses and of reserved rights, paragraphs and titles of licence files.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("LicenseRef-Proprietary", "This software is proprietary and confidential."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
     "is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
     "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
     "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, v. 2.0."),
]
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
SPDX = [(k, f"SPDX-License-Identifier: {k}") for k in sorted({k for k, _ in NOTICES if not k.startswith("LicenseRef")})]
TEMPLATES = sorted([(k, t, False) for k, t in NOTICES + SPDX] + [(k, t, True) for k, t in TITLES])  # license, words, is a title

TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
PARAGRAPH = rf"\n{SPACE}*\n"


def _terms(col: Column) -> Column:
    """Lower-case words of letters, digits and inner dots and hyphens."""
    return F.regexp_extract_all(F.lower(col), F.lit(TERM), F.lit(0))


def template_weights() -> tuple[dict[str, float], float, dict[str, list[float]]]:
    """IDF of the templates' words (all ASCII) and of any other word; each word's weight in every unit vector."""
    terms = [Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", words.lower())) for _, words, _ in TEMPLATES]
    n, df = len(terms), Counter(t for counts in terms for t in counts)
    idf = {t: math.log((1.0 + n) / (1 + k)) + 1 for t, k in sorted(df.items())}
    norms = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items())) for counts in terms]
    return idf, math.log(1.0 + n) + 1, {t: [counts[t] * idf[t] / z for counts, z in zip(terms, norms)] for t in idf}


def _constant(value: dict, kind: str) -> Column:
    """A literal map, folded once when the query is planned."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def units(text: Column) -> Column:
    """``(line, paragraph)``: all lines, and the paragraphs that have several."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.lit(False).alias("paragraph")))
    blocks = F.filter(F.split(text, PARAGRAPH), lambda x: F.contains(x, F.lit("\n")))
    return F.concat(lines, F.transform(blocks, lambda x: F.struct(x.alias("line"), F.lit(True).alias("paragraph"))))


def possible_units(found: Column, threshold: float) -> Column:
    """The units that can reach the threshold, with their words: ``(line, paragraph, held, other)``.

    A cosine is at most the square root of the template words' share in the squared
    length (Cauchy-Schwarz).  ``u`` other words, ``d`` of them distinct, add at least
    ``u^2 / d`` times their squared IDF to it, so no unit that reaches the threshold
    is left out."""
    idf, unseen, _ = template_weights()
    weight = _constant(idf, "map<string,double>")
    split = F.transform(found, lambda x: F.struct(x["line"].alias("line"), x["paragraph"].alias("paragraph"), _terms(x["line"]).alias("t")))
    parts = F.transform(split, lambda s: F.struct(*[s[c].alias(c) for c in ("line", "paragraph", "t")], F.filter(s["t"], lambda t: t.isin(*idf)).alias("held")))

    def square(s: Column) -> Column:
        return F.aggregate(F.array_distinct(s["held"]), F.lit(0.0), lambda total, t: total + F.pow(_times(s["held"], t) * F.element_at(weight, t), F.lit(2.0)))

    share = F.lit(max(threshold - 1e-6, 0.0) ** 2 - 1e-9)  # similarities are rounded to six places
    weighed = F.transform(F.filter(parts, lambda s: F.size(s["held"]) > 0), lambda s: F.struct(
        *[s[c].alias(c) for c in ("line", "paragraph", "t", "held")], square(s).alias("square")))
    # other words are told apart only where the bound for all of them distinct (d = u) leaves the unit in
    some = F.filter(weighed, lambda s: s["square"] >= share * (s["square"] + F.lit(unseen * unseen) * (F.size(s["t"]) - F.size(s["held"]))))
    whole = F.transform(some, lambda s: F.struct(
        *[s[c].alias(c) for c in ("line", "paragraph", "held", "square")], F.filter(s["t"], lambda t: ~t.isin(*idf)).alias("other")))

    def fits(s: Column) -> Column:
        return s["square"] >= share * (s["square"] + _least_other(s, unseen))

    return F.transform(F.filter(whole, fits), lambda s: F.struct(*[s[c].alias(c) for c in ("line", "paragraph", "held", "other")]))


def _least_other(s: Column, unseen: float) -> Column:
    u, d = F.size(s["other"]), F.size(F.array_distinct(s["other"]))
    return F.when(u > 0, F.lit(unseen * unseen) * u * u / d).otherwise(0.0)


def _times(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda h: h == word))


def _squares(words: Column) -> Column:
    """The sum of the squared numbers of equal words, from runs of the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, w: Column) -> Column:  # (run + 1)^2 - run^2 = 2 run + 1
        run = F.when(a["last"] == w, a["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(w.alias("last"), (run + 1).alias("run"), (a["sum"] + 2 * run + 1).alias("sum"))

    return F.aggregate(F.array_sort(words), start, step, lambda a: a["sum"])


def matches(possible: Column, threshold: float) -> Column:
    """``(line, paragraph, license, title, similarity)`` of the units that reach the threshold, each with its best template."""
    idf, unseen, weights = template_weights()
    weight, vectors = _constant(idf, "map<string,double>"), _constant(weights, "map<string,array<double>>")
    none = _constant({"": [0.0] * len(TEMPLATES)}, "map<string,array<double>>")[""]

    counted = F.transform(possible, lambda s: F.struct(
        s["line"].alias("line"), s["paragraph"].alias("paragraph"), s["other"].alias("other"),
        F.transform(F.array_distinct(s["held"]), lambda t: F.struct(t.alias("t"), (_times(s["held"], t) * F.element_at(weight, t)).alias("w"))).alias("terms"),
    ))
    dotted = F.transform(counted, lambda s: F.struct(
        s["line"].alias("line"), s["paragraph"].alias("paragraph"), s["other"].alias("other"),
        F.aggregate(s["terms"], none, lambda a, x: F.zip_with(a, F.element_at(vectors, x["t"]), lambda y, v: y + x["w"] * v)).alias("dots"),
        F.aggregate(s["terms"], F.lit(0.0), lambda a, x: a + x["w"] * x["w"]).alias("own"),
    ))

    def near_by_bound(s: Column) -> Column:  # before the words outside the templates are counted one by one
        return F.array_max(s["dots"]) >= F.lit(threshold - 1e-6) * F.sqrt(s["own"] + _least_other(s, unseen))

    def scored(s: Column) -> Column:
        length = F.sqrt(s["own"] + F.lit(unseen * unseen) * _squares(s["other"]))
        return F.struct(s["line"].alias("line"), s["paragraph"].alias("paragraph"), F.transform(s["dots"], lambda x: F.round(x / length, 6)).alias("all"))

    licenses = F.array(*[F.lit(k) for k, _, _ in TEMPLATES])
    titles = F.array(*[F.lit(t) for _, _, t in TEMPLATES])
    cosines = F.transform(F.filter(dotted, near_by_bound), scored)
    best = F.transform(cosines, lambda s: F.struct(s["line"].alias("line"), s["paragraph"].alias("paragraph"), F.array_max(s["all"]).alias("similarity"),
                                                   F.array_position(s["all"], F.array_max(s["all"])).cast("int").alias("at")))
    near = F.filter(best, lambda s: s["similarity"] >= threshold)
    return F.transform(near, lambda s: F.struct(s["line"].alias("line"), s["paragraph"].alias("paragraph"), F.element_at(licenses, s["at"]).alias("license"),
                                                F.element_at(titles, s["at"]).alias("title"), s["similarity"].alias("similarity")))


def scan_licenses(docs: DataFrame, id_col: str, text_col: str, path: Column, threshold: float = 0.7, file_share: float = 0.5) -> DataFrame:
    """``doc_id, directory, license, similarity, source_dir, effective_license`` per row.

    ``path`` is the file path of a row; its directory is the part before the last slash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1).alias("directory"),
        F.regexp_replace(text, f"^{SPACE}+", "").alias("text"), F.size(word_column(F.col(text_col))).alias("n_words"),
        possible_units(units(text), threshold).alias("possible"),
    )
    found = F.when(F.size("possible") > 0, matches(F.col("possible"), threshold))
    base = base.select("doc_id", "directory", "n_words", F.when(F.size("possible") > 0, F.col("text")).alias("text"), found.alias("found"))
    words = lambda kind: F.aggregate(F.filter("found", lambda m: m["paragraph"] == kind), F.lit(0), lambda a, m: a + F.size(word_column(m["line"])))
    begins = F.exists("found", lambda m: m["title"] & F.startswith(F.col("text"), F.regexp_replace(m["line"], f"^{SPACE}+", "")))
    best = F.array_min(F.transform("found", lambda m: F.struct((-m["similarity"]).alias("m"), m["license"].alias("license"))))
    own = base.select("doc_id", "directory", best.alias("b"), (begins | (F.greatest(words(False), words(True)) >= file_share * F.col("n_words"))).alias("file"))
    own = materialize(own.select("doc_id", "directory", F.col("b.license").alias("license"), (-F.col("b.m")).alias("similarity"),
                                 (F.col("b").isNotNull() & F.col("file")).alias("is_file")), "licenses")
    files = own.filter("is_file AND directory IS NOT NULL").groupBy("directory").agg(
        F.min(F.struct((-F.col("similarity")).alias("m"), "license")).alias("b")
    ).select(F.col("directory").alias("source_dir"), F.col("b.license").alias("inherited"))
    dirs = own.filter("directory IS NOT NULL").select("directory").distinct()
    steps = F.split("directory", "/")
    ancestors = dirs.select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("source_dir"))
    near = ancestors.join(files, "source_dir").groupBy("directory").agg(F.max(F.struct(F.length("source_dir").alias("n"), "source_dir", "inherited")).alias("b"))
    near = near.select("directory", "b.source_dir", "b.inherited")
    return own.join(near, "directory", "left").select(
        "doc_id", "directory", "license", "similarity",
        F.when(F.col("license").isNull(), F.col("source_dir")).alias("source_dir"),
        F.coalesce("license", "inherited").alias("effective_license"),
    )

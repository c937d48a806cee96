"""Decontamination, host rules and license scans against brute force, and their plans."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from weekpanel.llm import licenses, queries
from weekpanel.llm.decontaminate import contaminated
from weekpanel.llm.host_rules import apply_host_rules
from weekpanel.llm.text import table

from . import brute
from .conftest import EDGES, SF01, document_frame


def _docs(spark, sf=SF01):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def _counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_host_rules_match_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_host_rules"](spark, SF01).collect()}
    for i, t in _docs(spark):
        want = brute.rule_counts(t)
        assert _counts(got[i]) == want
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_host_rules_edges(spark, edges, empty):
    rows = apply_host_rules(edges).collect()
    assert sorted(map(_counts, rows)) == sorted(brute.rule_counts(t) for _, t, _, _ in EDGES)
    assert apply_host_rules(empty).count() == 0


def test_bad_host_fails_its_clean_documents_and_the_prior_spares_small_hosts(spark):
    good = "a clean text of more than ten words that says something once only"
    rows = [(i, "too short", None, "bad") for i in range(300)] + [(1000, good, None, "bad"), (1001, good, None, None)]
    rows += [(2000 + i, good, None, f"host{i % 40}") for i in range(400)] + [(3000, "short", None, "tiny"), (3001, good, None, "tiny")]
    kept = {r.doc_id: r.kept for r in apply_host_rules(document_frame(spark, rows)).collect()}
    assert not kept[1000] and kept[1001] and kept[2000] and not kept[3000] and kept[3001]


def test_decontamination_matches_brute_force(spark):
    rows = queries.QUERIES["op7_decontamination"](spark, SF01).collect()
    items = [(r.item_id, r.text) for r in table(spark, SF01, "benchmark").collect()]
    want = brute.leaks(_docs(spark), items)
    assert want and {(r.doc_id, r.item_id): (pytest.approx(r.similarity), r.start) for r in rows} == want


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20 + 2 * i))) for i in range(20)]
    docs = []
    for i, text in items:
        w = text.split()
        w[len(w) // 2] = "changed"
        noise = rng.choices(vocabulary, k=200)
        docs.append((i, " ".join(noise[:90] + w + noise[90:]), None, None))
        docs.append((100 + i, " ".join(noise), None, None))
        docs.append((200 + i, "Before. " + text.upper().replace(" ", ", ") + "!", None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(document_frame(spark, docs), bench).collect()}
    want = brute.leaks([(d, t) for d, t, *_ in docs], items)
    assert got == {k: pytest.approx(v[0]) for k, v in want.items()}
    assert all((200 + i, i) in got for i, _ in items)
    assert len([d for d, _ in got if d < 100]) >= 10 and not [d for d, _ in got if 100 <= d < 200]


def test_decontamination_edges(spark, edges, empty):
    bench = spark.createDataFrame(
        [(1, "a row without an id, of more than five words"), (2, None), (3, ""), (4, "one two three"), (None, "wort1 lang1 wort2 lang2 wort3 lang3 wort4 lang4")],
        "item_id long, text string",
    )
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(edges, bench).collect()}
    assert got == {(None, 1): 1.0, (5, None): 1.0, (6, None): 1.0}
    assert contaminated(empty, bench).count() == 0
    assert contaminated(edges, bench.limit(0)).count() == 0


def test_licenses_match_brute_force(spark):
    rows = queries.QUERIES["op10_licenses"](spark, SF01).collect()
    sources = {r.doc_id: r.source for r in table(spark, SF01, "documents").select("doc_id", "source").collect()}

    def path(i):
        steps = [] if i % 1000 == 0 else [i // 1000] if i % 100 == 0 else [i // 1000, i // 100]
        return "/".join(map(str, [sources[i], *steps, i]))

    want = brute.licenses(_docs(spark), path, licenses.TEMPLATES)
    assert {r.doc_id: (r.license, r.source_dir, r.effective_license) for r in rows} == want
    assert collections.Counter(r.license for r in rows)["MIT"]


def test_license_inheritance_and_edges(spark, edges, empty):
    rows = [
        (1, "Released under the MIT License.", None, "a/LICENSE"),
        (2, "some code", None, "a/b/c/x.py"),
        (3, "Licensed under the Apache License, Version 2.0.", None, "a/b/NOTICE"),
        (4, "some code", None, "a/y.py"),
        (5, "This work is licensed under the GNU General Public License, version 3.\n" + "code " * 50, None, "a/b/own.py"),
        (6, "some code", None, "z/y.py"),
        (7, "my driving licence is lost", None, "a/b/w.txt"),
        (8, None, None, None),
        (9, "Released under the MIT License.", None, "a/b/LICENSE"),
    ]
    got = {r.doc_id: (r.license, r.source_dir, r.effective_license) for r in licenses.scan_licenses(document_frame(spark, rows), "doc_id", "text", F.col("source")).collect()}
    assert got == {
        1: ("MIT", None, "MIT"), 2: (None, "a/b", "Apache-2.0"), 3: ("Apache-2.0", None, "Apache-2.0"), 4: (None, "a", "MIT"),
        5: ("GPL-3.0", None, "GPL-3.0"), 6: (None, None, None), 7: (None, "a/b", "Apache-2.0"), 8: (None, None, None), 9: ("MIT", None, "MIT"),
    }
    assert licenses.scan_licenses(edges, "doc_id", "text", F.concat_ws("/", "source", "doc_id")).count() == len(EDGES)
    assert licenses.scan_licenses(empty, "doc_id", "text", F.col("source")).count() == 0


def test_license_lines_need_no_keyword(spark):
    """Reserved rights are a header and block inheritance; no line that reaches the threshold is left out."""
    rows = [
        (1, "Released under the MIT License.", None, "a/LICENSE"),
        (2, "some text of more words than its notice has\nAll rights reserved.", None, "a/b/x"),
        (3, "some text of more words than its notice has\nAvailable under CC BY-SA 4.0.\nmore", None, "a/b/y"),
        (4, "some text", None, "a/b/z"),
        (5, "the " * 400 + "of the work under this " * 90, None, "c/y"),
    ]
    got = {r.doc_id: (r.license, r.effective_license) for r in licenses.scan_licenses(document_frame(spark, rows), "doc_id", "text", F.col("source")).collect()}
    reserved = "LicenseRef-All-Rights-Reserved"
    assert got == {1: ("MIT", "MIT"), 2: (reserved, reserved), 3: ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), 4: (None, "MIT"), 5: (None, None)}

    rng = random.Random(11)
    words = " ".join(t for _, t, _ in licenses.TEMPLATES).split() + ["foo", "bar", "Baz", "qux"]
    lines = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(400)} | {t + " foo" * k for _, t, _ in licenses.TEMPLATES for k in range(4)})
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    unit = F.array(F.struct("line", F.lit(False).alias("paragraph")))
    for threshold in (0.4, 0.7):
        reach = {r.line for r in frame.select("line", licenses.matches(licenses.possible_units(unit, -1.0), threshold).alias("m")).collect() if r.m}
        kept = {r.line for r in frame.select("line", licenses.possible_units(unit, threshold).alias("p")).collect() if r.p}
        assert reach and reach <= kept and (threshold < 0.7 or len(kept) < len(lines))


MIT = """MIT License

Copyright (c) 2020 Jane Doe

""" + "\n\n".join(t.replace(", ", ",\n") for k, t, title in sorted(licenses.TEMPLATES, key=lambda x: len(x[1])) if k == "MIT" and len(t) > 100)
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

""" + "The body of the text goes on for a long while in other words. " * 400
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

""" + "1. Definitions and many more words of the terms. " * 300


def test_licence_files_tags_and_wrapped_notices(spark):
    rows = [
        (1, MIT, None, "m/LICENSE"), (2, "code", None, "m/deep/er/x.py"),
        (3, GPL, None, "g/COPYING"), (4, "code", None, "g/src/x.c"),
        (5, APACHE, None, "a/LICENSE"), (6, "code", None, "a/b/x.java"),
        (7, "# SPDX-License-Identifier: Apache-2.0\ncode\n" * 1 + "more code " * 30, None, "m/spdx.py"),
        (8, "/* SPDX-License-Identifier: MIT */\ncode", None, "y/spdx.c"),
        (9, "# SPDX-License-Identifier: Unknown-9.9\n" + "code " * 30, None, "z/other.c"),
        (10, "#!/bin/sh\n\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
             "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\n" + "code " * 200, None, "m/wrapped.sh"),
        (11, "We met the publisher and read the MIT License there, then walked home through the park\n" + "word " * 50, None, "z/essay.txt"),
    ]
    got = {r.doc_id: (r.license, r.effective_license) for r in licenses.scan_licenses(document_frame(spark, rows), "doc_id", "text", F.col("source")).collect()}
    assert got == {
        1: ("MIT", "MIT"), 2: (None, "MIT"), 3: ("GPL-3.0", "GPL-3.0"), 4: (None, "GPL-3.0"), 5: ("Apache-2.0", "Apache-2.0"), 6: (None, "Apache-2.0"),
        7: ("Apache-2.0", "Apache-2.0"), 8: ("MIT", "MIT"), 9: (None, None), 10: ("GPL-3.0", "GPL-3.0"), 11: (None, None),
    }


@pytest.mark.parametrize("name", ["op7_decontamination", "op9_host_rules", "op10_licenses"])
def test_native_queries_run_no_python(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("PythonUDF", "MapInPandas", "MapInArrow", "ArrowEvalPython", "CartesianProduct"))

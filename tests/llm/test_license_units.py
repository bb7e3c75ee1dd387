"""License notices and texts as windows: headers, wrapped notices, sentences, whole files."""

import pytest

pytest.importorskip("pointloom.llm")

from pointloom.llm import licenses  # noqa: E402

PROSE = "the old mill by the river has been closed for many years and nobody in town remembers when it was"
CASES = [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("All rights reserved.", "Proprietary"),
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("// SPDX-License-Identifier: MIT\nint main", "MIT"),
    ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
    ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("SPDX-License-Identifier: Zlib", None),
    ("Released under the Zebra License.", None),
    ("GNU GENERAL PUBLIC LICENSE", "GPL"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"),
    (f"{PROSE}. Released under the MIT License.", "MIT"),
    (f"{PROSE} released under the MIT License.", "MIT"),
    ("Copyright 2020 A. All rights reserved.\n# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files", "MIT"),
    ("/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */", "GPL-3.0"),
    (f"{PROSE} " * 40 + "Released under the\nMIT License. " + PROSE, "MIT"),
    (f"{PROSE} a license to wonder", None),
    (PROSE, None),
    (None, None),
    ("", None),
]


def test_units(spark):
    texts = licenses.full_texts()
    filed = [(f"{x}\nAppendix of the {n} file.", n) for n, x in texts]
    cases = [*CASES, *filed]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.license, r.at) for r in licenses.detect(df).collect()}
    assert {t if t is None else t[:60]: got.get(i, (None,))[0] for i, (t, _) in enumerate(cases)} == {t if t is None else t[:60]: x for t, x in cases}
    assert got[[t for t, _ in cases].index("GNU GENERAL PUBLIC LICENSE")][1] == 0


def brute(texts, threshold=0.6):
    """Best (vague, -score, license, at) per text: every window against every notice, full texts where a word is aligned."""
    import math
    import re
    from collections import Counter

    cut = lambda t: re.findall(licenses.TOKEN, t.lower())
    files = [None if t is None else cut(t) for t in texts]
    n = sum(f is not None for f in files)
    df = {}
    for f in files:
        for w in set(f or []):
            df[w] = df.get(w, 0) + 1
    known = {w for *_, ws in licenses.templates() for w in ws}
    idf = lambda w: math.log((1 + n) / (1 + (df.get(w, 0) if w in known else 0))) + 1
    vector = lambda ws: {w: k * idf(w) for w, k in Counter(ws).items()}
    size = lambda v: math.sqrt(sum(a * a for a in v.values()))
    prepared = [(name, text, full, ws, set() if full else set(ws) & licenses.NAMES, vector(ws), licenses.landmarks(ws, df)) for name, text, full, ws in licenses.templates()]
    out = []
    for f in files:
        best, inside = [], set(f or [])
        for name, text, full, ws, needs, v, found in prepared:
            marks = {w for w, _ in found}
            if f is None or not needs <= inside or not inside & (marks if full else v.keys()):
                continue
            begins = {max(i - o, 0) for w, o in found for i, x in enumerate(f) if x == w} if full else [i for i, x in enumerate(f) if x in v]
            for b in begins:
                w = f[b : b + len(ws)]
                if not needs <= set(w) or full and len(marks & set(w)) < min(licenses.LANDMARKS, len(marks)):
                    continue
                u = vector(w)
                score = round(sum(u[k] * v.get(k, 0) for k in u) / (size(u) * size(v)), 6)
                if score >= threshold:
                    best.append((name in licenses.VAGUE or text in licenses.VAGUE, -score, name, b))
        out.append(min(best, default=None))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text for r in docs] + [t for t, _ in CASES] + ["Released under the MIT License. " * 3 + "Released under the BSD 3-Clause License."] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.license, r.at, r.score) for r in licenses.detect(df).collect()}
    for i, b in enumerate(brute(texts)):
        assert (got.get(i) is None) == (b is None), texts[i]
        assert b is None or got[i][:2] == (b[2], b[3]) and abs(got[i][2] + b[1]) < 2e-6


def test_altered_full_texts(spark):
    """As many words as the guarantee allows are altered, the landmarks themselves among them."""
    cases = []
    for text, name in [(x, n) for n, x in licenses.full_texts()]:
        ws = licenses.re.findall(licenses.TOKEN, text.lower())
        for drop in ([o for _, o in licenses.landmarks(ws, {})][: licenses.SPREAD - licenses.LANDMARKS], list(range(5, len(ws), len(ws) // 12))[: licenses.SPREAD - licenses.LANDMARKS]):
            cases.append((" ".join(f"zzz{i}" if i in drop else w for i, w in enumerate(ws)), name))
    cases.append((" ".join("zzz" if w in ("any", "associated", "charge") else w for w in licenses.re.findall(licenses.TOKEN, dict(licenses.full_texts())["CC0-1.0"].lower())), "CC0-1.0"))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(1000 + i, PROSE) for i in range(50)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.score) for r in licenses.detect(df).collect()}
    family = lambda n: n and n.replace("BSD-2", "BSD-3")  # noqa: E731  the one text is a part of the other
    assert [family(got.get(i, (None,))[0]) for i in range(len(cases))] == [family(n) for _, n in cases]
    assert got[len(cases) - 1][1] > 0.8


def test_prefix_words_bound_the_cosine():
    weights = {"a": 3.0, "b": 2.0, "c": 1.0, "d": 1.0}
    some = licenses.prefix_words(weights, {"a": 5, "b": 1, "c": 9, "d": 2}, 0.6)
    rest = sum(v * v for w, v in weights.items() if w not in some)
    assert some == ["b", "d", "a"] and rest < 0.36 * 15 <= rest + 9


def test_edges(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, mit, "a/x", "old", 0.5, "y", 3),
        (1, mit, "a/x", "old", 0.5, "y", 3),
        (None, "Licensed under CC0 1.0", "b/y", "", 0.0, "", 3),
        (None, "nothing", "b/z", "", 0.0, "", 3),
        (3, "word " * 100_000 + "released under the mit license", "c/z", "", 0.0, "", 3),
        (4, "", "a/q", "", 0.0, "", 3),
        (5, "x", None, "", 0.0, "", 3),
        (7, mit, "d/L1", "", 0.0, "", 3),
        (7, PROSE, "e/x.c", "", 0.0, "", 3),
        (None, mit, "f/LICENSE", "", 0.0, "", 3),
        (8, PROSE, "f/x.c", "", 0.0, "", 3),
        (9, None, "f/g/h", "", 0.0, "", 3),
        (10, "Licensed under CC0 1.0", "f/own", "", 0.0, "", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string, license string, score double, from_path string, words int")
    found = sorted((r.doc_id or 0, r.license) for r in licenses.detect(df).collect())
    assert found == [(0, "CC0-1.0"), (0, "MIT"), (1, "MIT"), (1, "MIT"), (3, "MIT"), (7, "MIT"), (10, "CC0-1.0")]
    got = licenses.scan(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "path", "license", "score", "from_path"}
    assert sorted((r.path or "", r.license, r.from_path) for r in got) == [
        ("", None, None),
        ("a/q", "MIT", "a"),
        ("a/x", "MIT", "a/x"),
        ("a/x", "MIT", "a/x"),
        ("b/y", "CC0-1.0", "b/y"),
        ("b/z", "CC0-1.0", "b"),
        ("c/z", "MIT", "c/z"),
        ("d/L1", "MIT", "d/L1"),
        ("e/x.c", None, None),
        ("f/LICENSE", "MIT", "f/LICENSE"),
        ("f/g/h", "CC0-1.0", "f"),  # null keys come after others
        ("f/own", "CC0-1.0", "f/own"),
        ("f/x.c", "CC0-1.0", "f"),
    ]
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_planted_notice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.license for r in licenses.detect(docs).collect()}
    for text, name in CASES[:1] + CASES[3:7]:
        held = [r.doc_id for r in docs.where(docs.text.contains(text)).select("doc_id").collect()]
        assert held and all(d in found for d in held), text
    alone = [r.doc_id for r in docs.where(docs.text.contains("Licensed under CC BY-NC 4.0.")).select("doc_id").collect()]
    assert {found[d] for d in alone} == {"CC-BY-NC-4.0"}

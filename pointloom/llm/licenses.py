"""License scans: TF-IDF cosine of files to templates, inherited by directory.

Templates are short notices and full license texts; they and the windows of
files are sparse TF-IDF vectors over words, with document frequencies from all
files.  A window has as many words as the template it is compared with, so a
header, a wrapped notice, a sentence inside prose and a whole license file are
all met by windows of their own size.  A window begins with a word of the template.
An index on template words finds them:

* a notice that names a license is compared with every window that holds all
  its names, found at the rarest of them;
* any other notice is compared with every window that holds one of its prefix
  words (:func:`prefix_words`): a window without them stays below the threshold;
* a full text is compared where the window, aligned at one of its
  :data:`SPREAD` landmarks, starts: words that it holds once, the rarest of each
  of as many stretches.  The window holds :data:`LANDMARKS` of them at least, so
  a text with fewer altered words than the others are many is always found.

The file gets the best template of its best window.  A file without one
inherits the license of its nearest ancestor directory that has a license file.

DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ROW, evenly, materialise

# fixed values: short notices that name public licenses
TEMPLATES = [
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the apache license version 2.0"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "use of this source code is governed by a bsd style license"),
    ("BSD-2-Clause", "released under the simplified bsd 2 clause license"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("LGPL-2.1", "licensed under the gnu lesser general public license version 2.1"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license version 2.0"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright under cc0 1.0 universal public domain dedication"),
    ("Proprietary", "copyright all rights reserved"),
]
TOKEN = r"([a-z0-9.]*[a-z0-9])"

# fixed values: notices by name, version or identifier, and titles of license texts
CREATIVE = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
NOTICES = [
    *[
        (f"CC-{'-'.join(parts).upper()}-{version}", text)
        for version in ("4.0", "3.0")
        for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
        for text in (
            f"licensed under cc {' '.join(parts)} {version}",
            f"this work is licensed under a creative commons {' '.join(CREATIVE[p] for p in parts)} {version} international license",
        )
    ],
    ("CC0-1.0", "licensed under cc0 1.0"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "mit license"),
    ("Apache-2.0", "apache license version 2.0 january 2004"),
    ("Apache-2.0", "released under the apache license 2.0"),
    ("BSD-3-Clause", "released under the bsd 3 clause license"),
    ("BSD-2-Clause", "released under the bsd 2 clause license"),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GPL", "gnu general public license"),
    ("GPL", "released under the gnu gpl"),
    *[
        (name, text)
        for name, kind, short, version, date in (
            ("GPL-2.0", "", "gpl", "2", "june 1991"),
            ("GPL-3.0", "", "gpl", "3", "29 june 2007"),
            ("LGPL-2.1", "lesser ", "lgpl", "2.1", "february 1999"),
            ("LGPL-3.0", "lesser ", "lgpl", "3", "29 june 2007"),
            ("AGPL-3.0", "affero ", "agpl", "3", "19 november 2007"),
        )
        for text in (
            f"gnu {kind}general public license version {version} {date}",
            f"licensed under the gnu {kind}general public license version {version}",
            f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license or at your option any later version",
            f"released under the {short} version {version}",
        )
    ],
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("ISC", "released under the isc license"),
    *[
        (name, f"spdx license identifier {name.lower().replace('-', ' ')}")
        for name in ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0")
    ],
    *[(f"CC-{x}-{v}", f"spdx license identifier cc {x.lower().replace('-', ' ')} {v}") for v in ("4.0", "3.0") for x in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")],
]
# fixed values: words that tell one license from another; a notice must hold all those of its template
NAMES = {
    "mit", "apache", "bsd", "gnu", "gpl", "lgpl", "agpl", "lesser", "affero", "mozilla", "mpl", "isc", "unlicense", "cc", "cc0", "creative", "commons", *CREATIVE, *CREATIVE.values(), "clause", "simplified",
    "2", "3", "1.0", "2.0", "2.1", "3.0", "4.0",
}
# fixed values: licenses that name no version or no terms, and words that several licenses share; any other template goes before them
VAGUE = {"GPL", "Proprietary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"}
#: Stretches of a full text that a landmark is taken from.
SPREAD = 16
#: Landmarks that a window holds which is compared with a full text.
LANDMARKS = 4


def words(text: Column) -> Column:
    """Lower-case words of a text; dots inside version numbers stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def full_texts() -> list[tuple[str, str]]:
    """Whole license texts that come with the package."""
    return [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def templates() -> list[tuple[str, str, bool, list[str]]]:
    """``(license, text, full, words)`` of every template."""
    return [(n, x, full, re.findall(TOKEN, x.lower())) for full, some in ((False, [*TEMPLATES, *NOTICES]), (True, full_texts())) for n, x in some]


def tokens(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the ``words`` of every row, written with a row id of its own; null texts have null words."""
    return materialise(docs.select(*keep, words(F.col(text)).alias("words"), F.monotonically_increasing_id().alias(ROW)), "file-words")


def frequencies(files: DataFrame, vocabulary: DataFrame) -> tuple[dict[str, int], int]:
    """Number of files that hold each word of the templates, and of files with a text.

    One aggregate over all files; its result is as large as the vocabulary.
    """
    seen = files.select(F.explode(F.array_distinct("words")).alias("word")).join(F.broadcast(vocabulary), "word")
    return {r[0]: r[1] for r in seen.groupBy("word").count().collect()}, files.where("words IS NOT NULL").count()


def prefix_words(weights: dict[str, float], df: dict[str, int], threshold: float) -> list[str]:
    """The rarest words that, left out, leave too little of a template for ``threshold``.

    What a window shares with a template bounds their cosine by its part of the
    template's length.
    """
    whole = rest = sum(v * v for v in weights.values())
    some = []
    for w in sorted(weights, key=lambda w: (df.get(w, 0), w)):
        if rest < threshold * threshold * whole * (1 - 1e-9):
            break
        some.append(w)
        rest -= weights[w] ** 2
    return some


def landmarks(held: list[str], df: dict[str, int]) -> list[tuple[str, int]]:
    """(word, offset): of each stretch of a full text the rarest word that the text holds once."""
    n, count, out = len(held), Counter(held), []
    for k in range(SPREAD):
        some = [i for i in range(k * n // SPREAD, (k + 1) * n // SPREAD) if count[held[i]] == 1]
        out += [(held[i], i) for i in sorted(some, key=lambda i: (df.get(held[i], 0), held[i]))[:1]]
    return out


def windows(files: DataFrame, index: DataFrame) -> DataFrame:
    """``(ROW, template, at, words)``: the windows to compare.

    ``index`` has word, template, low, high (places of the window's first word
    relative to the word), size, begins (words a window may begin with, null
    for any), needs and least (it holds so many of these words).  A window that
    several words lead to comes several times, which leaves its direction as it is.
    """
    hits = files.select(ROW, F.col("words").alias("_w"), F.posexplode("words").alias("_i", "word")).join(F.broadcast(index), "word")
    places = F.sequence(F.greatest(F.col("_i") + F.col("low"), F.lit(0)), F.greatest(F.col("_i") + F.col("high"), F.lit(0)))
    places = F.filter(places, lambda b: F.col("begins").isNull() | F.array_contains("begins", F.element_at("_w", b + 1)))
    cut = hits.select(ROW, "_w", "template", "size", "needs", "least", F.explode(places).alias("at"))
    cut = cut.select(ROW, "template", "at", "needs", "least", F.slice("_w", F.col("at") + 1, F.col("size")).alias("words"))
    return cut.where(F.size(F.array_intersect("needs", "words")) >= F.col("least")).drop("needs", "least")


def best_templates(files: DataFrame, threshold: float) -> DataFrame:
    """``(ROW, license, score, at)`` of the rows of :func:`tokens` that have a license."""
    spark, listed = files.sparkSession, templates()
    vocabulary = sorted({w for *_, held in listed for w in held})
    df, n = frequencies(files, spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    idf = {w: math.log((1.0 + n) / (1.0 + df.get(w, 0))) + 1 for w in vocabulary}
    vectors, facts, index = [], [], []
    for i, (name, source, full, held) in enumerate(listed):
        needs = [] if full else sorted(set(held) & NAMES)
        weights = {w: k * idf[w] for w, k in sorted(Counter(held).items())}
        vectors += [(i, w, v) for w, v in weights.items()]
        facts.append((i, name, name in VAGUE or source in VAGUE, math.sqrt(sum(v * v for v in weights.values()))))
        if full:
            marks = landmarks(held, df)
            index += [(w, i, -o, -o, len(held), None, [x for x, _ in marks], min(LANDMARKS, len(marks))) for w, o in marks]
        else:
            some = [min(needs, key=lambda w: (df.get(w, 0), w))] if needs else prefix_words(weights, df, threshold)
            index += [(w, i, 1 - len(held), 0, len(held), sorted(weights), needs, len(needs)) for w in some]
    # all four tables are as large as the fixed list of templates
    weight = F.broadcast(spark.createDataFrame(vectors, "template int, word string, weight double"))
    fact = F.broadcast(spark.createDataFrame(facts, "template int, license string, vague boolean, norm double"))
    rare = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    window = [ROW, "template", "at"]
    places = spark.createDataFrame(index, "word string, template int, low int, high int, size int, begins array<string>, needs array<string>, least int")
    tf = windows(files, places).select(*window, F.explode("words").alias("word")).groupBy(*window, "word").agg(F.count("*").alias("tf"))
    tf = tf.join(rare, "word", "left").withColumn("u", F.col("tf") * F.coalesce("idf", F.lit(math.log(1.0 + n) + 1)))
    both = tf.join(weight, ["template", "word"], "left").groupBy(*window).agg(F.sum(F.col("u") * F.col("weight")).alias("dot"), F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("size"))
    scored = both.join(fact, "template").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)).where(F.col("score") >= threshold)
    best = scored.groupBy(ROW).agg(F.min(F.struct("vague", (-F.col("score")).alias("_m"), "license", F.col("at").cast("long").alias("at"))).alias("_b"))
    return materialise(best.select(ROW, F.col("_b.license").alias("license"), (-F.col("_b._m")).alias("score"), F.col("_b.at").alias("at")), "licenses")


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.6) -> DataFrame:
    """``(key, license, score, at)``: the best template of each row that has one, and the word at which its window begins.

    A word that no template holds weighs as a word of no file.  A notice that
    names a license or a version matches only windows that hold these names.
    Templates that name no version or no terms give way to all others; ties go
    to the smaller license name, then to the earlier place.  Scores are rounded
    to six places.  Null and empty texts have no windows.  Every row is a file
    of its own, also with a null or repeated key.
    """
    files = tokens(docs, text, [key])
    found = best_templates(files, threshold)
    return files.select(key, ROW).join(evenly(found), ROW).select(key, "license", "score", "at")


def ancestors(path: Column) -> Column:
    """All ancestor directories of a path, nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def inherit(files: DataFrame, found: DataFrame, key: str = "doc_id", path: str = "path") -> DataFrame:
    """Add ``license``, ``score`` and ``from_path`` (where it comes from) to files with row ids.

    ``found`` has the licenses by row id.  A directory's license file is the
    file with a license of its own that lies directly in it; of several the one
    with the smallest key (null keys come last), then of the smallest path.
    A file's own license comes first (``from_path`` is its path), then that of
    the nearest ancestor directory.  Directories are distinct before they are
    joined to their ancestors, so large directories cost one row each.  Files
    with a null path inherit nothing; nulls mean that no license was found.
    """
    own = files.join(evenly(found.select(ROW, F.col("license").alias("_own"), F.col("score").alias("_score"))), ROW, "left")
    own = own.withColumn("_dir", F.element_at(ancestors(F.col(path)), 1))
    first = F.struct(F.col(key).isNull().alias("_z"), F.col(key).alias("_k"), F.col(path).alias("_p"), "_own", "_score")
    holders = own.where("_own IS NOT NULL AND _dir IS NOT NULL").groupBy(F.col("_dir").alias("_up")).agg(F.min(first).alias("_l"))
    dirs = own.where("_dir IS NOT NULL").select("_dir").distinct()
    chain = dirs.select("_dir", F.posexplode(F.concat(F.array("_dir"), F.when(F.instr("_dir", "/") > 0, ancestors(F.col("_dir"))).otherwise(F.array().cast("array<string>")))).alias("_far", "_up"))
    near = chain.join(evenly(holders), "_up").groupBy("_dir").agg(F.min(F.struct("_far", "_up", "_l")).alias("_n"))
    out = own.join(evenly(near), "_dir", "left")
    keep = [c for c in files.columns if c not in ("license", "score", "from_path", ROW)]
    return out.select(
        *keep,
        F.coalesce("_own", "_n._l._own").alias("license"),
        F.coalesce("_score", "_n._l._score").alias("score"),
        F.when(F.col("_own").isNotNull(), F.col(path)).otherwise(F.col("_n._up")).alias("from_path"),
    )


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "path", threshold: float = 0.6) -> DataFrame:
    """The columns of ``docs`` but the text, with ``license``, ``score`` and ``from_path``.

    :func:`detect` for every row, then :func:`inherit`; columns of these names
    are replaced.  Rows keep to themselves whatever their keys: of two rows
    with one key each gets the license of its own text or of its own path.
    """
    files = tokens(docs, text, [c for c in docs.columns if c not in (text, "words", "license", "score", "from_path")])
    return inherit(files.drop("words"), best_templates(files, threshold), key, path)

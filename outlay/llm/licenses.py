"""License scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies; DataFrame operations only.

Windows of ``WINDOW`` words start every ``STEP`` words, of texts as of templates. A shingle that
a text shares with a template lies inside one such window whole. Bands have one row each:
a window that shares s of all u shingles with one of a template's collides in some band with
probability 1 - (1 - s / u) ** BANDS. The least there can be is one shingle of the window's
twelve (a template of five words in the middle of other text): 1 - (11 / 12) ** 160 > 0.999999.

Only windows around an anchor word are hashed. Anchors are chosen so that each shingle of
each template has one; a window without any shares nothing with a template, so none is lost.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.common import stored

SHINGLE, WINDOW, STEP, BANDS = 5, 16, 8, 160
#: Bands of all templates' windows that may be broadcast, about 40 bytes each; beyond, windows meet them by a shuffle.
MOST_BANDS = 1 << 20

# Notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Licenses whose notices are those of ``TEMPLATES`` but for a few words; with them, each is reported by its own name.
SIBLINGS = {
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": TEMPLATES["BSD-3-Clause"],
    "BSD-3-Clause": TEMPLATES["BSD-3-Clause"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: What tells a template from its siblings: each of these runs of words must stand in the place that matches.
NEEDS = {
    "AGPL-3.0 header": ("gnu affero general public license", "version 3 of the license"),
    "Apache-2.0 header": ("apache license version 2 0",),
    "BSD-3-Clause": ("to endorse or promote products derived from this software",),
    "CC-BY-4.0": ("creative commons attribution 4 0",),
    "GPL-2.0": ("gnu general public license version 2",),
    "GPL-2.0 header": ("gnu general public license", "version 2 of the license"),
    "GPL-3.0": ("gnu general public license version 3",),
    "GPL-3.0 header": ("gnu general public license", "version 3 of the license"),
    "LGPL-2.1 header": ("gnu lesser general public license", "version 2 1 of the license"),
    "LGPL-3.0 header": ("gnu lesser general public license", "version 3 of the license"),
    "MPL-2.0": ("mozilla public license v 2 0",),
}
#: All templates that a scan looks for unless it is given others.
ALL = TEMPLATES | SIBLINGS
#: Words of a text that places are dealt by, to be compared with others near them.
NEAR = 64
#: Words too common to look for, where a shingle has another.
COMMON = frozenset("a an and any are as at be by can for from if in is it may not of on one or the this to under use was which with without you".split())


def _plain_words(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def anchors(templates: dict[str, str]) -> list[str]:
    """Few words of which each shingle of the templates has one; uncommon words first."""
    open_ = {tuple(w[i : i + SHINGLE]) for w in map(_plain_words, templates.values()) for i in range(len(w) - SHINGLE + 1)}
    out = []
    while open_:
        counts = Counter(x for s in open_ for x in set(s))
        word = min(counts, key=lambda x: (x in COMMON or len(x) < 3, -counts[x], x))
        out.append(word)
        open_ = {s for s in open_ if word not in s}
    return sorted(out)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Distinct shingles as text; none where there are too few words."""
    starts = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    each = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(each)).otherwise(F.expr("cast(array() as array<string>)"))


def _bands(shingles: Column) -> Column:
    """One minimum a band, tied to the band's number."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))))


def rivals(templates: dict[str, str]) -> list[tuple[str, str]]:
    """Pairs of templates of different licenses (the name's first word) that share a shingle, both ways round."""
    of = {k: {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for k, w in ((k, _plain_words(t)) for k, t in templates.items())}
    return [(a, b) for a in of for b in of if a.split()[0] != b.split()[0] and of[a] & of[b]]


def _told_apart(spark: SparkSession, hits: DataFrame, templates: dict[str, str]) -> DataFrame:
    """The places that no overlapping place of a rival explains better, by the number of distinct shingles."""
    pairs = rivals(templates)
    if not pairs:
        return hits
    hits = stored(spark, hits.withColumn("hit", F.monotonically_increasing_id()), "hits")
    blocks = F.explode(F.sequence(F.floor(F.col("first_word") / NEAR), F.floor((F.col("end_word") - 1) / NEAR)))
    listed = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("rival")) for a, b in pairs])).alias("p")).select("p.*")
    own = hits.select("row", "hit", "license", "first_word", "end_word", "shared", blocks.alias("block")).join(F.broadcast(listed), "license")
    # places that differ in their window alone are one
    other = hits.groupBy("row", "license", "first_word", "end_word").agg(F.max("shared").alias("its_shared"))
    other = other.select("row", F.col("license").alias("rival"), F.col("first_word").alias("its_first"), F.col("end_word").alias("its_end"), "its_shared", blocks.alias("block"))
    beaten = own.join(other, ["row", "rival", "block"]).where("first_word < its_end and its_first < end_word and its_shared > shared").select("hit").distinct()
    return hits.join(beaten, "hit", "left_anti")


def scan(
    spark: SparkSession,
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.8,
    needs: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """One row per document and license found: ``doc_id``, ``license``, ``containment``, ``first_word``, ``end_word``.

    Words are runs of a-z and 0-9 of the lower-cased text. Around each window that retrieves
    a template of m words, the part from m words before it to m words behind it is compared
    exactly: containment is the share of the template's distinct five-word shingles that
    are in that part, ``least`` or more of them. Of several parts the one with the largest
    containment, then the first, is returned, with the words from its first to its last common shingle.
    By containment alone a text also matches the siblings of its license: "version 3" shares 7 of 8
    shingles with "version 2". With ``needs`` (runs of words by template, see ``NEEDS``) they are told apart: a place
    counts only if all runs of its template are between its first and last common shingle, and if no overlapping
    place of a rival (see ``rivals``) has more shingles in common; of equals both count. Without ``templates`` all known ones
    are sought and told apart; with templates of one's own and no ``needs`` containment alone decides.
    Null texts and texts under five words have no license. Rows that repeat an id count as one
    document. Templates under five words are not allowed. Other columns play no part. The templates are a
    list in the program; their index is broadcast while it has ``MOST_BANDS`` rows at most, and joined by shuffle otherwise.
    """
    if templates is None:
        templates, needs = ALL, NEEDS if needs is None else needs
    if any(len(_plain_words(t)) < SHINGLE for t in templates.values()):
        raise ValueError(f"a template has fewer than {SHINGLE} words")
    if not templates:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).alias("end_word")).limit(0)
    seek = anchors(templates)
    bands = BANDS * sum(max(0, len(_plain_words(t)) - SHINGLE) // STEP + 1 for t in templates.values())
    beside = F.broadcast if bands <= MOST_BANDS else lambda table: table
    listed = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in templates.items()])).alias("t")).select("t.*")
    words = F.col("words")
    listed = listed.select("license", _words(F.col("text")).alias("words")).select("license", "words", F.size("words").alias("m"), _shingles(words).alias("of_template"))
    windows = lambda n: F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)), F.lit(STEP))
    cut = lambda at: F.slice(F.col("words"), at + 1, F.lit(WINDOW))
    index = listed.select("license", "m", "of_template", "words", F.explode(windows(F.size("words"))).alias("at")).select("license", "m", "of_template", F.explode(_bands(_shingles(cut(F.col("at"))))).alias("band")).distinct()

    # texts with an anchor, their words, and the windows that have one
    pattern = rf"(?i)(?<![a-z0-9])(?:{'|'.join(seek)})(?![a-z0-9])"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(pattern))
    texts = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("words"))
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(seek), i)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p / STEP) - 1, F.floor(p / STEP)))))
    near = F.filter(F.transform(near, lambda j: (j * STEP).cast("int")), lambda at: (at >= 0) & (at <= F.size("words") - SHINGLE))
    texts = stored(spark, texts.select("doc_id", "row", "words", near.alias("near")).where(F.size("near") > 0), "anchored")
    # a window's words are cut out before windows become rows; hashing them is the work, so they are dealt over all tasks
    near_windows = F.transform("near", lambda at: F.struct(at.alias("at"), F.slice(words, at + 1, F.lit(WINDOW)).alias("window")))
    candidates = texts.select("row", F.inline(near_windows)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "at")
    candidates = candidates.select("row", "at", F.explode(_bands(_shingles(F.col("window")))).alias("band"))
    found = candidates.join(beside(index.select("band", "license")), "band").select("row", "at", "license").distinct()
    found = found.join(beside(listed.select("license", "m", "of_template")), "license")
    # exact containment in the part around each retrieved window
    part = found.join(texts.select("doc_id", "row", "words"), "row").withColumn("from", F.greatest(F.col("at") - F.col("m"), F.lit(0)))
    length = F.col("at") + WINDOW + F.col("m") - F.col("from")
    part = part.select("doc_id", "row", "license", "at", "from", "of_template", F.slice(words, F.col("from") + 1, length).alias("words"))
    every = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.array_join(F.slice(words, i + 1, F.lit(SHINGLE)), " "))
    part = part.withColumn("common", F.filter(F.transform(every, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: F.array_contains(F.col("of_template"), x["s"])))
    share = F.size(F.array_distinct(F.transform("common", lambda x: x["s"]))) / F.size("of_template")
    hits = part.withColumn("containment", share).where(F.col("containment") >= least)
    first, end = F.col("from") + F.array_min(F.transform("common", lambda x: x["i"])), F.col("from") + F.array_max(F.transform("common", lambda x: x["i"])) + SHINGLE
    hits = hits.withColumns({"first_word": first, "end_word": end})
    if needs is not None:
        wanted = F.lit(True)
        place = F.concat(F.lit(" "), F.array_join(F.slice(words, F.col("first_word") - F.col("from") + 1, F.col("end_word") - F.col("first_word")), " "), F.lit(" "))
        for name, runs in needs.items():
            for run in runs:
                wanted = wanted & ((F.col("license") != name) | F.col("place").contains(f" {' '.join(_plain_words(run))} "))
        shared = F.size(F.array_distinct(F.transform("common", lambda x: x["s"])))
        hits = hits.withColumn("place", place).where(wanted).select("doc_id", "row", "license", "at", "containment", shared.alias("shared"), "first_word", "end_word")
        hits = _told_apart(spark, hits, templates)
    best = hits.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("before"), "first_word", "end_word")).alias("best"))
    return best.select("doc_id", "license", "best.containment", "best.first_word", "best.end_word")

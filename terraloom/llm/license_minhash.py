"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Only DataFrame functions. Texts become lower-case words of letters and digits. Templates and windows are sets of shingles of five
words (a shorter template is one shingle of all its words). For a template of ``n`` words the windows hold ``n + 2 * ceil(n / 4)`` words
and start every ``ceil(n / 4) + 1`` words, so each place of the template lies in a window with room for inserted words. A window that
contains four fifths of a template has a likeness to it of 0.2 at least, and ``BANDS`` bands of one minimum each meet with a probability
of at least 1 - 0.8 ** 64, above 0.999999. A window meets the templates of its length in the small, fixed template table and keeps those
that share a band with it; each such candidate is verified once and counts if the window holds at least ``CONTAINMENT`` of the
template's shingles and every *separating phrase* of the template word for word. Those phrases tell variants apart whose notices differ
in a word or a number only (GPL, LGPL and AGPL, versions 2, 2.1 and 3, the Creative Commons licenses).

Covered are the notices and the telling sentences or titles of the bodies in ``TEMPLATES``, and SPDX lines of the ids in ``SPDX_IDS``. A
sentence that several licenses share has the name of the family (BSD, GNU).

Windows without any *needed word* are not built: the needed words of a template are chosen such that more than a fifth of its shingles
hold one, so a window without them cannot contain four fifths. This loses nothing and spares most texts the windows.

Defined cases: null and empty texts match nothing; a null doc_id is kept as null; repeated rows give their matches each; very long texts
are cut into windows only around needed words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8
# fixed values: notices, titles and sentences of public licenses, and the phrases that separate their variants
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ()),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ()),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of", ()),
    ("MIT", "Released under the MIT License", ()),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ()),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("license version 3",)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ("license version 2",)),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 2 1 of the license")),
    ("LGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 3 of the license")),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", ("gnu affero general public license", "version 3 of the license")),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", ("gnu general public license version 2 june",)),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", ("gnu general public license version 3",)),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", ("gnu lesser general public license version 2 1",)),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", ("gnu lesser general public license version 3",)),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", ("gnu affero general public license version 3",)),
    ("GNU", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", ()),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ()),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ()),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ()),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("attribution 4 0",)),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("attribution noderivatives 4 0",)),
    ("CC0-1.0", "CC0 1.0 Universal", ()),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work", ()),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ()),
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ()),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("license v 2 0",)),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0", ("license 2 0",)),
    ("EPL-1.0", "made available under the terms of the Eclipse Public License v1.0", ("license v1 0",)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ()),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ()),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", ()),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ()),
    ("All-rights-reserved", "All rights reserved", ()),
)
SPDX_IDS = (
    "Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "EPL-2.0", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "Zlib", "BSL-1.0", "Unlicense",
)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}", ()) for name in SPDX_IDS)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def shingle_size(n: int) -> int:
    return min(SHINGLE, n)


def window_shape(n: int) -> tuple[int, int]:
    """(words in a window, words from one start to the next) for a template of n words."""
    quarter = math.ceil(n / 4)
    return n + 2 * quarter, quarter + 1


def needed_words(words: list[str], containment: float = CONTAINMENT) -> set[str]:
    """Words, long ones first, until more than 1 - containment of the shingles hold one of them."""
    size = shingle_size(len(words))
    shingles = [words[i : i + size] for i in range(len(words) - size + 1)]
    chosen: set[str] = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        chosen.add(w)
        if sum(bool(chosen & set(s)) for s in shingles) > (1 - containment) * len(shingles) + 1e-9:
            break
    return chosen


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of the word shingles of an array of words; none if it is shorter than a shingle."""
    count = F.size(words) - size + 1
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, size)))))


def bands_of(hashes: Column, bands: int = BANDS) -> Column:
    """One number for each band: the minimum under the band's hash function, hashed with the band's number."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(bands)), lambda j: F.xxhash64(j, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))
    )


def template_table(spark: SparkSession, templates=TEMPLATES, bands: int = BANDS) -> DataFrame:
    """(template, license_id, n, phrases, template_hashes, template_bands): one row per template, a few dozen at most."""
    rows = [(k, name, len(words_of(text)), words_of(text), [f" {p} " for p in phrases]) for k, (name, text, phrases) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, license_id string, n int, words array<string>, phrases array<string>")
    hashes = F.when(F.col("n") < SHINGLE, F.array(F.xxhash64(F.concat_ws(" ", "words")))).otherwise(shingle_hashes(F.col("words"), SHINGLE))
    table = table.withColumn("template_hashes", hashes)
    return table.select("template", "license_id", "n", "phrases", "template_hashes", bands_of(F.col("template_hashes"), bands).alias("template_bands"))


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """(doc_id, license_id, containment, first_word, n_windows): the licenses of every whole text that has one."""
    lists = [words_of(text) for _, text, _ in templates]
    needed = sorted(set().union(*[needed_words(w, containment) for w in lists]))
    lengths = sorted({len(w) for w in lists})
    low = F.lower("text")
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).filter(low.rlike("|".join(needed)))
    rows = rows.select("row", "doc_id", F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("hits", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.element_at("words", i + 1).isin(needed)))

    def windows(n: int) -> Column:
        size, step = window_shape(n)
        around = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(
            F.ceil(F.greatest(x - (size - 1), F.lit(0)) / step).cast("int"), F.greatest(F.floor(x / step), F.ceil(F.greatest(x - (size - 1), F.lit(0)) / step)).cast("int"),
        ))))
        starts = F.filter(around, lambda k: k * step <= F.greatest(F.size("words") - n, F.lit(0)))
        return F.transform(starts, lambda k: F.struct(F.lit(n).alias("n"), (k * step).cast("int").alias("start"), F.slice(F.col("words"), k * step + 1, size).alias("part")))

    parts = rows.select("row", "doc_id", F.explode(F.concat(*[windows(n) for n in lengths])).alias("w")).select("row", "doc_id", "w.*")
    hashes = F.lit(None).cast("array<bigint>")
    for size in sorted({shingle_size(n) for n in lengths}):
        chosen = (F.col("n") < SHINGLE) & (F.col("n") == size) if size < SHINGLE else F.col("n") >= SHINGLE
        hashes = F.when(chosen, shingle_hashes(F.col("part"), size)).otherwise(hashes)
    parts = parts.select("row", "doc_id", "n", "start", "part", hashes.alias("hashes")).filter(F.size("hashes") > 0)
    parts = parts.withColumn("bands", bands_of(F.col("hashes"), bands))
    # a fixed list of templates, a few of each length
    candidates = parts.join(F.broadcast(template_table(docs.sparkSession, templates, bands)), "n").filter(F.arrays_overlap("bands", "template_bands"))
    share = F.size(F.array_intersect("hashes", "template_hashes")) / F.size("template_hashes")
    window_text = F.concat(F.lit(" "), F.concat_ws(" ", "part"), F.lit(" "))
    found = candidates.withColumn("share", share).filter(F.col("share") >= containment)
    found = found.filter(F.forall("phrases", lambda p: F.contains(window_text, p)))
    return found.groupBy("row", "doc_id", "license_id").agg(
        F.max("share").alias("containment"), F.min("start").alias("first_word"), F.count_distinct("n", "start").alias("n_windows")
    ).select("doc_id", "license_id", F.round("containment", 6).alias("containment"), "first_word", "n_windows")


def oracle_sql(templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same result by counting every template shingle in every window, without bands or needed words."""
    lists = [(k, name, words_of(text), "|".join(phrases)) for k, (name, text, phrases) in enumerate(templates)]
    values = ", ".join(f"({k}, '{name}', {len(w)}, {shingle_size(len(w))}, {window_shape(len(w))[0]}, {window_shape(len(w))[1]}, '{' '.join(w)}', '{p}')" for k, name, w, p in lists)
    return f"""
WITH template(id, license_id, n, k, size, step, words, phrases) AS (VALUES {values}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
parts AS (SELECT *, string_split(words, ' ') AS tw FROM template),
shingles AS (SELECT DISTINCT id, license_id, n, k, size, step, array_to_string(tw[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM parts)),
totals AS (SELECT id, count(*) AS total FROM shingles GROUP BY id),
seen AS (
  SELECT r, doc_id, k, len(w) AS n_words, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM docs, (SELECT DISTINCT k FROM template))
),
hit AS (SELECT r, doc_id, n_words, pos, id, license_id, n, size, step, t.k AS k, s FROM seen JOIN shingles t USING (k, s)),
spread AS (SELECT *, unnest(range(CAST(ceil(greatest(pos - (size - k), 0) / step) AS BIGINT), CAST(floor(pos / step) AS BIGINT) + 1)) * step AS start FROM hit),
counted AS (
  SELECT r, doc_id, id, license_id, n, start, count(DISTINCT s) AS c FROM spread WHERE start <= greatest(n_words - n, 0) GROUP BY ALL
)
SELECT doc_id, license_id, round(max(c / total), 6) AS containment, CAST(min(start) AS INTEGER) AS first_word, count(DISTINCT (n, start)) AS n_windows
FROM (
  SELECT c.*, total, phrases, ' ' || array_to_string(w[start + 1 : start + size], ' ') || ' ' AS part
  FROM counted c JOIN totals USING (id) JOIN template t USING (id) JOIN docs d USING (r) WHERE c / total >= {containment}
) WHERE phrases = '' OR len(list_filter(string_split(phrases, '|'), lambda p: NOT contains(part, ' ' || p || ' '))) = 0
GROUP BY r, doc_id, license_id
"""

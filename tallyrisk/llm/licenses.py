"""Licence notices found by MinHash over overlapping windows of word shingles.

Words are runs of letters and digits, A-Z lower-cased; shingles are five words. Templates of up to
2^c shingles are looked for in windows of 2 * 2^c shingles that start every 2^c shingles, so an
occurrence lies whole in some window. A window has MinHash values of one row each, and meets the
templates that share a value. A template of n shingles, 80 % of which lie in a window of at most 2w others
and these, has a Jaccard similarity of 0.8 n / (2w + 0.2 n) or more: between 0.19 where n is just over half of w,
and 0.36 where n is w. Each width has as many bands as its smallest template needs to be missed with a probability
of at most 10^-6 (31 to 66). Windows and templates that meet are compared: a template is found if the window
holds at least 80 % of its shingles.

Windows without a single template shingle cannot match and are not hashed.

Defined results: null and empty texts, and texts under five words, hold no licence; templates under
five words are refused; repeated rows each get the result; long texts are cut into windows whole; several
templates of one licence count as one name; extra columns are not carried along; an empty table gives
an empty table. Only built-in functions run on the tables, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import store

SHINGLE = 5
MISS = 1e-6  # of a whole notice, or of 80 % of one
CONTAINMENT = 0.8
MOST_SHINGLES = 50_000  # of all templates; they are part of the query plan

# Wording of notices in common use.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
                   " compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
            " the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
            " Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
             " Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
                 " General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
            " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
            " Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED"
            " TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
            " provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
            " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on"
                   " an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
                  " compile, sell, or distribute this software"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def templates_table(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")


def _word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9\\x80-\\x{10FFFF}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


SHINGLES = (f"transform(slice(word_hashes, 1, greatest(size(word_hashes) - {SHINGLE - 1}, 0)), (w, i) -> xxhash64(w, "
            + ", ".join(f"get(word_hashes, i + {k})" for k in range(1, SHINGLE)) + "))")


def bands_for(shingles: int, width: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """How many MinHash values a template of this size needs in windows of twice the width."""
    similar = containment * shingles / (2 * width + (1 - containment) * shingles)
    return math.ceil(math.log(miss) / math.log(1 - similar)) if similar < 1 else 1


def _bands(shingles: str, bands: str) -> Column:
    return F.expr(f"transform(sequence(0, {bands} - 1), b -> array_min(transform({shingles}, x -> xxhash64(x, b))))")


def template_shingles(templates: DataFrame) -> DataFrame:
    """template, license, shingles (distinct) and width, the window step its size asks for."""
    found = templates.select("template", "license", _word_hashes(F.col("text")).alias("word_hashes"))
    found = found.select("template", "license", F.array_distinct(F.expr(SHINGLES)).alias("shingles"))
    return found.withColumn("width", F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int"))


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """One row per row of `docs`: doc_id, licenses (sorted names), n_templates (templates found)."""
    wanted = store(template_shingles(templates), "templates")
    held = wanted.select("template", "width", F.col("shingles")).collect()
    if any(not r["shingles"] for r in held):
        raise ValueError("a template has fewer than five words")
    known = sorted({x for r in held for x in r["shingles"]})
    if len(known) > MOST_SHINGLES:
        raise ValueError("too many templates for one scan; split them")
    widths = sorted({r["width"] for r in held})
    needed = {w: max(bands_for(len(r["shingles"]), w, containment, miss) for r in held if r["width"] == w) for w in widths}
    bands = "case " + " ".join(f"when width = {w} then {n}" for w, n in needed.items()) + " end"
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), _word_hashes(F.col("text")).alias("word_hashes"))
    rows = rows.select("doc_id", "digest", F.expr(SHINGLES).alias("all"))
    places = F.filter(F.transform("all", lambda x, i: F.when(x.isin(known), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "digest", "all", F.size("all").alias("n"), places.alias("places"))
    # the windows that hold a place: number j starts at j * width and is twice as wide
    spots = ", ".join(
        f"flatten(transform(places, p -> array(struct({w} as width, cast(floor(p / {w}) as int) as number),"
        f" struct({w} as width, cast(floor(p / {w}) as int) - 1 as number))))" for w in widths)
    cut = F.expr(f"transform(array_distinct(filter(concat({spots}), s -> s.number >= 0)), s -> struct("
                 "s.width as width, s.number as number, array_distinct(slice(all, s.number * s.width + 1, 2 * s.width)) as held))")
    # the outer form: Spark would turn a plain explode into a filter and hash the text again for it
    windows = rows.select("doc_id", "digest", F.explode_outer(cut).alias("w")).select("doc_id", "digest", "w.*").where("width is not null")
    windows = store(windows, "windows")
    banded = windows.select("*", F.posexplode(_bands("held", bands)).alias("band", "value"))
    index = wanted.select("template", "license", "width", "shingles", F.posexplode(_bands("shingles", bands)).alias("band", "value"))
    met = banded.join(F.broadcast(index), ["width", "band", "value"])  # at most 66 rows a template
    found = met.where(F.size(F.array_intersect("held", "shingles")) >= containment * F.size("shingles"))
    hits = found.select("doc_id", "digest", "template", "license").distinct().groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set("license")).alias("licenses"), F.count(F.lit(1)).alias("n_templates"))
    hits = hits.withColumnsRenamed({"doc_id": "_d", "digest": "_h"})
    base = docs.select("doc_id", F.xxhash64("text").alias("digest"))
    full = base.join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_h")), "left")
    return full.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
                       F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"))

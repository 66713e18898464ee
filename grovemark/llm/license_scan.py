"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A text's tokens are its lower-cased runs of letters and digits; shingles are five tokens. Templates fall into
classes by size; a class has windows as long as its largest template and a stride more, so that some window holds
the whole of any passage of a template's length. ``bands_for`` turns the Jaccard similarity that this guarantees
for a passage with enough of the template into a number of one-row bands, so that it is retrieved with probability
``RETRIEVE`` at least. Retrieved pairs are kept by exact containment alone. DataFrame expressions only.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SHINGLE, CONTAINED, RETRIEVE = 5, 0.8, 0.99999
#: Templates' shingles that one pass over the documents holds on every executor; larger sets take several passes.
MOST_SHINGLES = 200_000

#: Usual wordings of public licence notices.
NOTICES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def read_templates(folder: str) -> dict[str, str]:
    """Templates from the text files of a folder on the driver, each named by its file without the ending: whole licences, for example."""
    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def size_class(shingles: int) -> int:
    """The smallest power of two that is no less."""
    return 1 << max(0, shingles - 1).bit_length()


def window_of(cls: int) -> tuple[int, int]:
    """(length, stride) in shingles of the windows of a class."""
    stride = max(1, cls // 8)
    return cls + stride - 1, stride


def bands_for(classes: list[int], contained: float = CONTAINED, retrieve: float = RETRIEVE) -> int:
    """One-row bands needed so that the least similar match of any class is retrieved with the given probability."""
    need = 1
    for cls in classes:
        length, _ = window_of(cls)
        least = cls // 2 + 1 if cls > 1 else 1
        shared = max(1, math.ceil(contained * least))
        similarity = min(1.0, shared / (least + length - shared))
        if similarity < 1:
            need = max(need, math.ceil(math.log(1 - retrieve) / math.log(1 - similarity)))
    return need


def _hashes(w: Column, n: int = SHINGLE) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))


def _minima(h: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(h, lambda x: F.xxhash64(x, b))).alias("low")))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment (of the template's shingles in the best window), at_token, n_windows, by document and template.

    at_token: the first token of the earliest of the best windows that belongs to the template. n_windows: windows that
    verify. Null texts, and texts or templates of fewer than five tokens, match nothing. Rows that repeat a doc_id are one
    document in the result. Other columns are ignored. Documents without a match have no row; no documents, no rows.
    Templates of more than MOST_SHINGLES shingles in all are looked for in several passes over the documents.
    """
    found = {k: tokens(v) for k, v in (NOTICES if templates is None else templates).items()}
    passes: list[list[tuple[str, list[str]]]] = []
    held = 0
    for k, w in found.items():
        if len(w) < SHINGLE:
            continue
        if not passes or held + len(w) > MOST_SHINGLES:
            passes.append([])
            held = 0
        passes[-1].append((k, w))
        held += len(w)
    if not passes:
        return docs.where("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("at_token"), F.lit(0).cast("long").alias("n_windows"))
    return reduce(DataFrame.union, [_scan(docs, rows, contained) for rows in passes])


def _scan(docs: DataFrame, rows: list[tuple[str, list[str]]], contained: float) -> DataFrame:
    """One pass with the templates (name, tokens) in ``rows``."""
    spark: SparkSession = docs.sparkSession
    sizes = {k: len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}) for k, w in rows}
    classes = sorted({size_class(n) for n in sizes.values()})
    bands = bands_for(classes, contained)
    known = spark.createDataFrame([(k, w, size_class(sizes[k])) for k, w in rows], "license string, _tw array<string>, _class int").coalesce(1)
    known = known.select("license", "_class", F.array_distinct(_hashes(F.col("_tw"))).alias("_t"))
    keys = known.select("license", "_class", "_t", F.inline(_minima(F.col("_t"), bands)))
    by_class = {c: [] for c in classes}
    for c, h in known.select("_class", F.explode("_t")).distinct().collect():  # at most MOST_SHINGLES
        by_class[c].append(h)
    marks = {c: F.lit(h) for c, h in by_class.items()}

    plain = docs.select("doc_id", F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "^[^\\p{L}\\p{N}]+", ""), "[^\\p{L}\\p{N}]+").alias("_w"))
    plain = plain.withColumn("_h", F.when(F.size("_w") >= SHINGLE, _hashes(F.col("_w"))))
    # A window without any template's shingle contains none of a template. explode_outer keeps Catalyst from moving the
    # test below the hashes, where it would compute the words anew for every shingle.
    every = F.lit(sorted({h for x in by_class.values() for h in x}))
    plain = plain.select("doc_id", F.explode_outer(F.when(F.arrays_overlap("_h", every), F.array("_h"))).alias("_h")).where("_h IS NOT NULL")

    def among(mark: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains(mark, F.get("_h", i)))

    at = {c: among(m) for c, m in marks.items()}
    hits = plain.select("doc_id", "_h", F.explode(F.array(*(F.struct(F.lit(c).alias("cls"), x.alias("hits")) for c, x in at.items()))).alias("_x"))
    hits = Scratch(spark).save(hits.select("doc_id", "_h", "_x.*").where(F.size("hits") > 0))  # few documents, dealt evenly again
    sized = {c: window_of(c) for c in classes}
    length = F.element_at(F.create_map(*(F.lit(x) for c in classes for x in (c, sized[c][0]))), F.col("cls"))
    stride = F.element_at(F.create_map(*(F.lit(x) for c in classes for x in (c, sized[c][1]))), F.col("cls"))
    hits = hits.withColumn("_len", length).withColumn("_by", stride)
    grid = F.flatten(F.transform("hits", lambda p: F.sequence(F.ceil((p - (F.col("_len") - 1)) / F.col("_by")).cast("int"), F.floor(p / F.col("_by")).cast("int"))))
    windows = hits.select("doc_id", "cls", "_h", "hits", "_len", F.explode(F.array_distinct(grid)).alias("_g"), "_by")
    start = F.col("_g") * F.col("_by")
    windows = windows.withColumn("from", F.greatest(start, F.lit(0))).withColumn("to", start + F.col("_len"))
    windows = windows.select("doc_id", "cls", "from", F.slice("_h", F.col("from") + 1, F.col("to") - F.col("from")).alias("_in"), F.filter("hits", lambda p: (p >= F.col("from")) & (p < F.col("to"))).alias("_hits"))
    retrieved = windows.withColumn("_keys", _minima(F.col("_in"), bands)).select("doc_id", "cls", "from", "_in", "_hits", F.inline("_keys"))
    pairs = retrieved.join(F.broadcast(keys), (retrieved["cls"] == keys["_class"]) & (retrieved["band"] == keys["band"]) & (retrieved["low"] == keys["low"]))
    share = F.size(F.array_intersect("_t", "_in")) / F.size("_t")
    first = F.try_element_at(F.filter("_hits", lambda p: F.array_contains("_t", F.get("_in", p - F.col("from")))), F.lit(1))
    kept = pairs.select("doc_id", "license", "from", share.alias("containment"), first.alias("at_token")).where(F.col("containment") >= contained)
    one = kept.groupBy("doc_id", "license", "from").agg(F.max("containment").alias("containment"), F.min("at_token").alias("at_token"))
    best = F.max(F.struct("containment", (-F.col("at_token")).alias("at")))
    out = one.groupBy("doc_id", "license").agg(best.alias("best"), F.count(F.lit(1)).alias("n_windows"))
    return out.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.at")).alias("at_token"), "n_windows")

"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

DataFrame functions only on the documents' path.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Published short notices and headers of licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of"
    " this software and associated documentation files, to deal in the Software without"
    " restriction",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may"
    " not use this file except in compliance with the License. You may obtain a copy of the"
    " License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under"
    " the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-header": "This work is licensed under a Creative Commons Attribution 4.0"
    " International License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without"
    " modification, are permitted provided that the following conditions are met",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public"
    " License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any"
    " purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}

NOT_WORD = "[^a-z0-9]+"


def bands_for(similarity: float, recall: float) -> int:
    """Bands of one row so that sets of this Jaccard similarity collide with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity))


def shingle_words(t: int) -> int:
    """Words of a shingle: two in templates of up to five words, three in longer ones."""
    return 2 if t <= 5 else 3


def least_similarity(t: int, containment: float) -> float:
    """Jaccard of a template of t words and a window of 2t words that contains so much of it."""
    n = shingle_words(t)
    own, window = t - n + 1, 2 * t - n + 1
    return containment * own / (window + own * (1 - containment))


def license_words(text: Column) -> Column:
    cleaned = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.array_remove(cleaned, "")


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words; none for fewer words."""
    return F.when(
        F.size(words) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - n),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def min_hashes(shingles: Column, bands: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))),
    )


def template_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """(license, t, template_shingles), a row per template of two words or more."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    w = F.col("words")
    worded = rows.select("license", license_words(F.col("text")).alias("words"))
    return worded.where(F.size(w) >= 2).select(
        "license",
        F.size(w).alias("t"),
        F.array_distinct(
            F.when(F.size(w) <= 5, shingles_of(w, 2)).otherwise(shingles_of(w, 3))
        ).alias("template_shingles"),
    )


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    containment: float = 0.8,
    recall: float = 0.999999,
) -> DataFrame:
    """License texts found in documents: doc_id, license, containment, first_word, n_windows.

    For a template of t words, windows of 2t words start at every t // 2-th word. Windows
    and templates that agree in one of the MinHash bands are compared exactly: the share of
    the template's shingles that the window has. A window without a shingle of a template
    cannot agree with it in a band, so only windows around such shingles are hashed.

    Columns used: doc_id, text. Null, empty and one-word texts have no match. Rows that
    repeat an id are scanned apart. ``first_word`` numbers the words (runs of ASCII
    letters and digits, in lower case) from 0 and is the start of the first window that
    matches. Templates are an argument, so what is broadcast does not grow with the data.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    known = table.collect()  # the argument's size
    bands = bands_for(min(least_similarity(r.t, containment) for r in known), recall)
    vocabulary: dict[int, set[int]] = {}
    for r in known:
        vocabulary.setdefault(r.t, set()).update(r.template_shingles)

    w = F.col("words")
    shingled = docs.select("doc_id", license_words(F.col("text")).alias("words")).select(
        "doc_id", *[shingles_of(w, n).alias(f"shingles{n}") for n in (2, 3)]
    )

    def hits(n: int) -> Column:
        s = F.col(f"shingles{n}")
        wanted = sorted({h for t, own in vocabulary.items() if shingle_words(t) == n for h in own})
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda p: F.get(s, p).isin(wanted))
        return F.when(F.size(s) > 0, found).otherwise(F.array().cast("array<int>"))

    # the row number keeps the filter above this projection: below it, the optimizer would
    # repeat the split of the text for every word
    touched = shingled.withColumns(
        {"row": F.monotonically_increasing_id(), "hits2": hits(2), "hits3": hits(3)}
    ).where((F.size("hits2") > 0) | (F.size("hits3") > 0))

    def starts(t: int) -> Column:
        n, step = shingle_words(t), max(1, t // 2)
        s = F.col(f"shingles{n}")
        own = F.filter(f"hits{n}", lambda p: F.get(s, p).isin(sorted(vocabulary[t])))
        first = lambda p: F.greatest(
            F.lit(0), F.ceil((p - 2 * t + n) / step).cast("int")
        )
        last = lambda p: F.floor(p / step).cast("int")
        ids = F.flatten(F.transform(own, lambda p: F.sequence(first(p), last(p))))
        return F.transform(
            F.array_distinct(ids),
            lambda j: F.struct(F.lit(t).alias("t"), (j * step).alias("at")),
        )

    window = lambda n: F.slice(
        f"shingles{n}", F.col("at") + 1, 2 * F.col("t") - n + 1
    )
    windows = touched.select(
        "row", "doc_id", "shingles2", "shingles3",
        F.inline(F.flatten(F.array(*map(starts, sorted(vocabulary))))),
    ).select(
        "row", "doc_id", "t", "at",
        F.array_distinct(F.when(F.col("t") <= 5, window(2)).otherwise(window(3))).alias("own"),
    )
    hashed = windows.select("*", F.posexplode(min_hashes(F.col("own"), bands)).alias("band", "low"))
    template_bands = table.select(
        "*", F.posexplode(min_hashes(F.col("template_shingles"), bands)).alias("band", "low")
    )
    shared = F.size(F.array_intersect("own", "template_shingles"))
    return (
        hashed.join(F.broadcast(template_bands), ["t", "band", "low"])
        .withColumn("part", shared / F.size("template_shingles"))
        .where(F.col("part") >= containment)
        .groupBy("row", "doc_id", "license", "at")
        .agg(F.max("part").alias("part"))
        .groupBy("row", "doc_id", "license")
        .agg(
            F.round(F.max("part"), 6).alias("containment"),
            F.min("at").cast("long").alias("first_word"),
            F.count("*").alias("n_windows"),
        )
        .drop("row")
    )

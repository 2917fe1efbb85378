"""License scanning: MinHash bands over overlapping windows, then exact containment.

Texts become lower-case runs of letters and digits.  A template of ``L`` words is
sought in windows of ``L`` words plus a quarter, which start every quarter of
``L`` words, so that any stretch of ``L`` words lies whole in some window.  A window
that holds at least 0.8 of a template's shingles then has Jaccard similarity of at
least `LEAST_JACCARD` with it; with `BANDS` bands of `ROWS` hashes the chance that
no band agrees is below one in a million.  Windows that share a band with a
template of their width are verified: the exact share of the template's shingles
which the window holds decides.

A window can hold 0.8 of a template only if it holds one of its shingles at least.
Windows of a length are therefore made around the positions where a text has a
shingle of a template of that length, an exact saving: texts without any end after one scan.

Everything is built-in functions.  The templates are a fixed list, so the tables
that are broadcast (a row per template and band) don't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import text as T

SHINGLE = 5
CONTAINED = 0.8
BANDS, ROWS = 40, 2
#: Of a template and a window of its width that holds 0.8 of it, over all lengths: 0.8 / (1 + 1.25 - 0.8).
LEAST_JACCARD = 0.55

#: Notices, tags and sentences of full texts by license (fixed values, public texts).  A text that holds a whole
#: license holds its sentences, so licenses are found by these and not by their full length.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "lgpl-3.0": (
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "agpl-3.0": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-sa-3.0": (
        "Licensed under CC BY-SA 3.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0 1. Definitions",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "all-rights-reserved": ("All rights reserved.",),
}


def license_words(text: Column) -> Column:
    """Runs of letters and digits of a non-null text, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, width: int) -> Column:
    """Hash of the ``width`` words from each position on; none if there are fewer words."""
    return T.bound(
        words,
        lambda w: F.when(
            F.size(w) >= width,
            F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[w[i + k] for k in range(width)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def min_hashes(shingles: Column) -> Column:
    """One minimum per row of each band, each under a hash function of its own."""
    seeds = F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1))
    return F.transform(seeds, lambda s: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, s))))


def band_keys(shingles: Column) -> Column:
    """One key per band of the minima of a shingle set."""
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return T.bound(min_hashes(shingles), lambda m: F.transform(bands, lambda b: F.xxhash64(b, *[m[b * ROWS + r] for r in range(ROWS)])))


def template_table(spark: SparkSession, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``license, template, words, width, shingles`` of each template; shorter than a shingle, it is one shingle."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(f"{name}/{k}").alias("template"), F.lit(t).alias("text")) for name, texts in templates.items() for k, t in enumerate(texts)]
    listed = spark.range(1).select(F.inline(F.array(*rows)))
    cut = listed.withColumn("tokens", license_words(F.col("text"))).withColumn("words", F.size("tokens")).where("words > 0")
    shingles = F.lit(None).cast("array<bigint>")
    for width in range(1, SHINGLE + 1):
        fits = F.col("words") >= SHINGLE if width == SHINGLE else F.col("words") == width
        shingles = F.when(fits, F.array_distinct(shingle_hashes(F.col("tokens"), width))).otherwise(shingles)
    return cut.select("license", "template", "words", F.least("words", F.lit(SHINGLE)).alias("width"), shingles.alias("shingles"))


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, contained: float = CONTAINED
) -> DataFrame:
    """``doc_id, license, containment, n_windows, first_word``: a row per row of ``docs`` and license found.

    ``containment`` is the largest exact share of a template's shingles in a window,
    ``n_windows`` how many windows reach ``contained``, ``first_word`` where the first
    of these starts.  Null and empty texts hold no license; null ids stay, and rows
    that share an id (repeated rows, null ids) are reported together; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    # The list is fixed and small: a few values per template are read back and become literals of the plan.
    table = template_table(spark, templates).collect()
    by_width: dict[int, set[int]] = {}
    by_length: dict[tuple[int, int], set[int]] = {}
    for t in table:
        by_width.setdefault(t["width"], set()).update(t["shingles"])
        by_length.setdefault((t["words"], t["width"]), set()).update(t["shingles"])

    def hits(width: int) -> Column:
        """Positions of templates' shingles of this width, and their hashes."""
        known = sorted(by_width[width])
        places = F.transform(shingle_hashes(F.col("tokens"), width), lambda h, i: F.when(h.isin(*known), F.struct(i.alias("i"), h.alias("h"))))
        return F.filter(places, lambda x: x.isNotNull())

    rows = docs.select(F.col(id_col).alias("doc_id"), license_words(T.whole(F.col(text_col))).alias("tokens"))
    scanned = rows.select(
        "doc_id",
        "tokens",
        F.struct(*[hits(w).alias(f"w{w}") for w in sorted(by_width)]).alias("hits"),
    )
    some = None
    for w in sorted(by_width):
        found = F.size(f"hits.w{w}") > 0
        some = found if some is None else some | found
    # Few texts have a hit; what they need further is kept in a narrow table.
    near = store.keep(scanned.where(some) if some is not None else scanned.limit(0), "license-hits")

    def starts(words: int, width: int) -> Column:
        """Window starts near the hits: every `stride` words, such that some window holds any stretch of `words`."""
        stride, length = max(words // 4, 1), words + max(words // 4, 1) - 1
        known = sorted(by_length[words, width])
        reach = F.transform(
            F.filter(f"hits.w{width}", lambda x: x["h"].isin(*known)),
            lambda x: F.sequence(
                F.greatest(F.floor((x["i"] - (length - width) + stride - 1) / stride), F.lit(0)).cast("int"), F.floor(x["i"] / stride).cast("int")
            ),
        )
        return F.transform(
            F.array_distinct(F.flatten(reach)),
            lambda k: F.struct(F.lit(words).alias("words"), F.lit(width).alias("width"), (k * stride).alias("start"), F.lit(length).alias("length")),
        )

    windows = near.select("doc_id", "tokens", F.explode(F.concat(*[starts(n, w) for n, w in sorted(by_length)])).alias("at")).select(
        "doc_id", "at.*", F.slice("tokens", F.col("at.start") + 1, F.col("at.length")).alias("tokens")
    )
    shingles = F.lit(None).cast("array<bigint>")
    for w in sorted(by_width):
        shingles = F.when(F.col("width") == w, F.array_distinct(shingle_hashes(F.col("tokens"), w))).otherwise(shingles)
    windows = windows.select("doc_id", "words", "start", shingles.alias("shingles")).where(F.size("shingles") > 0)

    listed = template_table(spark, templates)
    filed = listed.select("license", "template", F.col("words").alias("t_words"), F.col("shingles").alias("t_shingles"), F.explode(F.array_distinct(band_keys(F.col("shingles")))).alias("band"))
    sought = windows.withColumn("w_band", F.explode(F.array_distinct(band_keys(F.col("shingles")))))
    share = F.size(F.array_intersect("shingles", "t_shingles")) / F.size("t_shingles")
    verified = (
        sought.join(F.broadcast(filed), (F.col("w_band") == F.col("band")) & (F.col("words") == F.col("t_words")))
        .withColumn("share", share)
        .where(F.col("share") >= contained)
    )
    return verified.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.countDistinct("template", "start").alias("n_windows"), F.min("start").cast("long").alias("first_word")
    )

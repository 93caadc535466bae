"""Licences of files: TF-IDF cosine to templates, then inheritance from directories.

Only DataFrame functions. A header is a sentence or line of a text that matches ``CUE``; its
terms are weighted by how often they occur and by how few of all files hold them (terms that no
template has weigh like terms in no file), and compared with the templates by cosine. Sentences,
lines and paragraphs that match ``HEADER_CUE`` are compared with ``HEADERS`` in the same way, and
the whole text of a file named as a licence file with the licence texts, whether or not it has a
header. One of ``HEADERS`` matches only if the passage holds its numbers (of a template of
``SHORT`` terms or fewer: all its terms), so that versions do not stand in for each other. The
best match at ``LIKE`` (texts: ``TEXT_LIKE``) or above is a file's own licence; one that states no
version (``GENERAL``) counts if there is no other. A file is a licence file if its name says so or
if its whole text is like one of ``TEMPLATES`` by ``WHOLE_LIKE`` or more; it then holds for its directory. A file without a licence of its own inherits that of the nearest directory above it.

Nulls and edges: a null or empty text has no header. A null path has no directory: nothing is
inherited. Ties go to the template whose name is first, among licence files of one directory to
the higher cosine, then to the first licence name and path. Repeated rows are judged alike; a
table without rows gives none. Of other columns only ``keep`` is carried on.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from punctual.llm.common import stored

#: Notices as licences ask for them: fixed texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0",
}
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} "
    "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GNU_OLD = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} "
    "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
)
_GNU_ONLY = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} "
    "version {} as published by the Free Software Foundation."
)


def _gnu(name: str, version: str) -> list[str]:
    long = name.replace("GPL", "General Public License")
    long = {"L": "Lesser ", "A": "Affero "}.get(name[0], "") + long.removeprefix("L").removeprefix("A")
    return [
        *[t.format(long, version) for t in (_GNU, _GNU_OLD, _GNU_ONLY)], f"GNU {long} version {version}",
        f"Licensed under the GNU {long}, version {version}", f"GNU {long} v{version}", f"GNU {name} v{version}",
        f"GNU {long} v{version}.0", f"License: {name}v{version}", f"{name}v{version} license",
        f"GNU {long.upper()} Version {version}, {_DATES[name, version]}",
    ]


_DATES = {
    ("GPL", "2"): "June 1991", ("GPL", "3"): "29 June 2007", ("LGPL", "2.1"): "February 1999",
    ("LGPL", "3"): "29 June 2007", ("AGPL", "3"): "19 November 2007",
}


def _cc(name: str, short: str) -> list[str]:
    return [
        f"Creative Commons {name} 4.0 International Public License", f"Creative Commons {name} 4.0 International License",
        f"This work is licensed under a Creative Commons {name} 4.0 International License",
        f"This work is licensed under the Creative Commons {name} 4.0 International License",
        f"Licensed under Creative Commons {name} 4.0", f"Licensed under {short} 4.0", f"This work is licensed under {short} 4.0",
        f"License: {short} 4.0", f"https://creativecommons.org/licenses/{short[3:].lower()}/4.0/",
        f"To view a copy of this license, visit https://creativecommons.org/licenses/{short[3:].lower()}/4.0/",
        f"To view a copy of this license, visit http://creativecommons.org/licenses/{short[3:].lower()}/4.0/",
    ]


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
#: Known by an SPDX line at least. Licences next to those above are there so that they are not taken for them.
SPDX = """0BSD AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0
GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MIT-0 MPL-1.1 MPL-2.0 Unlicense Zlib""".split()
#: A GNU licence that names no version may be taken in any.
GENERAL = ["GPL-1.0-or-later", "LGPL-2.0-or-later"]
#: Other forms of header: each is a template.
HEADERS = {
    "AGPL-3.0": [*_gnu("AGPL", "3"), "GNU Affero General Public License"],
    "Apache-2.0": [
        "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "License: Apache 2.0",
        "Apache License Version 2.0, January 2004", "Licensed under Apache 2.0", "Released under the Apache License 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file "
        "distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You "
        'under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-2-Clause": [
        _BSD, "BSD 2-Clause License", "Licensed under the BSD 2-Clause License", "Simplified BSD License", "License: BSD 2-Clause",
    ],
    "BSD-3-Clause": [
        _BSD + _BSD_3, _BSD_3, "BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License",
        "License: BSD 3-Clause", "Released under the BSD 3-Clause License", "3-clause BSD license",
    ],
    "CC-BY-4.0": _cc("Attribution", "CC BY"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "CC BY-NC"),
    "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "CC BY-ND"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "CC BY-SA"),
    "GPL-2.0": _gnu("GPL", "2"),
    "GPL-3.0": _gnu("GPL", "3"),
    "GPL-1.0-or-later": [
        "GNU General Public License", "it under the terms of the GNU General Public License as published by",
        "it under the terms of the GNU General Public License", "Licensed under the GNU General Public License", "GNU GPL license",
    ],
    "LGPL-2.1": _gnu("LGPL", "2.1"),
    "LGPL-3.0": _gnu("LGPL", "3"),
    "LGPL-2.0-or-later": [
        "GNU Lesser General Public License", "it under the terms of the GNU Lesser General Public License as published by",
        "it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License",
    ],
    "MIT": [
        "MIT License", "The MIT License", "The MIT License (MIT)", "Licensed under the MIT license", "License: MIT",
        "Distributed under the MIT License", "This project is licensed under the MIT License",
        "This software is released under the MIT License", "Available under the MIT License",
        "https://opensource.org/licenses/MIT", "Use of this source code is governed by an MIT-style license",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "License: MPL 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "http://mozilla.org/MPL/2.0/",
    ],
}
for _id in SPDX:
    HEADERS[_id] = [*HEADERS.get(_id, []), f"SPDX-License-Identifier: {_id}"]
SHORT = 8
#: Lines and paragraphs without text end a paragraph; comment signs are no text.
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*(?=\n)"
HEADER_CUE = r"(?i)licen[sc]|copyright|mozilla\.org/mpl|gplv|permission is hereby granted|redistribution and use|endorse or promote"
#: Copies of a licence text differ in names, years and line breaks.
TEXT_LIKE = 0.9
CUE = r"(?i)licen[sc]|copyright"
LIKE = 0.8
#: From here on a whole text counts as a licence file: a notice with little else.
WHOLE_LIKE = 0.25
#: Where a text is cut into sentences and lines.
CUT = r"\n+|[.!?]\s+"
TERMS = r"[^a-z0-9]+"
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TERMS), "")


@cache
def texts() -> dict[str, str]:
    """Whole licence texts; those of the CC licences are not at hand."""
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def _template_table(spark: SparkSession, kinds: list[list[tuple[str, str]]]) -> DataFrame:
    """``kind, template, license, term, tf`` of lists of ``(license, text)``."""
    every = [(k, license, text) for k, own in enumerate(kinds) for license, text in own]
    rows = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(n).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
        for n, (k, name, text) in enumerate(every)
    ])
    table = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    return table.select("kind", "template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy(
        "kind", "template", "license", "term"
    ).agg(F.count(F.lit(1)).cast("double").alias("tf"))


def _frequencies(files: DataFrame, terms: list[str]) -> DataFrame:
    """``term, files``: in how many of all files each term of the templates occurs."""
    words = F.array_intersect(_terms(F.col("text")), F.split(F.lit(" ".join(terms)), " "))
    return files.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("files"))


def cosines(passages: DataFrame, key: list[str], weights: DataFrame, other: float) -> DataFrame:
    """``key, license, cosine`` of each passage (``key`` columns, ``text``) and template.

    ``weights``: ``template, license, term, idf, weight, length`` of the templates, ``needed`` (1: a
    passage without this term does not match) and ``least``, their number. A term of a passage that
    no template has adds to its length alone, by the weight ``other``.
    """
    terms = passages.select(*key, F.explode(_terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(
        F.count(F.lit(1)).cast("double").alias("tf")
    )
    idf = weights.select("term", "idf").distinct()
    weighed = terms.join(F.broadcast(idf), "term", "left").withColumn(
        "value", F.col("tf") * F.coalesce("idf", F.lit(other))
    )
    lengths = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("own"))
    dots = weighed.join(F.broadcast(weights.drop("idf")), "term").groupBy(*key, "template", "license", "length", "least").agg(
        F.sum(F.col("value") * F.col("weight")).alias("dot"), F.sum("needed").alias("held")
    ).filter("held >= least")
    return dots.join(lengths, key).select(
        *key, "license", F.round(F.col("dot") / (F.col("own") * F.col("length")), 6).alias("cosine")
    )


def scan(files: DataFrame, keep: list[str], path: str = "path", text: str = "text",
         templates: dict[str, str] | None = None, like: float = LIKE,
         whole_like: float = WHOLE_LIKE) -> DataFrame:
    """For each row of ``files``: ``keep``, ``license`` (null: none), ``origin`` (header,
    inherited or none), ``cosine`` and ``directory`` it came from."""
    spark = files.sparkSession
    rows = files.select(*keep, F.col(f"`{path}`").alias("__path"), F.col(f"`{text}`").alias("text"))
    # Templates of the caller's own stand alone.
    more = [] if templates else [[(k, t) for k, own in sorted(HEADERS.items()) for t in own], sorted(texts().items())]
    table = stored(_template_table(spark, [sorted((templates or TEMPLATES).items()), *more]), "license-terms")
    terms = sorted(r[0] for r in table.select("term").distinct().collect())
    total = rows.count()
    idf = F.log((F.lit(total) + 1.0) / (F.coalesce("files", F.lit(0)) + 1.0)) + 1.0
    # As many rows as the templates have terms.
    one = Window.partitionBy("template")
    short = F.count(F.lit(1)).over(one) <= SHORT
    weights = (
        table.join(_frequencies(rows, terms), "term", "left").withColumn("idf", idf).withColumn("weight", F.col("tf") * F.col("idf"))
        .withColumn("length", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(one)))
        .withColumn("needed", ((F.col("kind") == 1) & (short | F.col("term").rlike("[0-9]"))).cast("int"))
        .withColumn("least", F.sum("needed").over(one))
        .select("kind", "template", "license", "term", "idf", "weight", "length", "needed", "least")
    )
    weights = stored(weights, "license-weights")
    notices, forms, whole_texts = (weights.filter(F.col("kind") == k).drop("kind") for k in range(3))
    other = math.log(total + 1.0) + 1.0
    named = F.coalesce(F.element_at(F.split("__path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    cue = F.coalesce(F.col("text").rlike(HEADER_CUE), F.lit(False)) | (named & F.col("text").isNotNull())
    # The rows that name a licence, with a number of their own: rows may be repeated.
    naming = stored(rows.filter(cue).withColumn("__row", F.monotonically_increasing_id()), "naming")
    lines = naming.select("__row", F.posexplode(F.split("text", CUT)).alias("__at", "text"))
    paragraphs = naming.select("__row", F.posexplode(F.split("text", PARAGRAPH)).alias("__at", "text"))
    key = ["__row", "__at"]
    by_notice = cosines(lines.filter(F.col("text").rlike(CUE)), key, notices, other).filter(F.col("cosine") >= like).select(
        "__row", "license", "cosine"
    )
    found = [by_notice]
    if more:
        headers = lines.unionByName(paragraphs.withColumn("__at", -1 - F.col("__at"))).filter(F.col("text").rlike(HEADER_CUE))
        found.append(cosines(headers, key, forms, other).filter(F.col("cosine") >= like).select("__row", "license", "cosine"))
        found.append(cosines(naming.filter(named), ["__row"], whole_texts, other).filter(F.col("cosine") >= TEXT_LIKE))
    best = _best(reduce(DataFrame.unionByName, found))
    whole = cosines(
        naming.select("__row", "text").join(by_notice.select("__row").distinct(), "__row", "left_semi"), ["__row"], notices, other
    ).filter(F.col("cosine") >= whole_like).select("__row").distinct()
    own = stored(
        naming.drop("text").join(best, "__row").join(whole.withColumn("__all", F.lit(True)), "__row", "left")
        .withColumn("__holds", named | F.col("__all").isNotNull()), "own-licenses"
    )
    parent = F.regexp_replace("__path", "/?[^/]*$", "")
    directories = (
        own.filter(F.col("__holds") & F.col("__path").isNotNull()).select(parent.alias("__dir"), "license", "cosine", "__path")
        .groupBy("__dir").agg(F.min(F.struct(-F.col("cosine"), "license", "__path")).alias("first"))
        .select("__dir", F.col("first.license").alias("__license"))
    )
    # Directories are resolved once each, then rows look theirs up.
    places = rows.select(parent.alias("__own_dir")).filter("__own_dir is not null").distinct()
    parts = F.split("__own_dir", "/")
    above = places.select("__own_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("__depth")).select(
        "__own_dir", "__depth", F.array_join(F.slice(parts, F.lit(1), F.col("__depth")), "/").alias("__dir")
    )
    nearest = above.join(directories, "__dir").groupBy("__own_dir").agg(
        F.max(F.struct("__depth", "__dir", "__license")).alias("found")
    ).select("__own_dir", F.col("found.__dir").alias("__dir"), F.col("found.__license").alias("__license"))
    having = own.select(
        *keep, "license", F.lit("header").alias("origin"), "cosine", F.lit(None).cast("string").alias("directory")
    )
    matched = own.select("__row")
    lacking = (
        naming.join(matched, "__row", "left_anti").drop("__row", "text")
        .unionByName(rows.filter(~cue).drop("text"))
        .withColumn("__own_dir", parent)
    )
    rest = lacking.join(nearest, "__own_dir", "left").select(
        *keep, F.col("__license").alias("license"),
        F.when(F.col("__license").isNull(), "none").otherwise("inherited").alias("origin"),
        F.lit(None).cast("double").alias("cosine"), F.col("__dir").alias("directory"),
    )
    return having.unionByName(rest)


def _best(found: DataFrame) -> DataFrame:
    general = F.col("license").isin(GENERAL).cast("int").alias("general")
    return found.groupBy("__row").agg(
        F.min(F.struct(general, (-F.col("cosine")).alias("less"), "license")).alias("best")
    ).select("__row", F.col("best.license").alias("license"), (-F.col("best.less")).alias("cosine"))


def oracle(documents: str = "documents") -> str:
    """DuckDB's SQL for the registered query."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))
    words = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[A-Z]', '', 'g'), '[^a-z0-9]+'), lambda x: x <> '')"
    cut = r"\n+|[.!?]\s+"
    return f"""
WITH files AS (
  SELECT doc_id, text, source || '/' || lang || '/' || (doc_id // 100) || '/' || doc_id || '.txt' AS path FROM {documents}
), n AS (SELECT count(*)::DOUBLE AS total FROM files),
template AS (
  SELECT license, term, count(*)::DOUBLE AS tf FROM (
    SELECT license, unnest({words('t')}) AS term FROM (VALUES {values}) v(license, t)) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS files FROM (
    SELECT DISTINCT doc_id, unnest({words('text')}) AS term FROM files) WHERE term IN (SELECT term FROM template) GROUP BY term
), idf AS (
  SELECT DISTINCT term, ln((total + 1.0::DOUBLE) / (coalesce(files, 0) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf
  FROM template LEFT JOIN df USING (term), n
), weight AS (
  SELECT license, term, tf * idf AS weight, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS length
  FROM template JOIN idf USING (term)
), passage AS (
  SELECT doc_id, pos, s FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '{cut}')) AS s,
           generate_subscripts(regexp_split_to_array(text, '{cut}'), 1) AS pos
    FROM files WHERE regexp_matches(text, '{CUE}')) WHERE regexp_matches(s, '{CUE}')
  UNION ALL SELECT doc_id, 0, text FROM files WHERE regexp_matches(text, '{CUE}')
), term AS (
  SELECT doc_id, pos, t.term, tf, tf * coalesce(idf, ln(total + 1.0::DOUBLE) + 1.0::DOUBLE) AS value FROM (
    SELECT doc_id, pos, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, pos, unnest({words('s')}) AS term FROM passage) GROUP BY ALL) t
  LEFT JOIN idf USING (term), n
), own AS (SELECT doc_id, pos, sqrt(sum(value * value)) AS own FROM term GROUP BY ALL),
cosine AS (
  SELECT doc_id, pos, license, round(sum(value * weight) / (any_value(own) * any_value(length)), 6) AS cosine
  FROM term JOIN weight USING (term) JOIN own USING (doc_id, pos) GROUP BY doc_id, pos, license
), best AS (
  SELECT doc_id, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine FROM cosine
  WHERE pos > 0 AND cosine >= {LIKE} GROUP BY doc_id
), whole AS (SELECT DISTINCT doc_id FROM cosine WHERE pos = 0 AND cosine >= {WHOLE_LIKE}),
dir AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, arg_min(license, (-cosine, license, path)) AS license
  FROM best JOIN files USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM whole) GROUP BY 1
), inherited AS (
  SELECT doc_id, arg_max(dir, length(dir)) AS directory, arg_max(license, length(dir)) AS license
  FROM files JOIN dir ON starts_with(path, dir || '/') GROUP BY doc_id
)
SELECT doc_id, coalesce(b.license, i.license) AS license,
       CASE WHEN b.license IS NOT NULL THEN 'header' WHEN i.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       b.cosine AS cosine, CASE WHEN b.license IS NULL THEN i.directory END AS directory
FROM files LEFT JOIN best b USING (doc_id) LEFT JOIN inherited i USING (doc_id)
"""

"""License scan: MinHash bands over overlapping windows find template candidates, exact shingle containment confirms them.

Words are runs of letters and digits, lower-cased. A template of n words belongs to the window class of the smallest size
W with n <= 3/4 W; windows of a class begin every W/4 words, so every occurrence lies whole in some window. Each of the 40 bands
holds one minimum: even where one window matches a template at the threshold (similarity of about 0.25), the bands miss it with a
chance of 0.75 ** 40 = 1e-5, and most occurrences lie in several windows. The classes go on in powers of two up to the longest template,
so full license texts are matched like notices; a template shorter than one shingle cannot match and is an error.

A band can only collide where a template's minimum occurs among a window's shingles, so texts and windows without any such
shingle are left out before minima are taken: the same candidates at a fraction of the work.

Only DataFrame functions are used. Templates are a parameter of bounded size (checked), so their bands are broadcast; documents
are never moved before verified hits are grouped per document.

Defined results: one row per document id and license with containment of at least the threshold: the highest containment, the
word where the match begins, the template's words. Null and empty texts, and texts shorter than one shingle, have no row; rows
that share an id (null included) share their result; long texts are read whole; an empty table gives an empty result; extra columns
are ignored. Equal containment: the earliest place counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import documents, text_of

SHINGLE, BANDS, THRESHOLD = 5, 40, 0.8
CLASSES = (8, 16, 32, 64, 128, 256)
MAX_TEMPLATES = 2000
# fixed values: license notices
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashes(words: Column, n: Column) -> Column:
    """Hash of each run of five words; null where there are fewer."""
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))


def _shingles(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def _minima(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, k))))


def window_classes(longest: int) -> list[int]:
    """The fixed classes, and as many more as the longest template needs."""
    out = list(CLASSES)
    while out[-1] - out[-1] // 4 < longest:
        out.append(2 * out[-1])
    return out


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, n_template, class, shingles, minima, low): one row per template; ``low`` are the shingles that give the minima."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates: their bands are broadcast")
    c = F.col
    pairs = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in templates.items()])
    rows = spark.range(1).select(F.explode(pairs).alias("t")).select("t.license", words_of(c("t.notice")).alias("words"))
    rows = rows.withColumn("n_template", F.size("words"))
    lengths = {r["license"]: r["n_template"] for r in rows.select("license", "n_template").collect()}  # bounded by MAX_TEMPLATES
    if short := sorted(k for k, n in lengths.items() if n < SHINGLE):
        raise ValueError(f"templates of fewer than {SHINGLE} words cannot be matched: {short}")
    size = F.lit(None).cast("int")
    for w in reversed(window_classes(max(lengths.values()))):
        size = F.when(c("n_template") <= w - w // 4, F.lit(w)).otherwise(size)
    rows = rows.select("license", "n_template", size.alias("class"), F.array_distinct(_shingles(c("words"))).alias("shingles"), _hashes(c("words"), c("n_template")).alias("h"))
    rows = rows.withColumn("minima", _minima(c("h")))
    # the shingle behind each minimum
    low = F.filter("h", lambda x: F.arrays_overlap(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(x, k)), c("minima")))
    return rows.select("license", "n_template", "class", "shingles", "minima", low.alias("low"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, containment, first_word, n_template_words) of every confirmed license notice."""
    c, spark = F.col, docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    known = table.select("class", "low").collect()  # bounded by MAX_TEMPLATES and BANDS
    low = F.array(*[F.lit(x) for x in sorted({x for r in known for x in r["low"]})]).cast("array<bigint>")
    classes = F.array(*[F.lit(x) for x in sorted({r["class"] for r in known})]).cast("array<int>")
    bands = F.broadcast(table.select("license", "n_template", "shingles", "class", F.posexplode("minima").alias("band", "key")))

    rows = docs.select(docs[doc_id].alias("_id"), words_of(text_of(docs, text)).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("h", _hashes(c("words"), c("n")))
    # the row number keeps the filter above this projection: pushed below, it would extract the words once per shingle
    rows = rows.withColumns({"hit": F.arrays_overlap("h", low), "_at": F.monotonically_increasing_id()}).filter("hit and _at >= 0").drop("hit", "_at")
    windows = rows.select("*", F.explode(classes).alias("class")).select(
        "*", F.explode(F.sequence(F.lit(0), c("n") - SHINGLE, (c("class") / 4).cast("int"))).alias("start"))
    windows = windows.select("_id", "class", "start", F.slice("words", c("start") + 1, c("class")).alias("words"),
                             F.slice("h", c("start") + 1, c("class") - (SHINGLE - 1)).alias("h"))
    windows = windows.filter(F.arrays_overlap("h", low))
    key = F.coalesce(F.array_min(F.transform("h", lambda x: F.xxhash64(x, c("band")))), F.lit(0))
    banded = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).withColumn("key", key)
    hits = banded.join(bands, ["class", "band", "key"]).withColumn("found", _shingles(c("words")))
    share = F.size(F.array_intersect("shingles", "found")) / F.size("shingles")
    # array_intersect keeps the order of its first array
    first = c("start") + F.expr("array_position(found, get(array_intersect(found, shingles), 0))") - 1
    sure = hits.withColumn("share", share).filter(c("share") >= threshold).select("_id", "license", "n_template", "share", first.cast("bigint").alias("first"))
    return sure.groupBy("_id", "license").agg(
        F.max("n_template").cast("bigint").alias("n_template_words"), F.max(F.struct("share", (-c("first")).alias("back"))).alias("best"),
    ).select(c("_id").alias(doc_id), "license", c("best.share").alias("containment"), (-c("best.back")).alias("first_word"), "n_template_words")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    size = "CASE " + " ".join(f"WHEN n <= {w - w // 4} THEN {w}" for w in CLASSES) + " END"
    return rf"""
WITH t AS (SELECT license, regexp_extract_all(lower(notice), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {values}) v(license, notice)),
tc AS (SELECT license, w, len(w) AS n, (SELECT {size} FROM (SELECT len(w) AS n)) AS class FROM t WHERE len(w) >= {SHINGLE}),
ts AS (SELECT DISTINCT license, n, class, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, n - {SHINGLE - 2})) AS i FROM tc)),
tn AS (SELECT license, count(*) AS total FROM ts GROUP BY license),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d WHERE len(w) >= {SHINGLE})),
hit AS (SELECT doc_id, ds.n AS words, pos, s, license, ts.n, class FROM ds JOIN ts USING (s)),
win AS (SELECT *, unnest(range(greatest(0, (pos - (class - {SHINGLE}) + class // 4 - 1) // (class // 4) * (class // 4)), pos + 1, class // 4)) AS start FROM hit),
g AS (SELECT doc_id, license, n, start, count(DISTINCT s) AS c, min(pos) AS first FROM win WHERE start <= words - {SHINGLE} GROUP BY ALL),
f AS (SELECT doc_id, license, n, c / total AS containment, first FROM g JOIN tn USING (license) WHERE c / total >= {THRESHOLD})
SELECT doc_id, license, max(containment) AS containment, (arg_min(first, (-containment, first)))::BIGINT AS first_word, max(n)::BIGINT AS n_template_words
FROM f GROUP BY doc_id, license
"""


OP3_SQL = _sql()

"""License scans with DataFrame functions only.

Words are runs of ASCII letters and digits, lower-cased; shingles are five words. Texts are read in
overlapping windows of several sizes, so that a template of up to ``step`` words lies whole in a window of
``2 * step``. MinHash bands of a window that equal a template's retrieve the template; the number of bands
follows from the least Jaccard similarity that a containing window can have, so that a band collides with
at least the wanted probability. Retrieved templates are verified by exact shingle containment.

A window without any shingle of a template can't share a band with one, so bands are computed only for
windows around template shingles; that drops nothing.

Defined results: a match is a (document, template) with a window that holds at least the wanted share of
the template's distinct shingles; null, empty and short texts match nothing; long texts are read whole;
ties give the first window; rows with equal doc_id are one document; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.tables import table

SHINGLE, CONTAINMENT, PROBABILITY = 5, 0.8, 0.9999

#: Wordings of license notices and grants.
TEMPLATES = {
    "mit_notice": "Released under the MIT License.",
    "apache_2_notice": "Licensed under the Apache License, Version 2.0",
    "gpl_3_notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc_by_nc_4_notice": "Licensed under CC BY-NC 4.0.",
    "cc_by_4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_sa_4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl_2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache_2": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def shingle_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])


def shingles(words: Column, start: Column, stop: Column) -> Column:
    """Distinct shingles that lie within words start..stop (end exclusive)."""
    last = F.least(stop, F.size(words)) - SHINGLE
    return F.when(last >= start, F.array_distinct(F.transform(F.sequence(start, last), lambda i: shingle_at(words, i)))).otherwise(F.array().cast("array<bigint>"))


def step_of(n_words: int) -> int:
    """The window step for a template: a power of two, at least 1.25 times its words."""
    return 1 << max(3, math.ceil(math.log2(1.25 * n_words)))


def bands_for(step: int, least_shingles: int, containment: float = CONTAINMENT, probability: float = PROBABILITY) -> int:
    """Bands of one row that collide with the wanted probability at the least similarity possible.

    A window of ``2 * step`` words has at most ``2 * step - 4`` shingles; it shares at least
    ``ceil(containment * n)`` with a template of ``n``.
    """
    shared = math.ceil(containment * least_shingles)
    least = shared / (2 * step - SHINGLE + 1 + least_shingles - shared)
    return 1 if least >= 1 else math.ceil(math.log(1 - probability) / math.log(1 - least))


def minhashes(hashes: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


class Library:
    """Templates with their shingles and bands; some thousand numbers, fixed by the templates."""

    def __init__(self, spark: SparkSession, templates: dict[str, str]):
        rows = [(name, plain_words(t)) for name, t in templates.items()]
        rows = [(n, w) for n, w in rows if len(w) >= SHINGLE]
        self.steps: dict[int, int] = {}
        sizes: dict[int, list[int]] = {}
        for _, w in rows:
            sizes.setdefault(step_of(len(w)), []).append(len({*zip(*[w[i:] for i in range(SHINGLE)], strict=False)}))
        for step, n in sizes.items():
            self.steps[step] = max(bands_for(step, k) for k in n)
        one = spark.range(1)
        frames = []
        for name, w in rows:
            step = step_of(len(w))
            ws = F.array(*map(F.lit, w))
            frames.append(one.select(F.lit(name).alias("license"), F.lit(step).alias("step"), shingles(ws, F.lit(0), F.lit(len(w))).alias("wanted")).withColumn("bands", minhashes(F.col("wanted"), self.steps[step])))
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        self.rows = every.collect()
        self.hashes = sorted({h for r in self.rows for h in r.wanted})
        self.first_words = sorted({x for _, w in rows for x in w[: len(w) - SHINGLE + 1]})

    def table(self, spark: SparkSession) -> DataFrame:
        """(license, step, wanted, band, value), from literals."""
        lit = lambda r: F.struct(F.lit(r.license).alias("license"), F.lit(r.step).alias("step"), F.array(*map(F.lit, r.wanted)).cast("array<bigint>").alias("wanted"), F.array(*map(F.lit, r.bands)).cast("array<bigint>").alias("bands"))
        t = spark.range(1).select(F.inline(F.array(*map(lit, self.rows))))
        return t.select("license", "step", "wanted", F.posexplode("bands").alias("band", "value"))


def _window_starts(step: int):
    """For a word's place: the (step, start) of the two windows that hold it."""

    def of(p: Column) -> Column:
        k = F.floor(p / step)
        return F.array(*[F.struct(F.lit(step).alias("step"), F.greatest(F.lit(0), (k - d) * step).cast("int").alias("start")) for d in (0, 1)])

    return of


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word): the best window of each template a document holds.

    The split words pass through a generator so that they are computed once a row.
    """
    spark = docs.sparkSession
    library = Library(spark, TEMPLATES if templates is None else templates)
    split = docs.select("doc_id", F.explode(F.array(words_of(F.col(text_col)))).alias("w")).filter(F.size("w") >= SHINGLE)
    w = F.col("w")
    is_hit = lambda i: F.get(w, i).isin(library.first_words) & shingle_at(w, i).isin(library.hashes)
    hits = split.select("doc_id", "w", F.explode(F.array(F.filter(F.sequence(F.lit(0), F.size(w) - SHINGLE), is_hit))).alias("at")).filter(F.size("at") > 0)
    starts = F.array_distinct(F.flatten(F.array(*[F.flatten(F.transform("at", _window_starts(step))) for step in library.steps])))
    windows = hits.select("doc_id", "w", F.explode(starts).alias("x")).select("doc_id", "x.step", "x.start", F.explode(F.array(shingles(F.col("w"), F.col("x.start"), F.col("x.start") + 2 * F.col("x.step")))).alias("held"))
    banded = None
    for step, bands in library.steps.items():
        own = F.when(F.col("step") == step, minhashes(F.col("held"), bands))
        banded = own if banded is None else F.coalesce(banded, own)
    keyed = windows.filter(F.size("held") > 0).select("doc_id", "step", "start", "held", F.posexplode(banded).alias("band", "value"))
    met = keyed.join(F.broadcast(library.table(spark)), ["step", "band", "value"])
    share = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    verified = met.select("doc_id", "license", share.alias("containment"), F.col("start").alias("first_word")).filter(F.col("containment") >= containment)
    best = verified.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("first"))).alias("b"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.first")).cast("long").alias("first_word"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    """All windows of all documents against all templates, by joins on shingles' texts."""
    rows = ", ".join(f"('{n}', {step_of(len(plain_words(t)))}, {plain_words(t)!r})" for n, t in TEMPLATES.items())
    sh = lambda w, i: f"array_to_string({w}[{i}:{i} + 4], ' ')"
    return f"""
    WITH t AS (SELECT * FROM (VALUES {rows}) AS v(license, step, w)),
    ts AS (SELECT DISTINCT license, step, {sh('w', 'i')} AS s FROM t, unnest(range(1, len(w) - 3)) AS r(i)),
    tn AS (SELECT license, step, count(*) AS n FROM ts GROUP BY ALL),
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
    ds AS (SELECT doc_id, i - 1 AS p, {sh('w', 'i')} AS s FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS r(i)),
    m AS (SELECT DISTINCT doc_id, license, ts.step, ts.s, greatest(0, (p // ts.step - o) * ts.step) AS start, p
      FROM ds JOIN ts ON ds.s = ts.s, (VALUES (0), (1)) AS off(o)),
    c AS (SELECT doc_id, license, step, start, count(DISTINCT s) AS k FROM m WHERE p >= start AND p + 5 <= start + 2 * step GROUP BY ALL)
    SELECT doc_id, license, max(k / n) AS containment, CAST(arg_min(start, (-k / n, start)) AS BIGINT) AS first_word
    FROM c JOIN tn USING (license, step) WHERE k / n >= {CONTAINMENT} GROUP BY doc_id, license
    """


QUERIES = {"op6_licenses": op6_licenses}
ORACLES: dict[str, str] = {"op6_licenses": oracle()}

"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template with m runs of five words is looked for in windows of about m + m // 4 runs, a new one every m // 4, so every
occurrence lies whole in some window. Window and template share a band if both minima of that band's two hash functions
are equal. A window that holds CONTAINED of a template is similar to it to a known degree (one half at least, whatever the
template's length, unless the template repeats itself), and as many bands are taken as leave a chance of MISS to share none.

A minimum can be equal only where the window holds the template's minimal shingle. So minima are not taken of all windows:
shingles meet the templates' minima by equality, and the windows around such a place are those whose bands are computed.
What shares a band goes on to the exact count of shingles. Only DataFrame functions are used.

Defined results: every row of the input has its own results, one row per template that it states, so repeated rows and
null ids give repeated rows and rows with a null id; a null, empty or blank text, and one of fewer than five words, has no
shingle and meets no template; a template of any length is looked for, but one of fewer than five words is an error; an
empty table gives an empty result; the best window counts, the first of equals; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, spread, table, words

SHINGLE = 5
CONTAINED = 0.75
#: Hash functions in a band, and the chance that a window that holds CONTAINED of a template shares no band with it.
BAND_ROWS = 2
MISS = 1e-9
#: Rows of the templates' tables up to which they are handed to every executor.
SMALL_ROWS = 200_000


@dataclass(frozen=True)
class Template:
    """A license and a wording by which texts state it."""

    license_id: str
    text: str


#: Usual short notices, and two whole texts.
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("MIT", "Released under the MIT License."),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0. This work may be shared with attribution."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"),
    Template("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files,"),
    Template("Unlicense", "This is free and unencumbered software released into the public domain."),
    Template(
        "MIT-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "ISC-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def normal(text: Column) -> Column:
    """Lower case, and punctuation at the ends of words gone: a version's point inside stays."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s.-]+|\.(?=\s|$)", " ")


def shingles(ws: Column) -> Column:
    """Hashes of all runs of five words, in order."""
    return F.when(
        F.size(ws) >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.size(ws) - SHINGLE), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)])),
    ).otherwise(F.array().cast("array<bigint>"))


def bands_for(shingles: int, width: int) -> int:
    """Bands that leave a chance of MISS, for a template of so many distinct shingles in windows of so many runs."""
    held = math.ceil(CONTAINED * shingles)
    similarity = held / (width + shingles - held)
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity**BAND_ROWS))


def shortest_whole(runs: list[int]) -> int:
    """The length of the shortest stretch of runs that holds each of them."""
    least, begin, wanted, held = len(runs), 0, len(set(runs)), Counter()
    for end, run in enumerate(runs, 1):
        held[run] += 1
        while len(held) == wanted:
            least = min(least, end - begin)
            held[runs[begin]] -= 1
            if not held[runs[begin]]:
                del held[runs[begin]]
            begin += 1
    return least


def template_table(spark, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """no (of the wording), license_id, n (distinct shingles), step and width (runs of a window) and the shingles t_sh.

    Windows follow the shortest stretch of a template that holds all its shingles, which is all of it unless it repeats itself.
    A template of fewer than five words is an error.
    """
    schema = "no int, license_id string, n int, step int, width int, bands int, t_sh array<bigint>"
    raw = spark.createDataFrame([(no, t.license_id, t.text) for no, t in enumerate(templates)], "no int, license_id string, template string")
    rows = raw.select("no", "license_id", shingles_of(F.col("template")).alias("runs")).collect()  # the list of templates, as given
    short = [r["license_id"] for r in rows if not r["runs"]]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(map(str, short))}")
    made = []
    for r in rows:
        own, size = list(dict.fromkeys(r["runs"])), shortest_whole(r["runs"])
        step = max(1, size // 4)
        width = size + step - 1
        made.append((r["no"], r["license_id"], len(own), step, width, bands_for(len(own), width), own))
    return spark.createDataFrame(made, schema)


def band_minima(table: DataFrame) -> DataFrame:
    """first, no, license_id, step, width and bands: for each shingle that is the first minimum of some of a template's bands, those bands with both minima."""

    def least(k: Column) -> Column:
        return F.array_min(F.transform("t_sh", lambda x: F.struct(F.xxhash64(x, k).alias("v"), x.alias("sh"))))

    each = table.select("no", "license_id", "step", "width", "t_sh", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"))
    two = each.select("no", "license_id", "step", "width", "band", least(2 * F.col("band")).alias("a"), least(2 * F.col("band") + 1).alias("b"))
    band = F.struct("band", F.col("a.v").alias("v"), F.col("b.v").alias("w"))
    return two.groupBy(F.col("a.sh").alias("first"), "no", "license_id", "step", "width").agg(F.array_sort(F.collect_list(band)).alias("bands"))


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose rows have been counted."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, license_id, n_windows, containment, first_word of every row and license that it states, in any of its wordings."""
    spark = docs.sparkSession
    if not templates:
        return spark.createDataFrame([], "doc_id bigint, license_id string, n_windows bigint, containment double, first_word bigint")
    known = template_table(spark, templates)
    held = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), shingles_of(F.col("text")).alias("sh"))
    at = held.select("doc_id", "row", "sh", F.posexplode("sh").alias("at", "h"))
    # Around a place where a band's first minimum stands, the runs of every window that holds it.
    near = at.join(small(band_minima(known)), F.col("h") == F.col("first")).select(
        "doc_id", "row", "no", "license_id", "step", "width", "bands", "at", F.greatest(F.lit(0), F.col("at") - F.col("width") + 1).alias("from"), F.col("sh")
    ).withColumn("runs", F.slice("sh", F.col("from") + 1, F.col("at") - F.col("from") + F.col("width"))).drop("sh")
    first = F.ceil(F.col("from") / F.col("step")).cast("int")
    starts = F.transform(F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("int")), lambda k: k * F.col("step"))
    windows = near.filter(first * F.col("step") <= F.col("at")).select("doc_id", "row", "no", "license_id", "bands", "width", "runs", "from", F.explode(starts).alias("start"))
    windows = windows.withColumn("runs", F.slice("runs", F.col("start") - F.col("from") + 1, F.col("width")))

    def lowest(k: Column) -> Column:
        return F.array_min(F.transform("runs", lambda x: F.xxhash64(x, k)))

    shares = F.exists("bands", lambda b: (lowest(2 * b["band"]) == b["v"]) & (lowest(2 * b["band"] + 1) == b["w"]))
    met = windows.filter(shares).select("doc_id", "row", "no", "license_id", "start", "runs").join(
        small(known.select(F.col("no").alias("__no"), "n", "t_sh")), F.col("no") == F.col("__no")
    )
    counted = met.select("doc_id", "row", "no", "license_id", "start", (F.size(F.array_intersect("runs", "t_sh")) / F.col("n")).alias("containment"))
    kept = counted.filter(F.col("containment") >= CONTAINED)
    best = kept.groupBy("doc_id", "row", "license_id").agg(
        F.count_distinct("no", "start").alias("n_windows"), F.max("containment").alias("containment"), F.min(F.struct(-F.col("containment"), F.col("start"))).alias("b")
    )
    return best.select("doc_id", "license_id", "n_windows", "containment", F.col("b.start").cast("bigint").alias("first_word"))


def shingles_of(text: Column) -> Column:
    """The runs of a text, in order."""
    return let(words(normal(text)), shingles)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document and license that it states."""
    return scanned(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _oracle() -> str:
    """Every template against the same windows, compared in full and without bands."""
    values = ", ".join("('{}', '{}')".format(t.license_id, t.text.replace("'", "''")) for t in TEMPLATES)
    norm = r"list_filter(string_split_regex(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}\s.-]+|\.(\s|$)', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
WITH t0 AS (SELECT * FROM (VALUES {values}) v(license_id, template)),
t1 AS (SELECT license_id, {norm.format("template")} AS ws FROM t0),
t AS (SELECT license_id, len(ws) - 4 + greatest(1, (len(ws) - 4) // 4) - 1 AS width, greatest(1, (len(ws) - 4) // 4) AS step, list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+4], ' '))) AS t_sh FROM t1 WHERE len(ws) >= 5),
d AS (SELECT row_number() OVER () AS rid, doc_id, {norm.format("text")} AS ws FROM documents),
s AS (SELECT rid, doc_id, unnest(generate_series(1, len(ws) - 4)) AS i, ws FROM d WHERE len(ws) >= 5),
g AS (SELECT rid, doc_id, i - 1 AS p, array_to_string(ws[i:i+4], ' ') AS g FROM s),
u AS (SELECT license_id, width, step, len(t_sh) AS n, unnest(t_sh) AS g FROM t),
h AS (SELECT DISTINCT rid, doc_id, p, license_id, width, step, n, u.g FROM g JOIN u ON g.g = u.g),
w AS (SELECT rid, doc_id, license_id, n, g, unnest(generate_series(0, p // step)) * step AS start, p, width FROM h),
c AS (SELECT rid, doc_id, license_id, start, count(DISTINCT g) / any_value(n) AS containment FROM w WHERE p >= start AND p < start + width GROUP BY 1, 2, 3, 4),
k AS (SELECT * FROM c WHERE containment >= 0.75)
SELECT doc_id, license_id, count(*) AS n_windows, max(containment) AS containment, CAST(arg_min(start, (-containment, start)) AS BIGINT) AS first_word FROM k GROUP BY rid, 1, 2
"""


SQL_OP7 = _oracle()

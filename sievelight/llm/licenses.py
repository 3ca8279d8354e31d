"""License scans by MinHash bands over overlapping text windows.

Texts are cut into overlapping windows of six words, two words apart, so a
window holds the two shingles of five words that begin in its first half and
every shingle lies in one window.  A window has one MinHash value a band: the
least of its shingles' hashes under the band's own hash function.  A template
is indexed by its windows of one shingle each.  So a text window that has a
shingle of a template shares any one band with it with probability 1/2, and
none of ``BANDS`` of them with probability 2**-20, about one in a million.

Windows retrieve templates by these bands.  Each retrieved template is then
verified around its window: the share of its shingles that occur there must
reach the threshold.  Everything is a DataFrame expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.plans.sizing import BROADCAST_ROWS, is_small, join_groups
from sievelight.plans.staging import stage

SHINGLE, STRIDE, BANDS = 5, 2, 20
THRESHOLD = 0.8
#: Template words searched at a time; each block is a scan of all texts.
BLOCK_WORDS = 10_000

# Whole texts of public licenses (without the holders' names).
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD3_TEXT = BSD2_TEXT.replace("\n\nTHIS SOFTWARE", f"\n\n{BSD3_CLAUSE}\n\nTHIS SOFTWARE")
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BOOST_TEXT = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""
# Well-known wordings of public licenses.
TEMPLATES = (
    ("mit-line", "MIT", "Released under the MIT License"),
    ("mit-line-2", "MIT", "Licensed under the MIT License"),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl3-line", "GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl2-line", "GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl3-notice", "GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-notice", "GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl-line", "LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-line", "AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense-line", "Unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-line", "CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-line", "CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-name", "CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit-text", "MIT", MIT_TEXT), ("isc-text", "ISC", ISC_TEXT), ("bsd-2-text", "BSD-2-Clause", BSD2_TEXT), ("bsd-3-text", "BSD-3-Clause", BSD3_TEXT),
    ("zlib-text", "Zlib", ZLIB_TEXT), ("unlicense-text", "Unlicense", UNLICENSE_TEXT), ("boost-text", "BSL-1.0", BOOST_TEXT),
)

#: What stands between words: ASCII that is neither a letter, a digit nor an underscore.
SEPARATORS = r"[\x00-/:-@\[-^`{-\x7f]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def _shingle(words: Column, at: Column) -> Column:
    """Hash of the five words from ``at`` (from 0) on; null where they do not fit."""
    return F.when(at + SHINGLE <= F.size(words), F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)]))


def _windows(words: Column) -> Column:
    """Structs ``at, h0, h1 ...``, a hash for each shingle that begins in the window; a missing one repeats the first."""
    last = F.size(words) - SHINGLE

    def window(at: Column) -> Column:
        first = _shingle(words, at)
        rest = [F.coalesce(_shingle(words, at + k), first).alias(f"h{k}") for k in range(1, STRIDE)]
        return F.struct(at.alias("at"), first.alias("h0"), *rest)

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(STRIDE)), window))


def _band(k: int, shingles: list[Column]) -> Column:
    """The MinHash value of a band: the least of the shingles under the hash function that ``k`` seeds."""
    hashes = [F.xxhash64(F.lit(k), h) for h in shingles]
    return F.least(*hashes) if len(hashes) > 1 else hashes[0]


def template_table(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template string, license string, text string")


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``id_col, text_hash, template, license, containment, first_word``, a row for each template in a document.

    ``templates`` has ``template, license, text``; each text needs five words
    at least (ValueError otherwise).  Of templates that one window retrieves
    only those of the greatest containment count, so a version's wording does
    not pass for another's.  ``first_word`` is about where the template first
    occurs.  Null texts and those of under five words have no rows; null and
    repeated ids keep theirs, rows that are equal in all give one result;
    empty tables give no rows; other columns are ignored.  Templates are
    searched in blocks of ``block_words`` words, each against all texts, and a
    text longer than that is a block of its own.  A window misses a template
    that it has a shingle of with probability 2**-20.
    """
    spark = docs.sparkSession
    known = templates.select("template", "license", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    known = known.withColumn("n_words", F.size("words"))
    short = known.where(F.col("n_words") < SHINGLE).limit(1).collect()
    if short:
        raise ValueError(f"template {short[0].template!r} has fewer than {SHINGLE} words")
    places = F.sequence(F.lit(0), F.col("n_words") - SHINGLE)
    known = known.withColumn("shingles", F.array_distinct(F.transform(places, lambda k: _shingle(F.col("words"), k))))
    known = stage(known, "license-templates")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    # words are a column of their own: inside the windows' lambda they would be made again for each word
    windows = rows.select("id", "text_hash", words_of(F.col("text")).alias("words"))
    windows = windows.select("id", "text_hash", F.explode(_windows(F.col("words"))).alias("w"))
    windows = windows.select("id", "text_hash", "w.*")

    held_by = [F.col(f"h{k}") for k in range(STRIDE)]
    found = []
    sizes = known.select("template", F.col("n_words")).orderBy("template").toLocalIterator()
    blocks, held = [[]], 0
    for t in sizes:
        if blocks[-1] and held + t.n_words > block_words:
            blocks.append([])
            held = 0
        blocks[-1].append(t.template)
        held += t.n_words
    for block in blocks:
        part = known.where(F.col("template").isin(block)) if block else known.limit(0)
        bands = lambda held: F.explode(F.array(*[F.struct(F.lit(k).alias("band"), _band(k, held).alias("key")) for k in range(BANDS)]))
        single = part.select("template", F.explode("shingles").alias("h")).select("template", bands([F.col("h")]).alias("b"))
        index = stage(single.select("template", "b.*").distinct(), "license-index")
        # a window can share a band only if it has a shingle of the block, so bands are made for those windows alone
        own = [r.h for r in part.select(F.explode("shingles").alias("h")).distinct().collect()]  # at most block_words
        if not own:
            continue
        listed = ", ".join(f"{h}L" if h > -(1 << 63) else "bigint('-9223372036854775808')" for h in own)
        near = windows.where(" OR ".join(f"h{k} IN ({listed})" for k in range(STRIDE)))
        near = near.select("id", "text_hash", "at", bands(held_by).alias("b")).select("id", "text_hash", "at", "b.*")
        few = is_small(index, broadcast_rows)
        found.append(near.join(F.broadcast(index) if few else index, ["band", "key"]).select("id", "text_hash", "at", "template").distinct())
    if not found:
        found = [windows.limit(0).select("id", "text_hash", "at", F.lit("").alias("template"))]
    hits = stage(reduce(DataFrame.unionAll, found), "license-hits")

    # verification reads the texts of the hits again
    hit_rows = stage(hits.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "license-texts")
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    texts = rows.join(F.broadcast(hit_rows) if is_small(hit_rows, broadcast_rows) else hit_rows, same, "left_semi").dropDuplicates(["id", "text_hash"])
    texts = texts.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), words_of(F.col("text")).alias("doc_words"))
    # of a document only the words around a hit go on, so a long one is not copied to each of its hits
    sized = join_groups(hits, known.select("template", "n_words"), ["template"], broadcast_rows=broadcast_rows)
    begin = F.greatest(F.lit(0), F.col("at") - F.col("n_words"))
    length = F.col("n_words") + F.col("at") - begin + SHINGLE + STRIDE - 1
    cut = sized.join(texts, same).select("id", "text_hash", "at", "template", F.slice("doc_words", begin + 1, length).alias("near"))
    cut = stage(cut, "license-near")
    checked = join_groups(cut, known.select("template", "license", "shingles"), ["template"], broadcast_rows=broadcast_rows)
    near = F.transform(F.sequence(F.lit(0), F.size("near") - SHINGLE), lambda k: _shingle(F.col("near"), k))
    shared = F.size(F.array_intersect(near, F.col("shingles"))) / F.size("shingles")
    checked = checked.select("id", "text_hash", "at", "template", "license", shared.alias("containment"))
    best = F.max("containment").over(Window.partitionBy("id", "text_hash", "at"))
    checked = checked.withColumn("best", best).where((F.col("containment") >= threshold) & (F.col("containment") == F.col("best")))
    return checked.groupBy("id", "text_hash", "template", "license").agg(
        F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word")
    ).withColumnRenamed("id", id_col)


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL over ``documents``, without bands: every window that shares a shingle is verified."""
    quoted = ", ".join("({})".format(", ".join("'" + v.replace("'", "''") + "'" for v in t)) for t in templates)
    words = "[x FOR x IN string_split_regex(lower({}), '[\\x00-/:-@\\[-^`{{-\\x7f]+') IF x <> '']"
    return f"""
WITH t AS (SELECT template, license, {words.format("text")} AS w FROM (VALUES {quoted}) v(template, license, text)),
ts AS (SELECT template, license, len(w) AS n, list_distinct([w[k : k + 4] FOR k IN range(1, len(w) - 3)]) AS s FROM t),
d AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS k, w FROM d WHERE len(w) >= 5),
one AS (SELECT template, unnest(s) AS s FROM ts),
hits AS (SELECT DISTINCT doc_id, template, (k - 1) // {STRIDE} * {STRIDE} AS p FROM g JOIN one ON g.w[k : k + 4] = one.s),
near AS (SELECT h.*, ts.license, ts.n, ts.s, d.w[greatest(0, p - n) + 1 : p + n + {SHINGLE + STRIDE - 1}] AS r
         FROM hits h JOIN ts USING (template) JOIN d USING (doc_id)),
c AS (SELECT doc_id, p, template, license,
             len(list_intersect(list_distinct([r[k : k + 4] FOR k IN range(1, len(r) - 3)]), s)) / len(s) AS containment FROM near),
b AS (SELECT *, max(containment) OVER (PARTITION BY doc_id, p) AS best FROM c)
SELECT doc_id, template, license, max(containment) AS containment, min(p) AS first_word
FROM b WHERE containment >= {threshold} AND containment = best GROUP BY ALL"""

"""Licence texts in documents, in DataFrame operations alone.

A text's words are its lower-case runs of letters and digits, and its shingles
all runs of ``WORDS`` words. Templates are licence statements, notices and
whole short licences (``TEMPLATES``; any dict of name -> text can be given). A
shingle that occurs in no template can neither retrieve nor verify one, so only
positions of template shingles are kept, by a join with the shingles of the
templates, which are few whatever the corpus.

Templates fall into scales by their number of shingles n: scale L is the least
power of two with L >= n. The text is cut to windows of 2L positions, one every
L. The window's set (its shingles from templates of that scale) and the
templates' sets get min-hashes, each of ``BANDS`` by a hash function of its own,
and each retrieves the templates that agree. In a text that holds a share c of
a template's shingles, however far apart, the template's least shingle is there
with probability c. It retrieves the template if it is the least of its window
too, which it is unless the window holds other templates of that scale. So with
c of ``CONTAINMENT`` or more the template is missed with probability
(1 - c)**BANDS, below 1e-22; where a window's other shingles leave it a share J
of the window's set, (1 - J)**BANDS: below 1e-4 for J of a quarter.

A retrieved template is a match if the whole text holds at least
``CONTAINMENT`` of its distinct shingles, counted exactly, whatever stands
between them (page breaks, headings, comments). Its place is that of the part
which holds most of them, where parts are further than a window apart. Of
matches whose places overlap the ones with the highest containment stay; all of
them where that is equal, as for a notice within a whole licence.

Defined cases: null and empty texts, and texts of under five words, match
nothing, and documents without a match have no row. Rows are told apart even if
doc_ids repeat or are null: each has its own matches. Texts are scanned whole.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, only

WORDS, BANDS, CONTAINMENT = 5, 32, 0.8
#: Most words of all templates together: what is broadcast is bounded by it.
MOST_WORDS = 200_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published
by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions"""
STATEMENTS = {
    "MIT/text": _MIT,
    "MIT/statement": "Released under the MIT License.",
    "MIT/statement-licensed": "Licensed under the MIT License.",
    "ISC/text": _ISC,
    "BSD-2-Clause/text": _BSD,
    "BSD-3-Clause/clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0/notice": _APACHE,
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0/notice": _GPL.format("General Public License", 3),
    "GPL-2.0/notice": _GPL.format("General Public License", 2),
    "AGPL-3.0/notice": _GPL.format("Affero General Public License", 3),
    "LGPL-3.0/notice": _GPL.format("Lesser General Public License", 3),
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/statement": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0/notice": _MPL,
    "Unlicense/text": _UNLICENSE,
    "Zlib/text": _ZLIB,
    "CC-BY-NC-4.0/statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def texts_in(folder: str | Path) -> dict[str, str]:
    """Whole licences: each file <name>.txt of a folder as <name>/text."""
    return {f"{x.stem}/text": x.read_text("utf-8") for x in sorted(Path(folder).glob("*.txt"))}


#: Name -> text; names are SPDX identifiers with the form of the text.
TEMPLATES = STATEMENTS | texts_in(Path(__file__).with_name("license_texts"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hash_at(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(size)])


def shingles_of(table: DataFrame, key: str, text: str, size: int = WORDS) -> DataFrame:
    """key, pos, h: hash of the ``size`` words from word ``pos`` on, for every row of ``table``."""
    cut = table.select(key, _words(F.col(text)).alias("words")).filter(F.size("words") >= size)
    return cut.select(key, "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("pos")).select(key, "pos", _hash_at("words", F.col("pos"), size).alias("h"))


def template_shingles(spark: SparkSession, templates: dict[str, str], size: int = WORDS) -> DataFrame:
    """template, h, n (its distinct shingles), scale; a template of under ``size`` words has none."""
    if sum(len(t.split()) for t in templates.values()) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    texts = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    own = shingles_of(texts, "template", "text", size).select("template", "h").distinct()
    count = own.groupBy("template").agg(F.count("*").alias("n"))
    return own.join(F.broadcast(count), "template").withColumn("scale", F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("int"))


def sketch(sets: DataFrame, keys: list[str], bands: int = BANDS) -> DataFrame:
    """``sets`` (keys, h) -> keys, band, value: the min-hash of each set in each band."""
    least = sets.groupBy(*keys).agg(*[F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(bands)])
    return least.select(*keys, F.posexplode(F.array(*[f"m{k}" for k in range(bands)])).alias("band", "value"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, size: int = WORDS, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each document and matched template: doc_id, template, containment, first_word, last_word."""
    spark = docs.sparkSession
    known = materialize(template_shingles(spark, templates or TEMPLATES, size).coalesce(1), "templates")
    wanted = F.broadcast(known.select("h").distinct())  # at most MOST_WORDS rows
    numbered = only(docs, "doc_id", "text").withColumn("row", F.struct(F.monotonically_increasing_id().alias("place"), "doc_id"))
    hits = materialize(shingles_of(numbered, "row", "text", size).join(wanted, "h").select("row", "pos", "h"), "license-hits")

    scaled = hits.join(F.broadcast(known.select("h", "scale").distinct()), "h")
    own = F.floor(F.col("pos") / F.col("scale"))
    windows = scaled.select("row", "h", "scale", F.explode(F.array(own, own - 1)).alias("window"))
    bands_of = sketch(known.select("template", "scale", "h"), ["template", "scale"], bands)
    found = sketch(windows, ["row", "scale", "window"], bands).join(F.broadcast(bands_of), ["scale", "band", "value"]).select("row", "template").distinct()

    # exact: distinct shingles of the template in the text, and in its parts
    of = ["row", "template"]
    held = hits.join(F.broadcast(known.select("template", "scale", "h", "n")), "h").join(found, of, "left_semi")
    by = Window.partitionBy(*of).orderBy("pos")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(by) > 2 * F.col("scale"), F.lit(True))
    parts = held.withColumn("apart", apart.cast("int")).withColumn("part", F.sum("apart").over(by))
    counted = parts.groupBy(*of, "n", "part").agg(F.collect_set("h").alias("own"), F.min("pos").alias("low"), F.max("pos").alias("high"))  # sets of n at most
    fullest = F.max(F.struct(F.size("own").alias("size"), (-F.col("low")).alias("first"), F.col("high").alias("last"))).alias("part")
    matched = counted.groupBy(*of, "n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("own")))).alias("held"), fullest).filter(F.col("held") >= containment * F.col("n"))
    match = F.struct("template", (F.col("held") / F.col("n")).alias("containment"), (-F.col("part.first")).cast("int").alias("first_word"), (F.col("part.last") + size - 1).cast("int").alias("last_word"))
    # of templates that share a place, such as versions of one licence, those that fit best; a row has no more matches than there are templates
    together = matched.groupBy("row").agg(F.collect_list(match).alias("all"))

    def beaten(m: Column) -> Column:
        return F.exists("all", lambda n: (n["containment"] > m["containment"]) & (n["first_word"] <= m["last_word"]) & (m["first_word"] <= n["last_word"]))

    return together.select("row", F.explode(F.filter("all", lambda m: ~beaten(m))).alias("match")).select("row.doc_id", "match.*")

"""Operator 3: licence scans by the Dice coefficient over word bigrams.

A text's units are its lines, its paragraphs (between blank lines), the whole text, and windows of as many words as a
template has, cut where a chosen bigram of that template occurs (its place less its offset), so that licences of several
paragraphs and headers that touch code are found inside longer files. A unit and a template, both
normalised to lower-case runs of letters and digits, match if the sets of their word bigrams have a Dice
coefficient of at least `threshold`. Candidates are pruned twice before that: a match must hold one of a few
chosen bigrams of its template (those of the longest words, which are in few other texts, and so many that no match can
lack them all), and its size must lie within the bounds
that the threshold leaves, t / (2 - t) to (2 - t) / t of the template's.

All of it is DataFrame expressions. What is broadcast are the templates' bigrams, counted to be few.

Defined results: null, empty and one-word texts match nothing; a null id is carried through like any other; an empty
table gives an empty result; repeated rows give one result row for their id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound, documents, small_join, stored

THRESHOLD = 0.8

# Public licence notices and short licence texts.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
        to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
        intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
        OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
        SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
        notice may not be removed or altered from any source distribution.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU Lesser General Public License for more details.""",
    "agpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Affero General Public License for more details.""",
    "boost-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works
        of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the
        Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies
        of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
        SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "cc0-1.0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    "wtfpl": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the
        name is changed. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
}


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(words: str) -> Column:
    """Distinct hashes of neighbouring words. words names a column, as an expression inside a lambda would be computed once for each element."""
    w = F.col(words)
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in templates.items()]))
    return spark.range(1).select(rows.alias("t")).select("t.license", normal_words(F.col("t.body")).alias("w")).select("license", "w", bigrams("w").alias("template")).where(F.size("template") > 0)


def all_bigrams(words: str) -> Column:
    """Hashes of neighbouring words, one for each place, repeated ones too."""
    w = F.col(words)
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) >= 2, pairs).otherwise(F.array().cast("array<bigint>"))


def bigram_words(words: str) -> Column:
    """struct<h, letters> for each place: the hash of two neighbouring words and how many letters they have."""
    w = F.col(words)
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1)).alias("h"), (F.length(F.get(w, i)) + F.length(F.get(w, i + 1))).alias("letters")))
    return F.when(F.size(w) >= 2, pairs).otherwise(F.array().cast("array<struct<h:bigint,letters:int>>"))


def windows(docs: DataFrame, offsets: list) -> DataFrame:
    """docs (w, pairs: all_bigrams of w, other columns) once for each distinct window (words): offsets are (bigram, offset, words) of the templates."""
    by_bigram: dict[int, list[tuple[int, int]]] = {}
    for r in offsets:
        by_bigram.setdefault(r["bigram"], []).append((r["offset"], r["len"]))
    spots = F.create_map(*[x for b, places in by_bigram.items() for x in (F.lit(b), F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(n).alias("len")) for o, n in places]))])
    hits = F.filter(F.transform("pairs", lambda h, i: F.struct(h.alias("h"), i.alias("at"))), lambda p: F.array_contains(F.array(*[F.lit(b) for b in by_bigram]), p["h"]))
    cut = F.flatten(F.transform("hits", lambda p: F.transform(F.element_at(F.col("spots"), p["h"]), lambda t: F.struct(F.greatest(p["at"] - t["offset"], F.lit(0)).alias("start"), t["len"].alias("len")))))
    docs = bound(bound(docs, "hits", hits).withColumn("spots", spots), "cut", F.array_distinct(cut)).drop("hits", "spots", "pairs")
    at = docs.withColumn("at", F.explode("cut")).drop("cut")
    return at.withColumn("words", F.slice("w", F.col("at.start") + 1, F.col("at.len"))).drop("w", "at")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, dice, unit, n_units): the best unit of each document for each licence that matches; unit is `line`, `paragraph`, `text` or `window`.

    n_units counts lines, paragraphs and the text; windows, which overlap each other and the rest, only where none of those matches.
    """
    whole = stored(template_table(docs.sparkSession, templates or TEMPLATES), "licence-templates")
    table = whole.drop("w")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    # A match shares at least low * size of the template's bigrams, so it holds one of any size - that + 1.
    lacks = F.size("template") - F.ceil(F.size("template") * low).cast("int") + 1
    named = whole.select("license", lacks.alias("lacks"), F.posexplode(bigram_words("w")).alias("at", "b")).groupBy("license", "lacks", "b.h").agg(F.max("b.letters").alias("letters"), F.min("at").alias("at"))
    longest = Window.partitionBy("license").orderBy(F.desc("letters"), "at")
    chosen = stored(named.withColumn("n", F.row_number().over(longest)).where("n <= lacks").select("license", F.col("h").alias("bigram")), "licence-bigrams")

    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    places = bound(whole, "pairs", all_bigrams("w")).select("license", F.size("w").alias("len"), F.posexplode("pairs").alias("offset", "bigram"))
    offsets = places.join(chosen, ["license", "bigram"]).select("bigram", "offset", "len").distinct().collect()  # of the templates only
    looked_for = F.array(*[F.lit(b) for b in sorted({r["bigram"] for r in offsets})])
    some = bound(bound(docs, "w", normal_words(F.col("text"))), "pairs", all_bigrams("w")).where(F.arrays_overlap("pairs", looked_for))
    cut = bound(windows(some.select("id", "w", "pairs"), offsets).withColumn("kind", F.lit("window")).withColumnRenamed("words", "w"), "unit", bigrams("w"))
    of = lambda kind, parts: F.transform(F.array_distinct(parts), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("body")))
    parts = F.concat(of("line", F.split("text", "\n")), of("paragraph", F.split("text", r"\n[\x20\x09-\x0D]*\n")), of("text", F.array("text")))
    units = bound(some.select("id", F.explode(parts).alias("u")).select("id", "u.kind", "u.body"), "w", normal_words(F.col("body")))
    units = bound(units.select("id", "kind", "w"), "unit", bigrams("w")).select("id", "kind", "unit").union(cut.select("id", "kind", "unit")).where(F.size("unit") > 0)
    sizes = table.agg(F.min(F.size("template")).alias("lo"), F.max(F.size("template")).alias("hi")).head()
    units = units.where((F.size("unit") >= F.lit((sizes["lo"] or 0) * low)) & (F.size("unit") <= F.lit((sizes["hi"] or 0) * high)))

    # Licences of which a unit holds a chosen bigram, told within the row: only matches are made distinct, units don't move.
    licences: dict[int, list[str]] = {}
    for r in chosen.collect():
        licences.setdefault(r["bigram"], []).append(r["license"])
    of_bigram = F.create_map(*[x for b, names in licences.items() for x in (F.lit(b), F.array(*[F.lit(n) for n in names]))])
    met = F.array_distinct(F.flatten(F.transform("held", lambda b: F.element_at(F.col("of_bigram"), b))))
    held = bound(units, "held", F.array_intersect("unit", looked_for)).where(F.size("held") > 0).withColumn("of_bigram", of_bigram)
    both = small_join(held.withColumn("license", F.explode(met)).drop("held", "of_bigram"), table, ["license"])
    fits = (F.size("unit") >= F.size("template") * low) & (F.size("unit") <= F.size("template") * high)
    dice = 2 * F.size(F.array_intersect("unit", "template")) / (F.size("unit") + F.size("template"))
    matches = both.where(fits).select("id", "kind", "license", "unit", dice.alias("dice")).where(F.col("dice") >= threshold).distinct()
    is_window = F.col("kind") == "window"
    n_units = F.when(F.count_if(~is_window) > 0, F.count_if(~is_window)).otherwise(F.count("*"))
    best = matches.groupBy("id", "license").agg(F.max("dice").alias("dice"), F.min(F.struct(-F.col("dice"), "kind"))["kind"].alias("unit"), n_units.alias("n_units"))
    return best.select(F.col("id").alias(id_col), "license", F.round("dice", 6).alias("dice"), "unit", "n_units")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    grams = lambda c: f"list_distinct(list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]))"
    normal = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
    with t as (select license, {grams('w')} as g from (select license, {normal('body')} as w from (values {values}) v(license, body))),
    d as (select doc_id, coalesce(text, '') as x from documents),
    u as (select doc_id, 'line' as kind, unnest(list_distinct(string_split(x, chr(10)))) as body from d
          union all select doc_id, 'paragraph', unnest(list_distinct(regexp_split_to_array(x, '\\n[\\x20\\x09-\\x0D]*\\n'))) from d
          union all select doc_id, 'text', x from d),
    ug as (select distinct doc_id, kind, list_sort({grams('w')}) as g from (select doc_id, kind, {normal('body')} as w from u) where len(w) >= 2),
    m as (select doc_id, kind, license, 2.0 * len(list_intersect(ug.g, t.g)) / (len(ug.g) + len(t.g)) as dice
          from ug join t on len(ug.g) between len(t.g) * {THRESHOLD} / (2 - {THRESHOLD}) and len(t.g) * (2 - {THRESHOLD}) / {THRESHOLD})
    select doc_id, license, round(max(dice), 6) as dice, arg_min(kind, (-dice, kind)) as unit, count(*) as n_units
    from m where dice >= {THRESHOLD} group by 1, 2"""

"""Licence notices and whole licences in texts, by Dice coefficient over word bigrams.

DataFrame functions only. A text is one sequence of words, line breaks count as spaces, and of its neighbouring words those pairs
are kept that are not two function words. Every kept bigram that a template has as well is a hit with a place in the text and
one in the template; hits whose places differ by about the same number lie on one band and belong to one possible copy. The copy
is the stretch of the text where the template would lie, so its size stays within the bounds that the template and the threshold give:
Dice >= t wants t / (2 - t) <= a / b <= (2 - t) / t for a and b bigrams. Bands with too few hits for that are out before anything is
scored. Hits come from a hash join with the template bigrams, a few thousand rows from a fixed list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulon.functions.values import bind

THRESHOLD = 0.8
TEMPLATE_BIGRAMS = 20_000  # bound of the broadcast table; more raise
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Words so common that two of them in a row say nothing about a wording.
COMMON = (
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "if", "in", "is", "it", "its", "may",
    "no", "not", "of", "on", "or", "shall", "so", "such", "that", "the", "their", "these", "this", "to", "was", "which", "will", "with", "you",
)

# Customary wording of licence notices, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)


def bigrams(text: Column) -> Column:
    """Kept bigrams of a text in order: ``struct(gram, line)``, the hash of two words and the line (from 0) of the first.

    Words are runs of 0-9, a-z and characters beyond ASCII in lower case. Pairs of two common words are left out.
    """
    each = lambda line, i: F.transform(
        F.filter(F.split(line, SEPARATORS), lambda w: w != ""), lambda w: F.struct(w.alias("w"), w.isin(*COMMON).alias("c"), i.alias("line"))
    )
    words = F.flatten(F.transform(F.split(F.lower(text), "\n"), each))

    # Bound once: an expression inside a lambda would be evaluated anew for every word.
    def pairs(ws: Column) -> Column:
        both = F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        kept = F.filter(both, lambda p: p["b"].isNotNull() & ~(p["a"]["c"] & p["b"]["c"]))
        return F.transform(kept, lambda p: F.struct(F.xxhash64(p["a"]["w"], p["b"]["w"]).alias("gram"), p["a"]["line"].alias("line")))

    return bind(words, pairs)


def template_table(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(template, licence, gram, place, size, once)``, one row per kept template bigram; ``once``: the template has it once."""
    rows = spark.createDataFrame([(n, *t) for n, t in enumerate(templates)], "template int, licence string, wording string")
    grams = rows.select("template", "licence", bigrams(F.col("wording")).alias("grams")).withColumn("size", F.size("grams"))
    placed = grams.select("template", "licence", "size", F.posexplode("grams").alias("place", "g")).select(
        "template", "licence", "size", "place", F.col("g.gram").alias("gram")
    )
    often = placed.groupBy("template", "gram").agg((F.count(F.lit(1)) == 1).alias("once"))
    return placed.join(often, ["template", "gram"])


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, licence, dice, line, n_notices, licences)`` for every row.

    ``n_notices`` is the number of lines at which copies with a Dice coefficient above ``threshold`` begin, ``licences`` the
    names of their licences in order. The other columns describe the copy that shares the most bigrams (ties: the closest, then licence
    by name, then the first line, counted from 0) and are null if there is none, as for null, empty and one-word texts. Repeated rows give
    repeated results.
    """
    table = template_table(docs.sparkSession, templates, threshold)
    count = table.count()
    if count > TEMPLATE_BIGRAMS:
        raise ValueError(f"templates have {count} bigrams, the limit of the broadcast table is {TEMPLATE_BIGRAMS}")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("txt"))
    listed = rows.select("id", "mark", bigrams(F.col("txt")).alias("grams")).withColumn("n", F.size("grams"))
    each = listed.select("id", "mark", "n", F.posexplode("grams").alias("at", "g")).select("id", "mark", "n", "at", "g.line", F.col("g.gram").alias("gram"))
    away, width = F.col("at") - F.col("place"), F.greatest(F.lit(2), F.floor(F.col("size") / 4))
    hits = each.join(F.broadcast(table), "gram").withColumns({"away": away, "width": width})
    # Two rows of bands, the second moved by half a width, so that a copy with a few words more or less lies within one.
    halves = F.array(F.struct(F.lit(0).alias("half"), F.floor(F.col("away") / F.col("width")).alias("band")),
                     F.struct(F.lit(1).alias("half"), F.floor((F.col("away") + F.floor(F.col("width") / 2)) / F.col("width")).alias("band")))
    key = ["id", "mark", "n", "template", "licence", "size", "half", "band"]
    sole = lambda c: F.when(F.col("once"), c)
    # Sets hold the places of one bigram on one band, at most about a template's length; repeated rows do not add to them.
    per_gram = hits.select("*", F.inline(halves)).groupBy(*key, "gram").agg(
        F.least(F.size(F.collect_set("at")), F.size(F.collect_set("place"))).alias("both"), F.min(F.struct("at", "line")).alias("first"),
        F.min("away").alias("low"), F.max("away").alias("high"), F.min(sole(F.col("away"))).alias("low1"), F.max(sole(F.col("away"))).alias("high1"),
    )
    bands = per_gram.groupBy(*key).agg(
        F.sum("both").alias("both"), F.min("first").alias("first"),
        F.coalesce(F.min("low1"), F.min("low")).alias("low"), F.coalesce(F.max("high1"), F.max("high")).alias("high"),
    )
    # From 2 * both / (a + b) > t and a >= both: fewer hits than this can't reach the threshold.
    bands = bands.where(F.col("both") * (2 - threshold) >= threshold * F.col("size"))
    span = F.least(F.col("n") - 1, F.col("high") + F.col("size") - 1) - F.greatest(F.lit(0), F.col("low")) + 1
    scored = bands.withColumn("dice", F.least(F.lit(1.0), 2 * F.col("both") / (span + F.col("size")))).where(F.col("dice") > threshold)
    best = scored.groupBy("id", "mark").agg(
        F.min(F.struct((-F.col("both")).alias("more"), (-F.col("dice")).alias("away"), "licence", F.col("first.line").alias("line"))).alias("best"),
        F.count_distinct("first.line").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
    )
    found = best.withColumnsRenamed({"id": "__id", "mark": "__mark"})
    all_rows = rows.select("id", "mark")
    same = all_rows["id"].eqNullSafe(found["__id"]) & (all_rows["mark"] == found["__mark"])
    return all_rows.join(found, same, "left").select(
        "id", "best.licence", (-F.col("best.away")).alias("dice"), "best.line", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("licences", F.lit("")).alias("licences"),
    )

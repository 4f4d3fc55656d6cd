"""License passages by diagonal voting, in DataFrame operations only.

Every k-gram of consecutive words of a text gets a rolling hash (a cyclic polynomial of its words' hashes) and is joined to the k-grams of the license templates.  A match at word p of the text
and word q of a template votes for the diagonal p - q.  An unbroken copy gives all its votes to one diagonal; words put in or left out move the
rest to neighbouring diagonals, so neighbours whose matches adjoin are merged to spans.  A span is accepted if matches (the join compares words,
not only hashes) cover a sufficient share of the template's words.  A span of which more than half lies in one of another label with a larger share goes, as
licenses differ in few words.

Base phrases are templates that count only if every k-gram votes for one diagonal, which is the place where the phrase stands.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_row_ids

GRAM, GAP, SHARE = 3, 3, 0.8

#: Phrases and labels of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Whole short licenses, the notices by which longer ones are applied, and opening sentences that stand alone as well, with the labels they give.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License version", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike", "cc-by-sa"),
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
    restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
    Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
    PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
    retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
    and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
    EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
    HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
    notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
    AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
    1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
    documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
    notice may not be removed or altered from any source distribution.""", "zlib"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
    form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "unlicense"),
    ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to
    use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
    so""", "bsl-1.0"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache-2"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
    of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "gpl"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation""", "agpl"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
    https://mozilla.org/MPL/2.0/.""", "mpl"),
)
#: The words of a template.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rolled(hashes, gram: int = GRAM):
    """The cyclic polynomial of ``gram`` word hashes: all but the last are rotated by one bit for each word that follows.  Words are hashed once, whatever the number of grams they are in."""
    out = hashes[-1]
    for k, h in enumerate(reversed(hashes[:-1]), 1):
        out = out.bitwiseXOR(F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k)))
    return out


def template_grams(spark, base=BASE, templates=TEMPLATES, gram: int = GRAM) -> DataFrame:
    """(tid, label, base, n_grams, tpos, gram, hash): a row for each k-gram of each template.  The size is that of the lists given."""
    rows = []
    for tid, (text, label, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in templates]):
        words = re.findall(WORD, text.lower())
        n = len(words) - gram + 1
        if n < 1:
            raise ValueError(f"a template needs {gram} words or more: {text!r}")
        rows += [(tid, label, is_base, n, i, " ".join(words[i : i + gram])) for i in range(n)]
    words = F.split("t_gram", " ")
    return spark.createDataFrame(rows, "tid int, label string, base boolean, n_grams int, tpos int, t_gram string").withColumn("hash", rolled([F.xxhash64(words[k]) for k in range(gram)], gram)).coalesce(1)


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES, gap: int = GAP, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; with ``spans``, the accepted spans as well, as an array of
    (label, first word, last word, share of the template).

    Null counts as empty.  Ids may be null or repeated: rows are told apart by their own number.  Other columns are ignored.
    """
    text = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("ĸ")))  # the one other letter whose lower case is in a-z
    docs, own = with_row_ids(docs.select(id_col, text_col), id_col)
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(own).alias("uid"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    words = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    at = F.sequence(F.lit(0), F.size("words") - GRAM)
    every = lambda name, i: [F.get(F.col(name), i + k) for k in range(GRAM)]
    grams = F.when(F.size("words") >= GRAM, F.transform(at, lambda i: F.struct(rolled(every("hashes", i)).alias("hash"), F.concat_ws(" ", *every("words", i)).alias("gram"))))
    rows = words.select("doc_id", "uid", F.size("words").cast("long").alias("n_words"), grams.alias("grams"))
    rows = rows.select("doc_id", "uid", "n_words", F.posexplode_outer("grams").alias("pos", "g")).select("doc_id", "uid", "n_words", "pos", "g.hash", "g.gram")
    votes = rows.join(F.broadcast(template_grams(docs.sparkSession, base, templates)), "hash", "left")
    agree = F.col("gram") == F.col("t_gram")
    votes = votes.where(agree | F.coalesce(F.col("pos") == 0, F.lit(True))).select("doc_id", "uid", "n_words", "pos", *(F.when(agree, F.col(c)).alias(c) for c in ("tid", "label", "base", "n_grams", "tpos")))
    votes = votes.repartition("uid")
    diagonals = votes.groupBy("uid", "doc_id", "n_words", "tid", "label", "base", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("tpos").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("tpos").alias("seen"))
    order = Window.partitionBy("uid", "tid").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > gap) | (F.col("low") > F.lag("high").over(order) + GRAM + gap) | (F.col("high") < F.lag("low").over(order) - GRAM - gap)
    spanned = diagonals.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("base") & (F.col("votes") == F.col("n_grams"))
    spanned = spanned.groupBy("uid", "doc_id", "n_words", "tid", "label", "base", "n_grams", "span").agg(
        F.count(F.when(place, 1)).alias("places"), F.min(F.when(place, F.col("diagonal"))).alias("first"), F.max(F.when(place, F.col("diagonal"))).alias("last"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda t: F.sequence(t, t + GRAM - 1)))))
    whole = F.col("n_grams") + GRAM - 1
    spanned = spanned.withColumn("covered", covered).drop("seen")
    part = F.col("covered") / F.greatest(whole, F.col("high") + GRAM - F.col("low"))
    good = F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("covered") / whole >= share)
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    out = spanned.groupBy("uid", "doc_id", "n_words").agg(
        F.coalesce(F.sum("places"), F.lit(0)).alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        joined(F.when(F.col("base") & good, F.col("label"))).alias("base_labels"), F.collect_set(F.when(F.col("base") & good, F.col("label"))).alias("own"),
        F.coalesce(F.max(F.when(good, F.when(F.col("base"), 1.0).otherwise(part))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("label", F.col("low").cast("long").alias("first"), (F.col("high") + GRAM - 1).cast("long").alias("last"), part.alias("share"), F.col("base").alias("sure"))))).alias("found"),
    )
    better = lambda s, o: (o["label"] != s["label"]) & ~o["sure"] & (2 * (F.least(s["last"], o["last"]) - F.greatest(s["first"], o["first"]) + 1) > s["last"] - s["first"] + 1) & (o["share"] > s["share"])
    out = out.withColumn("kept", F.filter("found", lambda s: s["sure"] | ~F.exists("found", lambda o: better(s, o))))
    out = out.withColumn("labels", F.concat_ws(",", F.array_sort(F.array_union("own", F.transform("kept", lambda s: s["label"])))))
    out = out.withColumn("spans", F.transform("kept", lambda s: F.struct(s["label"].alias("label"), s["first"].alias("first"), s["last"].alias("last"), s["share"].alias("share"))))
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *["spans"] * spans)

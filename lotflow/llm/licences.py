"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

Paragraphs are lines of a text; a longer one is also taken by sentences, and a long sentence by overlapping windows of
words, so that a notice inside other text is a piece of its own. A multinomial logistic regression over hashed word
unigrams and bigrams, trained with a ridge penalty on notices written from the templates, on notices of licences outside
the families and on paragraphs of the documents, names a family or ``unknown``. A second logistic regression, on notices
and paragraphs that the first did not see (other licences' names among them), turns its margin into the probability that
there is a notice of a family at all.

What it names is then compared with the family's own templates. A piece is confirmed if it holds one of ``STEMS``, at
least one word pair that only this family's templates have, and either half of its word pairs are in one template or
nearly all pairs of one template are in it. Lines without any of the stems can therefore not be confirmed and are left
out before they are cut into pieces.

Everything is DataFrame and SQL functions and Spark's own ML stages; no Python runs on the executors. Bounds on what is
fitted: the templates below and ``negatives`` paragraphs (of longer ones a slice of 500 characters), from about as many
documents, chosen by hashes of their texts.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotflow.llm.arrow import only
from lotflow.llm.sampling import slice_of
from lotflow.runtime import cut

UNKNOWN = "unknown"
NONE = "none"

#: Names by which each family is called, and a sentence of its text.
FAMILIES = {
    "apache-2.0": (("Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 license"), "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind."),
    "agpl": (("GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL v3", "AGPL-3.0-or-later"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    "boost": (("Boost Software License, Version 1.0", "BSL-1.0", "Boost Software License"), "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license."),
    "bsd": (("BSD License", "BSD-3-Clause", "BSD-2-Clause license", "3-clause BSD license"), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "cc-by": (("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"), "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit."),
    "cc-by-nc": (("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"), "You may not use the material for commercial purposes."),
    "cc-by-sa": (("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"), "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."),
    "cc0": (("CC0 1.0 Universal", "CC0-1.0", "public domain dedication CC0"), "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide."),
    "epl": (("Eclipse Public License 2.0", "EPL-2.0", "Eclipse Public License, version 1.0", "EPL-1.0"), "This program and the accompanying materials are made available under the terms of the Eclipse Public License."),
    "gpl": (("GNU General Public License, version 3", "GPL-3.0", "GNU General Public License version 2", "GNU GPL v3", "GPL-2.0-or-later"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "isc": (("ISC License", "ISC"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "lgpl": (("GNU Lesser General Public License, version 3", "LGPL-3.0", "GNU Lesser General Public License version 2.1", "LGPL-2.1"), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    "mit": (("MIT License", "MIT", "Expat license"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "mpl": (("Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License 2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License. If a copy was not distributed with this file, you can obtain one."),
    "reserved": (("All rights reserved",), "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher. All rights reserved."),
}
_UNLICENSE = "This is free and unencumbered software released into the public domain."
FAMILIES["unlicense"] = (("The Unlicense", "Unlicense"), _UNLICENSE)
FAMILIES["zlib"] = (("zlib License", "zlib/libpng license"), "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.")
#: Names of licences outside the families; they teach and calibrate ``unknown``.
OTHERS = (
    "European Union Public Licence 1.2", "SIL Open Font License 1.1", "Sun Public License 2.0", "Netscape Public License, version 1.1", "Artistic License 2.0", "Common Development and Distribution License 1.0",
    "Academic Free License 3.0", "Python Software Foundation License", "Microsoft Public License", "Open Software License 3.0", "Sleepycat License", "IBM Public License 1.0",
    "Business Source License 1.1", "Server Side Public License", "Elastic License 2.0", "Acme Commercial License, version 3", "end user agreement", "Open Database License",
)
#: Parts of lower-case words of which every notice has at least one.
STEMS = (
    "licen", "copyright", "rights reserved", "permission", "permit", "redistribut", "public domain", "creative commons", "cc0", "cc by", "cc-by", "apache", "mozilla", "mpl", "bsd", "gpl", "epl-", "bsl-",
    "as is basis", "free software", "warrant", "appropriate credit", "commercial purpose", r"\bmit\b", r"\bisc\b", "zlib", "dedicated the work", "neither the name", "held liable", "in the software", "software is furnished", "applicable law", "share and adapt", "remix", "as-is",
)
#: More sentences of the usual full texts and headers.
_FULLER = {
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "gpl": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "agpl": ("You should have received a copy of the GNU Affero General Public License along with this program.",),
    "isc": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',),
    "lgpl": ("You should have received a copy of the GNU Lesser General Public License along with this library.",),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}
_WAYS = (
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Licensed under {}.", "Distributed under the terms of the {}.", "This software is released under the {}.",
    "{}", "SPDX-License-Identifier: {}", "License: {}", "Available under the {} license.", "This project is licensed under {}.", "See the {} for details.", "Published under {}.",
)
#: Sentences that use a licence's words and are no notice of one.
_DECOYS = (
    "The driver's license expired last year.", "Permission was granted to enter the building.", "They applied for a fishing license.", "The general public was invited to the gnu enclosure.", "The apache helicopter landed.",
    "The software was released on Monday.", "All rights were debated in parliament.", "A version of the work is distributed to the public.", "Version 2.0 of the plan was published.", "The university mit a course is free.",
    "The terms of the contract were reserved.", "Copies of the library are free of charge.", "This project is under review.", "The work is done.",
)


def _notices() -> list[tuple[str, str, int]]:
    """(family, text, part): part 0 trains the families, part 1 the calibration."""
    out = []
    for family, (names, sentence) in FAMILIES.items():
        ways = [n + "." for n in names] + ["Copyright (c) 2020. " + n + "." for n in names] if family == "reserved" else [w.format(n) for n in names for w in _WAYS]
        out += [(family, w, int(k % 4 == 3)) for k, w in enumerate(ways)] + [(family, sentence, 0), (family, sentence.split(",")[0], 1)] + [(family, w, 0) for w in _FULLER.get(family, ())]
    others = [(UNKNOWN, w.format(n), k % 2) for k, n in enumerate(OTHERS) for w in _WAYS]
    return out + others + [(UNKNOWN, d, k % 2) for k, d in enumerate(_DECOYS)]


def _rows(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small fixed table as an expression."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, place, paragraph): the non-blank lines of every text."""
    return only(docs, "doc_id", "text").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("place", "paragraph")).where(r"paragraph rlike '\\S'")


def with_stem(rows: DataFrame) -> DataFrame:
    """Rows whose paragraph holds one of ``STEMS``."""
    return rows.where(F.lower("paragraph").rlike("|".join(STEMS)))


def pieces(lines: DataFrame) -> DataFrame:
    """``lines`` with every paragraph also by sentences, and sentences above 32 words by windows of 24 that overlap by half.

    A line of more than 64 words comes by its pieces only: any template, or half of a long one, fits into one of them.
    """
    words = "split(trim({}), '\\\\s+')"
    windows = f"transform(sequence(0, size({words.format('s')}) - 13, 12), i -> array_join(slice({words.format('s')}, i + 1, 24), ' '))"
    parts = f"flatten(transform(filter(sentences, s -> s rlike '\\\\S'), s -> if(size({words.format('s')}) > 32, {windows}, array(s))))"
    whole = f"if((size(sentences) > 1 or size({words.format('paragraph')}) > 32) and size({words.format('paragraph')}) <= 64, array(paragraph), slice(sentences, 1, 0))"
    split = lines.withColumn("sentences", F.split("paragraph", r"(?<=[.!?])\s+"))
    return split.select("doc_id", "place", F.explode(F.expr(f"array_distinct(concat({whole}, {parts}))")).alias("paragraph"))


def _pairs(words: str) -> str:
    """SQL of the distinct adjacent word pairs of an array of words, or its words if there is but one."""
    return f"case when size({words}) > 1 then array_distinct(transform(sequence(1, size({words}) - 1), i -> concat(element_at({words}, i), ' ', element_at({words}, i + 1)))) else {words} end"


class LicenceModel:
    """The fitted classifier, its calibration and the template table."""

    def __init__(self, spark: SparkSession, negatives: DataFrame, features_log2: int = 12, penalty: float = 1e-4):
        """Notices are learned alone and with words of a counter-example before and after them."""
        names = sorted([UNKNOWN, *FAMILIES])
        self.names, self.spark = names, spark
        code = F.element_at(F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(float(k)))]), F.col("family"))
        notices = _rows(spark, [(*n, k) for k, n in enumerate(_notices())], ("family", "paragraph", "part", "k"))
        around = negatives.select(F.split("paragraph", r"\s+").alias("around"), (F.row_number().over(Window.orderBy(F.xxhash64("paragraph"), "paragraph")) - 1).alias("k"))
        within = notices.where(F.col("family") != UNKNOWN).join(around, "k").select("family", F.concat_ws(" ", F.slice("around", 1, 6), "paragraph", F.slice("around", 7, 6)).alias("paragraph"), "part")
        table = notices.drop("k").unionByName(within).unionByName(negatives.select(F.lit(UNKNOWN).alias("family"), "paragraph", F.pmod(F.xxhash64("paragraph"), F.lit(2)).cast("int").alias("part"))).withColumn("label", code).coalesce(2)
        self.stages = Pipeline(stages=[
            RegexTokenizer(inputCol="paragraph", outputCol="words", pattern=r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)", toLowercase=True),
            NGram(n=2, inputCol="words", outputCol="pairs"),
        ]).fit(table)
        self.hash = HashingTF(numFeatures=1 << features_log2, inputCol="grams", outputCol="features", binary=True)
        train = self._features(table).cache()
        self.model = LogisticRegression(family="multinomial", regParam=penalty, maxIter=25, standardization=False).fit(train.where("part = 0"))
        self.margins = VectorAssembler(inputCols=["margin"], outputCol="margins")
        held = self.margins.transform(self._named(train.where("part = 1").select("family", "features"))).withColumn("label", F.expr(f"double(family <> '{UNKNOWN}')"))
        self.calibration = LogisticRegression(featuresCol="margins", labelCol="label", predictionCol="p1", rawPredictionCol="r1", probabilityCol="q1", regParam=1e-3, maxIter=60).fit(held.select("margins", "label"))
        train.unpersist()

    def _features(self, rows: DataFrame) -> DataFrame:
        return self.hash.transform(self.stages.transform(rows).withColumn("grams", F.concat("words", "pairs")))

    def _named(self, rows: DataFrame) -> DataFrame:
        """The best family, and by how much it beats ``unknown`` in log odds."""
        unknown = self.names.index(UNKNOWN) + 1
        return (
            self.model.transform(rows)
            .withColumn("raw", vector_to_array("rawPrediction"))
            .withColumn("best", F.expr(f"array_max(transform(raw, (x, k) -> case when k + 1 <> {unknown} then x end))"))
            .withColumn("named", F.element_at(F.array(*[F.lit(n) for n in self.names]), F.expr("array_position(raw, best)").cast("int")))
            .withColumn("margin", F.expr(f"best - element_at(raw, {unknown})"))
        )

    def classify(self, rows: DataFrame, least: float = 0.5, overlap: float = 0.5, contained: float = 0.8) -> DataFrame:
        """(doc_id, place, paragraph, family, probability) of paragraphs that are confirmed notices."""
        found = self.margins.transform(self._named(self._features(rows)).select("doc_id", "place", "paragraph", "words", "named", "margin"))
        found = self.calibration.transform(found).withColumn("probability", F.element_at(vector_to_array("q1"), 2)).where(F.col("probability") >= least)
        templates = self.templates()
        confirmed = f"exists(templates, t -> size(array_intersect(mine, t)) >= {overlap} * size(mine) or size(array_intersect(mine, t)) >= {contained} * size(t))"
        known = found.withColumn("mine", F.expr(_pairs("words"))).join(F.broadcast(templates), "named").where(F.expr(f"size(mine) > 0 and arrays_overlap(mine, own) and {confirmed}"))
        return known.select("doc_id", "place", "paragraph", F.col("named").alias("family"), "probability")

    def templates(self) -> DataFrame:
        """(named, templates, own): one row a family, its templates' word pairs and those that no other family has."""
        rows = self.stages.transform(_rows(self.spark, [(f, w) for f, w, _ in _notices() if f != UNKNOWN], ("named", "paragraph"))).select("named", F.expr(_pairs("words")).alias("template"))
        single = rows.select("named", F.explode("template").alias("pair")).groupBy("pair").agg(F.count_distinct("named").alias("k"), F.first("named").alias("named")).where("k = 1")
        return rows.groupBy("named").agg(F.collect_list("template").alias("templates")).join(single.groupBy("named").agg(F.collect_list("pair").alias("own")), "named")


def scan(docs: DataFrame, negatives: int = 2000, **params) -> DataFrame:
    """(doc_id, family, n_notices, n_families, first_line, probability) for every row of ``docs(doc_id, text)``.

    family is that of the most probable confirmed notice (ties: the earliest line), ``none`` without one. Lines count
    from 0; the pieces of a line that name the same family are one notice. Null and empty texts have none. Rows that share an id share their notices, those of a null id among
    themselves. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    lines = with_stem(pieces(with_stem(paragraphs(docs))))
    share = min(1.0, negatives / max(1, docs.count()))
    some = pieces(paragraphs(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)))
    plain = some.where("not lower(paragraph) rlike 'licen|copyright|rights reserved|public domain|permission|redistribut|creative commons'")
    sample = plain.select(slice_of("paragraph", 500).alias("paragraph")).orderBy(F.xxhash64("paragraph"), "paragraph").limit(negatives)
    model = LicenceModel(spark, cut(sample))
    notices = model.classify(lines, **params).groupBy("doc_id", "place", "family").agg(F.max("probability").alias("probability"))
    hits = notices.groupBy("doc_id").agg(
        F.max(F.struct("probability", (-F.col("place")).alias("p"), "family")).alias("top"), F.count("*").alias("n"), F.count_distinct("family").alias("k")
    )
    ids = only(docs, "doc_id").withColumnRenamed("doc_id", "id")
    return ids.join(hits, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(
        F.col("id").alias("doc_id"), F.coalesce("top.family", F.lit(NONE)).alias("family"), F.coalesce("n", F.lit(0)).alias("n_notices"), F.coalesce("k", F.lit(0)).alias("n_families"),
        (-F.col("top.p")).alias("first_line"), F.coalesce("top.probability", F.lit(0.0)).alias("probability"),
    )

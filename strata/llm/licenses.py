"""License scan: a trained paragraph classifier, with DataFrame functions only.

A paragraph is a line with words together with the lines that go on with it: a
line goes on when the one before it ends within a sentence and it begins, after
comment signs, with a small letter, as in a notice wrapped at some width.  Each
becomes a sparse vector of hashed words and word pairs.  A multinomial logistic regression, trained on variants of license
notices against paragraphs drawn from the corpus, gives each family's odds.  A
second regression on held-out variants and paragraphs calibrates how far the
best family must lie above "none"; a paragraph below an even chance is of the
unknown class.  Paragraphs above it are compared with the family's notices:
enough of a notice's three-word shingles must occur, or the family stays
unconfirmed and is reported as ``unknown``.

The fit uses bounded samples: every notice in ``VARIANTS`` variants, and the
paragraphs of about ``sample_docs`` documents, chosen by a hash of the id.  The
scan covers every paragraph of every document.

Cases: null and empty texts have no paragraphs.  Paragraphs of any length are
read whole.  Repeated rows give their own findings; repeated lines each count.
An empty table gives no rows.  Extra columns are not read.  Of equally likely
families the first listed is taken.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import documents, written
from strata.session import ensure_checkpoint_dir

# Opening sentences and short notices of license families.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "mit": ("Released under the MIT License.", "This project is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Distributed under the terms of the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "Licensed under the GNU General Public License, version 2."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved. No part of this publication may be reproduced without permission."),
}
FAMILIES = ("none", *NOTICES)
VARIANTS = 16          # copies of each notice, most with words left out
DIMENSIONS = 1 << 12
CONFIRM_PCT = 50       # of a notice's shingles that must occur to confirm

_FEATURES = "features"
_GOES_ON = "\x01"
_WRAP = r"(?<=[^.!?:\s])([\t\x20\r]*)\n(?=[\t\x20#*/>;-]*+[\"'(]?\p{Ll})"


def words_of(text: Column) -> Column:
    """Lower-case words; hyphens and points inside a word are kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)?"), F.lit(0))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, paragraph, words``: every paragraph with words, under its first line's number, from 0."""
    text = F.translate(F.col(text_col), _GOES_ON, " ")
    marked = F.regexp_replace(text, _WRAP, f"$1\n{_GOES_ON}")
    # through a generator, so that the text is searched for wrapped lines once
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.array(marked)).alias("marked"))
    first = F.filter(F.transform(F.split("marked", "\n"), lambda line, i: F.when(~line.startswith(_GOES_ON), i)), lambda i: i.isNotNull())
    whole = F.split(F.replace("marked", F.lit(f"\n{_GOES_ON}"), F.lit(" ")), "\n")
    rows = marked.select("doc_id", F.explode(F.arrays_zip(first.alias("paragraph"), whole.alias("text"))).alias("p")).select("doc_id", "p.paragraph", "p.text")
    with_words = rows.filter(F.lower("text").rlike(r"[\p{L}\p{N}]"))      # cuts no paragraph in words twice
    return with_words.select("doc_id", "paragraph", words_of(F.col("text")).alias("words"))


def _vectors(rows: DataFrame) -> DataFrame:
    """Adds the sparse vector of distinct words and word pairs, of length 1."""
    pairs = NGram(n=2, inputCol="words", outputCol="__pairs").transform(rows)
    terms = pairs.withColumn("__terms", F.concat("words", "__pairs"))
    hashed = HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="__terms", outputCol="__counts").transform(terms)
    return Normalizer(inputCol="__counts", outputCol=_FEATURES).transform(hashed).drop("__pairs", "__terms", "__counts")


def _shingles(words: Column) -> Column:
    """Distinct three-word shingles; fewer words are one shingle."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.array_distinct(many)


def notices(spark: SparkSession) -> DataFrame:
    """``label, words, shingles`` of each notice."""
    rows = [(FAMILIES.index(f), t) for f, texts in NOTICES.items() for t in texts]
    return spark.createDataFrame(rows, "label int, text string").select(
        "label", words_of(F.col("text")).alias("words")).withColumn("shingles", _shingles(F.col("words")))


def training_rows(docs: DataFrame, sample_docs: int) -> DataFrame:
    """``words, label, held_out``: variants of the notices and drawn paragraphs.

    Variant 0 is the notice itself; the others leave out about one word in
    seven.  Drawn paragraphs that share a shingle with a notice are left out.
    """
    spark = docs.sparkSession
    base = notices(spark)
    varied = base.select("label", "words", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    dropped = varied.select("label", F.when(F.col("v") == 0, F.col("words")).otherwise(F.filter(
        "words", lambda w, i: F.pmod(F.xxhash64(w, i, F.col("v")), F.lit(7)) != 0)).alias("words"), (F.col("v") % 4 == 3).alias("held_out"))
    total = max(docs.count(), 1)
    scale = 1 << 40
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(scale)) < int(scale * min(1.0, sample_docs / total)))
    known = [r.s for r in base.select(F.explode("shingles").alias("s")).distinct().collect()]      # of the fixed notices
    # through a generator no filter is pushed, so that a line is cut in words and shingles once
    cut = paragraphs(drawn).select("doc_id", "paragraph", F.explode(F.array("words")).alias("words"))
    cut = cut.select("doc_id", "paragraph", "words", F.explode(F.array(_shingles(F.col("words")))).alias("shingles"))
    others = cut.filter(~F.arrays_overlap("shingles", F.array(*map(F.lit, known))))
    others = others.select(F.lit(0).alias("label"), "words", (F.pmod(F.xxhash64("doc_id", "paragraph"), F.lit(4)) == 3).alias("held_out"))
    return written(dropped.filter(F.size("words") > 0).union(others), "license-rows")


class LicenseModel:
    """The paragraph classifier and the calibration of its margin."""

    def __init__(self, families: LogisticRegressionModel, slope: float, offset: float):
        self.families, self.slope, self.offset = families, slope, offset

    def judged(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` (by number, never none) and its calibrated ``probability``."""
        raw = margins(self.families, rows)
        return raw.withColumn("probability", 1 / (1 + F.exp(-(F.col("margin") * self.slope + self.offset))))


def margins(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Adds the best family and how far its log odds lie above none's."""
    kept = rows.columns
    scored = model.transform(_vectors(rows)).select(*kept, vector_to_array("rawPrediction").alias("__raw"))
    # through a generator no filter is pushed, so that a paragraph is hashed and scored once
    scored = scored.select(*kept, F.explode(F.array("__raw")).alias("__raw"))
    odds = F.slice("__raw", 2, len(FAMILIES) - 1)
    return scored.select(*kept, F.array_position(odds, F.array_max(odds)).cast("int").alias("family"),
                         (F.array_max(odds) - F.col("__raw")[0]).alias("margin"))


def fit(docs: DataFrame, sample_docs: int = 500) -> LicenseModel:
    """Train on the bounded samples; see the module's text."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = training_rows(docs, sample_docs)
    sizes = {bool(r.none): r.n for r in rows.filter("not held_out").groupBy((F.col("label") == 0).alias("none")).agg(F.count("*").alias("n")).collect()}
    # notices and other paragraphs weigh the same
    weight = F.when(F.col("label") == 0, F.lit(sizes.get(False, 1) / max(sizes.get(True, 1), 1))).otherwise(F.lit(1.0))
    train = _vectors(rows.filter("not held_out")).withColumn("weight", weight).coalesce(2).cache()
    families = LogisticRegression(family="multinomial", weightCol="weight", regParam=2e-4, elasticNetParam=0.2, maxIter=25,
                                  standardization=False).fit(train)
    train.unpersist()
    held = margins(families, rows.filter("held_out")).select(F.array("margin").alias("m"), (F.col("label") > 0).cast("double").alias("label"))
    held = written(held.select(array_to_vector("m").alias("features"), "label"), "license-margins")
    if held.select("label").distinct().count() < 2:      # no paragraph in the sample: the margin as it is
        return LicenseModel(families, 1.0, 0.0)
    platt = LogisticRegression(regParam=1e-2, maxIter=40, standardization=False).fit(held)
    return LicenseModel(families, float(platt.coefficients[0]), float(platt.intercept))


def license_paragraphs(docs: DataFrame, model: LicenseModel | None = None, sample_docs: int = 500, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id, paragraph, license, family, probability, shared_pct, confirmed``.

    One row per paragraph that is more likely a license than not.  ``family``
    is the classifier's, ``license`` the same if the comparison confirms it
    and ``unknown`` if not; ``shared_pct`` is the largest share of a notice of
    the family whose shingles occur.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = model or fit(docs, sample_docs)
    likely = model.judged(paragraphs(docs)).filter("probability >= 0.5")
    spark = docs.sparkSession
    texts = {r.label: [] for r in notices(spark).select("label").distinct().collect()}
    for r in notices(spark).collect():      # the fixed notices
        texts[r.label].append(r.shingles)
    here = _shingles(F.col("words"))
    shared = F.coalesce(*[F.when(F.col("family") == k, F.greatest(F.lit(0.0), *[
        100.0 * F.size(F.array_intersect(F.col("__here"), F.array(*map(F.lit, s)))) / len(s) for s in lists])) for k, lists in texts.items()])
    found = likely.withColumn("__here", here).withColumn("shared_pct", shared)
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("family") + 1)
    confirmed = F.col("shared_pct") >= CONFIRM_PCT
    return found.select("doc_id", "paragraph", F.when(confirmed, name).otherwise(F.lit("unknown")).alias("license"),
                        name.alias("family"), "probability", "shared_pct", confirmed.alias("confirmed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License paragraphs of all documents."""
    return license_paragraphs(documents(spark, sf_dir))

"""Licence scans: which licence families the paragraphs of a text name, with DataFrame functions only.

A multinomial logistic regression over binary word n-grams (Spark ML, sparse vectors, absolute penalty, so that few
n-grams keep a weight) is trained on windows of words from short notices of each family and on windows of the corpus
that hold none.  A window is a family's if its probability
is above a level that is calibrated so that windows without licences stay below it, and if the window then agrees with a
notice of that family word pair by word pair; all else is unknown.

Paragraphs are stretches of lines between blank lines.  Each line, and each paragraph of several lines as a whole, is
scored in overlapping windows of WINDOW words, so that neither prose around a notice nor line ends inside it matter.

The model is linear, so it also tells which words a window must hold to reach the level at all (``needed_words``): the
fewest and rarest such that the n-grams without them can't.  Texts, and then windows, with none of them aren't scored.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.store import keep

#: Short notices of each family.
NOTICES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL version 3 or later.", "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind."],
    "bsd": ["Released under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "This work is released under the Creative Commons Zero public domain dedication."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPL version 2 or later.", "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3 or later."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
}
#: Sentences that speak of licences but grant none.
OTHERS = [
    "He lost his driving license last year.", "The board may license new doctors after an examination.", "She was licensed as a pilot in this country.", "A license fee is due for every television set.", "The general public was invited to the event.",
    "The text was released under a new title.", "This work is the first of its kind.", "The version that we use is 2.0.", "The article was published by the foundation.", "", "the", "of the", "under the", "This", "a", "version 3",
]
FAMILIES = ("unknown", *sorted(NOTICES))
#: N-grams that have a place in the vectors at most, training windows that each is in at least, words of an n-gram,
#: windows of the corpus that train the unknown class at most.
FEATURES, IN_WINDOWS, NGRAM, BACKGROUND = 1 << 16, 2, 3, 2_000
#: Weight of the penalty on the absolute values.
PENALTY = 1e-3
#: Words of a window, and from one window's start to the next; words of the pieces of notices that train a family.
WINDOW, STEP, PIECE = 24, 12, 12
MOST = 1 << 30
#: Share of a notice's, or of the window's, word pairs that must agree, and the fewest that may.
AGREE, LEAST_PAIRS = 0.7, 3
#: Share of windows without licence that the calibrated level keeps unknown.
KEPT_UNKNOWN = 0.999
#: A family must be likelier than all else together, whatever the calibration says.
LEAST_LEVEL = 0.5
#: Windows with such words don't train the unknown class: they may hold notices.
DOUBTFUL = r"licen[sc]|copyright|public domain|redistribut|permission|warrant|\bcc[ -]"
#: The line end of a blank line.
BLANK = r"\n[ \t\r\x0b\x0c]*\n"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def grams_of(words: Column) -> Column:
    """The words, and their n-grams of up to NGRAM words."""
    return F.concat(words, *[_ngrams(words, n) for n in range(2, NGRAM + 1)])


def _ngrams(words: Column, n: int) -> Column:
    """The n-grams of words, by zipping the words with themselves shifted: a lambda that took them from ``words`` by
    place would split the text again for each place once the optimizer has put the expression in."""
    grams = words
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(words, k + 1, MOST), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_compact(grams)  # those that run over the end are null


def pairs_of(words: Column) -> Column:
    """The distinct pairs of words in a row; a word alone is one."""
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(_ngrams(words, 2)))


def paragraphs_of(text: Column) -> Column:
    """The stretches of lines between blank lines."""
    return F.split(F.coalesce(text, F.lit("")), BLANK, -1)


def windows(rows: DataFrame) -> DataFrame:
    """rows (k, text) -> k, no (of the paragraph), words of every window: of each line that has words, and of each
    paragraph of several lines.  Texts of fewer words are one window."""
    paragraphs = rows.select("k", F.posexplode(paragraphs_of(F.col("text"))).alias("no", "paragraph"))
    several = F.when(F.col("paragraph").contains("\n"), F.concat(F.array("paragraph"), F.split("paragraph", "\n", -1))).otherwise(F.array("paragraph"))
    units = paragraphs.select("k", "no", F.explode(several).alias("unit")).where("unit <> ''")
    spoken = units.select("k", "no", words_of(F.col("unit")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - WINDOW + STEP), F.lit(STEP))
    return spoken.select("k", "no", F.explode(F.transform(starts, lambda s: F.slice("all", s, WINDOW))).alias("words"))


def needed_words(vocabulary: list[str], margins: np.ndarray, intercepts: np.ndarray, level: float, seen: dict[str, int]) -> list[str]:
    """Words of which a window must hold one for any family to reach ``level``.

    margins (family, n-gram) and intercepts are what the model adds to a family beyond the unknown class.  The
    probability of a family is at most 1 / (1 + exp(-margin)), so while the n-grams without the chosen words can't lift
    its margin to the level's log-odds, no window without these words can.  Words that take most and that the corpus's
    sample (``seen``) holds least come first."""
    bar = math.log(level / (1 - level)) if level < 1 else math.inf
    gains = np.maximum(margins, 0)
    grams_with: dict[str, list[int]] = {}
    for k, gram in enumerate(vocabulary):
        for word in gram.split(" "):
            grams_with.setdefault(word, []).append(k)
    left = np.ones(len(vocabulary), bool)
    chosen: list[str] = []
    while True:
        over = intercepts + gains[:, left].sum(axis=1) >= bar
        if not over.any():
            return chosen
        worth = {w: gains[np.ix_(over, ks)][:, left[ks]].sum() / (1 + seen.get(w, 0)) for w, ks in grams_with.items() if w not in chosen}
        best = max(worth, key=lambda w: (worth[w], w), default=None)
        if best is None:
            return list(grams_with)
        chosen.append(best)
        left[grams_with[best]] = False


class Classifier:
    def __init__(self, places: CountVectorizerModel, model: LogisticRegressionModel, level: float = 0.5, needed: list[str] | None = None):
        self.places, self.model, self.level, self.needed = places, model, level, needed

    def vectors(self, rows: DataFrame) -> DataFrame:
        return self.places.transform(rows.withColumn("grams", grams_of(F.col("words"))))

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """rows (words) with family, the likeliest but unknown, and its probability p."""
        found = self.model.transform(self.vectors(rows)).drop("grams", "features", "rawPrediction", "prediction")
        found = found.withColumn("probability", F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1))
        names = F.array(*[F.lit(f) for f in FAMILIES[1:]])
        best = F.array_max("probability")
        return found.withColumn("family", F.get(names, F.array_position("probability", best).cast("int") - 1)).withColumn("p", best).drop("probability")

    def likely(self, rows: DataFrame) -> DataFrame:
        """rows (words) above the level with family."""
        if self.needed is not None:
            rows = rows.where(F.arrays_overlap("words", F.lit(self.needed).cast("array<string>")))
        # As a generator and not as a filter, which would go below the model and have it compute every window twice.
        hits = F.explode_outer(F.filter(F.array(F.struct("family", "p")), lambda x: x["p"] > self.level))
        return self.probabilities(rows).withColumn("hit", hits).where("hit is not null").withColumn("family", F.col("hit.family")).drop("hit", "p")

    def may_hold(self, text: Column) -> Column:
        """Whether a text may hold a window above the level."""
        if self.needed is None:
            return F.lit(True)
        # Letters beyond ASCII count as ends of words here, which can only let more texts through.
        words = "|".join(map(re.escape, sorted(self.needed)))
        return F.lower(text).rlike(f"(?:^|[^a-z0-9])(?:{words})(?![a-z0-9])") if self.needed else F.lit(False)


def sample_windows(docs: DataFrame) -> DataFrame:
    """BACKGROUND windows (words) at most, one of a document each, by hash.  Documents are drawn by a share that their
    count sets, then by the order of their hashes, so what is drawn is bounded and no document that isn't drawn is split."""
    drawn = F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64), F.lit(17))
    share = min(1.0, 8 * BACKGROUND / max(1, docs.count()))
    some = docs.select(drawn.alias("h"), "text").where(F.pmod("h", F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    paragraphs = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = some.select("h", paragraphs.alias("lines")).select("h", F.get("lines", F.pmod(F.col("h"), F.size("lines")).cast("int")).alias("line"))
    spoken = lines.select("h", words_of(F.col("line")).alias("all")).where(F.size("all") > 0)
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.size("all") - WINDOW + 1)).cast("int")
    picked = spoken.select("h", F.slice("all", start + 1, WINDOW).alias("words")).where(~F.array_join("words", " ").rlike(DOUBTFUL))
    return keep(picked.orderBy("h", "words").limit(BACKGROUND), "licence-background").select("words")


def train(docs: DataFrame) -> Classifier:
    """From the notices, whole and in pieces of their words, and from a bounded sample of the corpus's windows.

    Every fifth piece and window, by hash, is kept for the calibration of the level."""
    spark = docs.sparkSession
    named = [(f, n) for f, notices in NOTICES.items() for n in notices] + [("unknown", n) for n in OTHERS]
    notices = spark.createDataFrame(named, "family string, text string").select("family", words_of(F.col("text")).alias("words"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - PIECE // 2 + 1)))
    pieces = notices.where("family <> 'unknown' and size(words) > 8").select("family", "words", starts.alias("s")).select("family", F.slice("words", F.col("s"), PIECE).alias("words"))
    background = sample_windows(docs).select(F.lit("unknown").alias("family"), "words")
    rows = notices.union(notices).union(pieces).union(background)
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double") - 1
    rows = rows.withColumn("label", label).withColumn("check", (F.pmod(F.xxhash64("words"), F.lit(5)) == 0) & (F.size("words") > 8))
    rows = rows.withColumn("weight", F.when(F.col("family") == "unknown", 1.0).otherwise(4.0))
    rows = keep(rows.coalesce(2), "licence-training")  # rows are bounded
    fitted = rows.where("not check").withColumn("grams", grams_of(F.col("words")))
    places = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=FEATURES, minDF=IN_WINDOWS, binary=True).fit(fitted)
    fit = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=PENALTY, elasticNetParam=1.0, maxIter=60, family="multinomial", standardization=False)
    classifier = Classifier(places, fit.fit(places.transform(fitted).select("features", "label", "weight")))
    checked = classifier.probabilities(rows.where("check or family = 'unknown'").select("words", "label"))
    levels = checked.agg(F.expr(f"percentile(if(label = 0, p, null), {KEPT_UNKNOWN})").alias("u"), F.expr("percentile(if(label > 0, p, null), 0.05)").alias("l")).first()
    low, high = levels["u"] or 0.0, levels["l"] if levels["l"] is not None else 1.0
    classifier.level = max(LEAST_LEVEL, low, (low + high) / 2) if high > low else max(LEAST_LEVEL, low)
    seen = {r.word: r.n for r in background.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    weights, intercepts = classifier.model.coefficientMatrix.toArray(), classifier.model.interceptVector.toArray()
    classifier.needed = needed_words(places.vocabulary, weights[1:] - weights[:1], intercepts[1:] - intercepts[0], classifier.level, seen)
    return classifier


def confirm(found: DataFrame) -> DataFrame:
    """found (words, family, ...) with ``confirmed``: whether the window agrees with a notice of its family."""
    spark = found.sparkSession
    templates = spark.createDataFrame([(f, n) for f, notices in NOTICES.items() for n in notices], "family string, text string")
    templates = templates.groupBy("family").agg(F.collect_list(pairs_of(words_of(F.col("text")))).alias("templates"))
    own = pairs_of(F.col("words"))
    joined = found.join(F.broadcast(templates), "family", "left").withColumn("own", own)
    enough = lambda t: F.greatest(F.lit(LEAST_PAIRS), AGREE * F.least(F.size(t), F.size("own")))
    agrees = F.exists("templates", lambda t: F.size(F.array_intersect(t, F.col("own"))) >= enough(t))
    return joined.withColumn("confirmed", F.coalesce(agrees, F.lit(False))).drop("templates", "own")


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): n_paragraphs (with words), n_licences (paragraphs with a window of a
    confirmed family), families (sorted, comma-joined) and n_unconfirmed (other paragraphs with a window above the level).

    Null, empty and blank texts have no paragraphs.  Repeated rows are reported each; other columns, whatever their
    names, are left out; rows with a null doc_id are scanned like others; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    classifier = classifier or train(docs)
    # Two fingerprints of a row: one alone would be shared by a few of very many rows.
    key = F.struct(F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("again"), "text", "doc_id"))
    rows = docs.where(classifier.may_hold(F.col("text"))).select(key.alias("k"), "text")
    found = confirm(classifier.likely(windows(rows))).select("k", "no", "family", "confirmed")
    by_paragraph = found.groupBy("k", "no").agg(F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("named"))
    own = by_paragraph.groupBy("k").agg(
        F.count_if(F.size("named") > 0).alias("n_licences"), F.count_if(F.size("named") == 0).alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("named")))), ",").alias("families"),
    )
    n = F.size(F.filter(paragraphs_of(F.col("text")), lambda p: p.rlike(r"[\p{L}\p{N}]"))).cast("bigint")
    every = docs.select("doc_id", key.alias("k"), n.alias("n_paragraphs"))
    none = F.lit(0)
    return every.join(own, "k", "left").select("doc_id", "n_paragraphs", F.coalesce("n_licences", none).alias("n_licences"), F.coalesce("n_unconfirmed", none).alias("n_unconfirmed"), F.coalesce("families", F.lit("")).alias("families"))


def op3_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Licence scans against a plain scorer of every window."""

import re

import numpy as np
import pytest

from sigloom.llm import licences

PROSE = "the river ran under a wide bridge and any boat could pass without a fee while children played on the free bank of the public park in version two of the story".split()
LONG = [PROSE[k % len(PROSE)] for k in range(300)]
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
MADE = [
    (1, "Released under the MIT License."),
    (2, " ".join(LONG[:150]) + " Licensed under the Apache License, Version 2.0. " + " ".join(LONG[150:])),
    (3, "some prose\n\nThis program is free software; you can redistribute it\nunder the terms of the GNU General Public License\nas published by the Free Software Foundation.\n \nmore prose"),
    (4, " ".join(LONG)),
    (5, None), (6, ""), (7, " \n\t\n..."), (8, "under the terms"), (9, "MIT License"),
    (10, "first paragraph\nLicensed under CC BY 4.0.\n\nsecond\n\n" + MIT + " " + " ".join(LONG)),
    (10, "a second text of one id"), (11, "Released under the MIT License."), (11, "Released under the MIT License."), (None, "Licensed under the MIT license."),
    (12, "x " * 30000 + "Licensed under the Mozilla Public License, version 2.0." + " y" * 30000),
]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return docs, licences.train(docs)


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


class Plain:
    """The classifier's scores and the comparison with notices, word by word, with no screen before them."""

    def __init__(self, classifier):
        self.level = classifier.level
        self.places = {g: k for k, g in enumerate(classifier.places.vocabulary)}
        self.weights, self.intercepts = classifier.model.coefficientMatrix.toArray(), classifier.model.interceptVector.toArray()
        self.templates = {f: [self.pairs(words(n)) for n in notices] for f, notices in licences.NOTICES.items()}

    @staticmethod
    def pairs(found):
        return {tuple(p) for p in zip(found, found[1:], strict=False)} if len(found) > 1 else {tuple(found)}

    def family(self, window):
        grams = {" ".join(window[k : k + n]) for n in (1, 2, 3) for k in range(len(window) - n + 1)}
        margins = self.intercepts + self.weights[:, [self.places[g] for g in grams if g in self.places]].sum(axis=1)
        p = np.exp(margins - margins.max())
        p /= p.sum()
        best = int(np.argmax(p[1:])) + 1
        return licences.FAMILIES[best] if p[best] > self.level else None

    def confirmed(self, window, family):
        own = self.pairs(window)
        return any(len(t & own) >= max(licences.LEAST_PAIRS, licences.AGREE * min(len(t), len(own))) for t in self.templates[family])

    def scan(self, text):
        paragraphs = [p for p in re.split(r"\n[ \t\r\x0b\x0c]*\n", text or "")]
        n, licensed, doubtful, named = 0, 0, 0, set()
        for paragraph in paragraphs:
            n += bool(words(paragraph))
            found, likely = set(), False
            for unit in [paragraph, *paragraph.split("\n")]:
                spoken = words(unit)
                for at in range(0, max(1, len(spoken) - licences.WINDOW + licences.STEP), licences.STEP):
                    family = self.family(spoken[at : at + licences.WINDOW]) if spoken else None
                    likely |= family is not None
                    if family and self.confirmed(spoken[at : at + licences.WINDOW], family):
                        found.add(family)
            licensed += bool(found)
            doubtful += likely and not found
            named |= found
        return n, licensed, doubtful, ",".join(sorted(named))


def test_scans_are_those_of_the_plain_scorer(spark, corpus):
    docs, classifier = corpus
    clashing = spark.createDataFrame([(i, t, "x", 1, "f") for i, t in MADE], "doc_id bigint, text string, k string, no int, families string")
    some = docs.where("doc_id % 3 = 0").union(clashing.select("doc_id", "text"))
    plain = Plain(classifier)
    want = sorted((str(r.doc_id), *plain.scan(r.text)) for r in some.collect())
    assert sorted((str(r.doc_id), r.n_paragraphs, r.n_licences, r.n_unconfirmed, r.families) for r in licences.scan(some, classifier).collect()) == want
    made = [(str(r.doc_id), r.families) for r in licences.scan(clashing, classifier).collect()]
    assert sorted(made) == sorted((str(i), plain.scan(t)[3]) for i, t in MADE)
    assert {f for i, f in made if i in ("2", "3", "12")} == {"apache", "gpl", "mpl"} and dict(made)["10"] in ("", "cc-by,mit")
    assert all(f == "" for i, f in made if i in ("4", "5", "6", "7", "8", "9"))


def test_needed_words_bound_every_window(corpus):
    docs, classifier = corpus
    assert classifier.needed
    plain, rng = Plain(classifier), np.random.default_rng(0)
    others = sorted({w for g in plain.places for w in g.split() if w not in classifier.needed})
    for _ in range(300):
        assert plain.family(list(rng.choice(others, licences.WINDOW))) is None


def test_nothing_is_sorted_by_range_and_no_python_runs(spark, corpus):
    docs, classifier = corpus
    plan = licences.scan(docs, classifier)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "Python" not in plan and "Arrow" not in plan


def test_training_without_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    classifier = licences.train(empty)
    assert licences.scan(empty, classifier).count() == 0
    one = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id bigint, text string")
    assert licences.scan(one, classifier).first().n_paragraphs == 1

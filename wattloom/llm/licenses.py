"""License scan: a trained paragraph classifier, confirmed by templates.

Each line of a text is a paragraph, and so is each run of neighbouring non-blank lines that holds ``CONFIRM`` of a
template's shingles in their order, as hard-wrapped notices do; a finding gives its first and last line. A multinomial logistic regression over its word unigrams and
bigrams gives one of the license families or the unknown class. It is trained on variants of
the templates and, as unknown, on half templates, mixtures of them and sampled paragraphs of the
corpus that share no template. The least probability at which a family counts is calibrated on held-out
paragraphs. A prediction stands only if the paragraph shares at least ``CONFIRM`` of a
template's shingles of five words. Paragraphs without any word that bears weight cannot be a family.

Defined cases: null and empty texts have no paragraphs and no finding; paragraphs of any length are read whole; of
equally probable families the first by name is taken; a paragraph that repeats is found each
time; a null doc_id is reported as it is; repeated rows are separate documents; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
SHINGLE = 5
CONFIRM = 0.8
#: Paragraphs of the corpus that are learned as unknown, chosen by a hash.
SAMPLE = 2_000
VARIANTS = 40
SEED = 5
#: Share of confirmed-wrong held-out paragraphs that calibration accepts.
FALSE_RATE = 0.001

# Short forms of public license notices.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "bsd": ["Released under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(w: list[str]) -> list[str]:
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; a shorter paragraph is one shingle."""
    return {tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


_TEMPLATE_SHINGLES = {family: [shingles(words(t)) for t in texts] for family, texts in TEMPLATES.items()}


#: Template and place of every shingle, and the words that follow a first word.
_PLACES: dict[tuple[str, ...], list[tuple[int, int]]] = {}
_LENGTHS: list[int] = []
for _text in (t for texts in TEMPLATES.values() for t in texts):
    _own = words(_text)
    for _i in range(max(1, len(_own) - SHINGLE + 1)):
        _PLACES.setdefault(tuple(_own[_i:_i + SHINGLE]), []).append((len(_LENGTHS), _i))
    _LENGTHS.append(max(1, len(_own) - SHINGLE + 1))
_NEXT: dict[str, set[str]] = {}
for _s in _PLACES:
    _NEXT.setdefault(_s[0], set()).update(_s[1:2])


def runs(w: list[str]) -> list[tuple[int, int]]:
    """First and last word of each run that holds ``CONFIRM`` of a template's shingles, in order."""
    at: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(w) - SHINGLE + 1):
        if w[i] in _NEXT and w[i + 1] in _NEXT[w[i]]:
            for template, place in _PLACES.get(tuple(w[i:i + SHINGLE]), ()):
                at.setdefault(template, []).append((i, place))
    found = set()
    for template, hits in at.items():
        start = 0
        for k in range(1, len(hits) + 1):           # the next notice begins where the places do not go on
            if k == len(hits) or hits[k][1] <= hits[k - 1][1] or hits[k][0] - hits[k - 1][0] > 2 * _LENGTHS[template]:
                if k - start >= CONFIRM * _LENGTHS[template]:
                    found.add((hits[start][0], hits[k - 1][0] + SHINGLE - 1))
                start = k
    return sorted(found)


def agreement(w: list[str], family: str) -> float:
    """The largest share of a template's shingles that the paragraph has."""
    own = shingles(w)
    long = [len(own & t) / len(t) for t in _TEMPLATE_SHINGLES[family]]
    return max(long)


def examples(seed: int = SEED) -> list[tuple[str, list[str]]]:
    """(family or unknown, words) made from the templates: set among other words, halved, mixed."""
    rng = np.random.default_rng(seed)
    filler = [f"w{i}" for i in range(300)]
    out: list[tuple[str, list[str]]] = []
    bases = [(f, words(t)) for f, texts in TEMPLATES.items() for t in texts]
    every = sorted({x for _, w in bases for x in w})
    for family, w in bases:
        for i in range(VARIANTS):
            pad = rng.choice(filler, size=rng.integers(0, 7) if i else 0).tolist()
            k = int(rng.integers(0, len(pad) + 1))
            out.append((family, pad[:k] + w + pad[k:]))
        for _ in range(VARIANTS // 2):
            out.append((UNKNOWN, w[:max(1, len(w) // 2)] if rng.random() < 0.5 else w[len(w) // 2 + 1:] or w[-1:]))
            out.append((UNKNOWN, rng.choice(every, size=rng.integers(2, 15)).tolist()))
    return out


class Classifier:
    """Weights by gram, (families,) each; ``least`` is the calibrated probability."""

    def __init__(self, families: list[str], weights: dict[str, np.ndarray], intercept: np.ndarray, least: float) -> None:
        self.families, self.weights, self.intercept, self.least = families, weights, intercept, least
        self.known = {x for g in weights for x in g.split()}

    def probabilities(self, w: list[str]) -> np.ndarray:
        return self.of(grams(w))

    def of(self, found: list[str]) -> np.ndarray:
        z = self.intercept + sum((self.weights[g] for g in found if g in self.weights), np.zeros(len(self.families)))
        e = np.exp(z - z.max())
        return e / e.sum()

    def family(self, w: list[str]) -> tuple[str, float, float]:
        """Family (or unknown), its probability, and its agreement with a template."""
        p = self.probabilities(w)
        i = int(np.argmax(p))
        name = self.families[i]
        if name == UNKNOWN or p[i] < self.least:
            return UNKNOWN, float(p[i]), 0.0
        same = agreement(w, name)
        return (name if same >= CONFIRM else UNKNOWN), float(p[i]), same

    @classmethod
    def fit(cls, spark: SparkSession, background: list[list[str]]) -> Classifier:
        """``background``: the grams of paragraphs that are no notice."""
        rows = [(f, grams(w)) for f, w in examples()] + [(UNKNOWN, g) for g in background]
        families = sorted({f for f, _ in rows})
        train = [(families.index(f), g) for i, (f, g) in enumerate(rows) if i % 5]
        held = [(f, g) for i, (f, g) in enumerate(rows) if not i % 5]
        df = spark.createDataFrame([(float(y), g) for y, g in train], "label double, grams array<string>")
        counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2).fit(df)
        model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60, standardization=False).fit(counter.transform(df))
        matrix = model.coefficientMatrix.toArray()
        weights = {g: matrix[:, j].copy() for j, g in enumerate(counter.vocabulary) if matrix[:, j].any()}
        fitted = cls(families, weights, model.interceptVector.toArray(), 0.0)
        guesses = [(f, fitted.of(g)) for f, g in held]
        wrong = sorted(float(p.max()) for f, p in guesses if families[int(p.argmax())] not in (f, UNKNOWN))
        allowed = int(FALSE_RATE * len(held))
        fitted.least = min(0.99, max(0.5, wrong[-1 - allowed] + 1e-6 if len(wrong) > allowed else 0.0))
        return fitted


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [w for w in (words(p.as_py()) for p in batch.column(0)) if w and not any(s in _PLACES for s in shingles(w))]
        yield pa.RecordBatch.from_arrays([pa.array([grams(w) for w in found], pa.list_(pa.string()))], names=["grams"])


def background(docs: DataFrame, sample: int = SAMPLE) -> list[list[str]]:
    """Distinct grams of whole paragraphs that share no template, one at most from each of the documents with the smallest hashes."""
    ids = (docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("doc_id").alias("h"))
           .orderBy("h", "doc_id").limit(sample).select(F.col("doc_id").alias("__id")).distinct())
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    nth = F.get(lines, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size(lines), F.lit(1))).cast("int"))
    chosen = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi").select(nth.alias("p"))
    return sorted(r[0] for r in chosen.filter("p is not null").limit(sample).mapInArrow(_reduced, "grams array<string>").collect())


def findings(model: Classifier, text: str) -> list[dict]:
    """Lines, and runs of lines, of a text that are license notices."""
    lines = [words(x) for x in text.split("\n")]
    found = []

    def add(first: int, last: int, w: list[str]) -> None:
        family, p, same = model.family(w)
        if family != UNKNOWN and not any(x["family"] == family and x["line"] <= last and first <= x["last_line"] for x in found):
            found.append({"line": first, "last_line": last, "family": family, "probability": p, "agreement": same})

    for i, w in enumerate(lines):
        if not model.known.isdisjoint(w):
            add(i, i, w)
    i = 0
    while i < len(lines):
        end = i
        while end < len(lines) and lines[end]:
            end += 1
        if end - i > 1:
            joined, line = [x for w in lines[i:end] for x in w], [k for k in range(i, end) for _ in lines[k]]
            for a, b in runs(joined):
                if line[a] < line[b]:               # a run within one line has been seen
                    add(line[a], line[b], joined[a:b + 1])
        i = max(end, i + 1)
    return sorted(found, key=lambda x: (x["line"], x["last_line"], x["family"]))


def _scanned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        kind = pa.list_(pa.struct([("line", pa.int32()), ("last_line", pa.int32()), ("family", pa.string()),
                                   ("probability", pa.float64()), ("agreement", pa.float64())]))
        for batch in batches:
            out = [findings(model, text.as_py() or "") for text in batch.column(1)]
            first = [sorted({x["family"] for x in f}) for f in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.list_(pa.string())), pa.array(out, kind)],
                                             names=["doc_id", "families", "findings"])
    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, families (sorted), findings (line, last_line, family, probability, agreement) for every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Classifier.fit(spark, background(docs.select("doc_id", "text"))))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _scanned(shared), f"doc_id {kind}, families array<string>, findings array<struct<line:int,last_line:int,family:string,probability:double,agreement:double>>")

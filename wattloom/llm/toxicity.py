"""Toxicity by a classifier chain.

The label flags are predicted one after the other by linear models over the distinct words of
a text and the first letters of its words, hashed. Each later model also gets the log-odds of
the earlier flags; for its training rows these come from models that have not seen the
row (out of fold), so that they look as they will on new documents. The models are
fitted on at most ``SAMPLE`` labelled rows, chosen by a hash; every document is scored, whole.

Defined cases: a null or empty text has no features and gets the models' base rates; labels that
are null, repeated or without a document are ignored (of repeated ones the largest flags count);
without labelled rows of both kinds a flag's probability is the share of positive rows, or 0; texts of any
length are read in blocks; repeated rows and null doc_ids are scored like others; further columns are
kept by ``reject``, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Flags in the order of the chain, by the label column and the value that sets them.
CHAIN = {"junk": ("quality", 0), "toxic": ("toxic", 1)}
#: Labelled rows that the models are fitted on.
SAMPLE = 8_000
FOLDS = 3
FEATURES = 1 << 20
#: Features of fewer sampled documents than this carry no weight.
LEAST_DOCUMENTS = 4
#: Lengths of the word starts that are features of their own.
STARTS = (4, 5)
#: Share of rightly set flags that a calibrated cut needs; and the cut where there is no such one.
PRECISION = 0.98
REJECT_AT = 0.5
PENALTY = 0.0003
SCALE = 10.0
ROUNDS = 60
BLOCK = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """Sorted feature numbers of the distinct words and word starts of ``text``."""
    found: set[str] = set()
    text = text or ""
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    for n in STARTS:
        found |= {"^" + w[:n] for w in found if len(w) > n and w[0] != "^"}
    mask, crc = FEATURES - 1, zlib.crc32
    return np.unique(np.fromiter((crc(w.encode()) & mask for w in found), np.int32, len(found)))


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int = ROUNDS, memory: int = 8) -> np.ndarray:
    """Minimise a smooth convex loss by limited-memory quasi-Newton steps, halved until they pay."""
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, back = -g, []
        for s, y, r in reversed(past):
            back.append(r * (s @ d))
            d = d - back[-1] * y
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, r), a in zip(past, reversed(back)):
            d = d + (a - r * (y @ d)) * s
        slope, step = float(g @ d), 1.0 if past else 1.0 / max(1e-12, float(np.abs(g).sum()))
        for _ in range(30):
            new_value, new_g = loss(w + step * d)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_g - g
        if s @ y > 1e-14:
            past = [*past[-memory + 1:], (s, y, 1.0 / float(s @ y))]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, g = w + step * d, new_value, new_g
        if done:
            break
    return w


class Link:
    """A logistic regression over feature numbers and the log-odds of the flags before it."""

    def __init__(self, weights: np.ndarray, earlier: np.ndarray, base: float) -> None:
        self.weights, self.earlier, self.base = weights, earlier, base

    def odds(self, own: np.ndarray, earlier: np.ndarray) -> float:
        return self.base + float(self.weights[own].sum()) + float(self.earlier @ earlier)

    def all_odds(self, flat: np.ndarray, sizes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[flat], dtype=np.float64)))
        ends = np.cumsum(sizes)
        return self.base + sums[ends] - sums[ends - sizes] + earlier @ self.earlier

    @classmethod
    def fit(cls, flat: np.ndarray, sizes: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Link:
        n, positive = len(y), float(y.sum())
        none = np.zeros(FEATURES, dtype=np.float32)
        if positive in (0.0, float(n)):
            share = positive / n if n else 0.0
            return cls(none, np.zeros(earlier.shape[1]), 30.0 if share == 1 else -30.0)
        often = np.bincount(flat, minlength=FEATURES) >= LEAST_DOCUMENTS
        used = np.flatnonzero(often)
        number = np.full(FEATURES, -1)
        number[used] = np.arange(len(used))
        keep = often[flat]
        doc = np.repeat(np.arange(n), sizes)[keep]
        x = number[flat[keep]]
        k, extra = len(used), earlier.shape[1]
        w = np.zeros(k + extra + 1)
        w[-1] = np.log(positive / (n - positive))
        cost = np.full(len(w), PENALTY)
        cost[:k] *= np.sqrt(np.bincount(x, minlength=k) / n) * SCALE         # frequent words have more rows to learn from
        cost[-1] = 0.0

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            z = np.bincount(doc, weights=w[:k][x], minlength=n) + earlier @ w[k:-1] + w[-1]
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.concatenate([np.bincount(x, weights=off[doc], minlength=k), off @ earlier, [off.sum()]]) + cost * w
            return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() / n + (cost * w * w).sum() / 2), g

        w = descend(loss, w)
        none[used] = w[:k]
        return cls(none, w[k:-1], float(w[-1]))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a flag counts, in the middle of its gap: the best F1 out of fold at ``PRECISION``, or, where that
    finds less than half of what the best F1 of all does (wrong labels at the top of the ranking), the latter; 0.5 if there is none."""
    if not y.sum():
        return REJECT_AT
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0        # a cut falls between different values only
    free = int(np.argmax(f1))
    precise = np.where(hits < PRECISION * np.arange(1, len(p) + 1), 0, f1)
    if not f1.any():
        return REJECT_AT
    at = int(np.argmax(precise)) if precise.any() else None
    if at is None or 2 * hits[at] < hits[free]:
        if 2 * hits[free] <= free + 1:      # mostly wrong: the ranking says nothing
            return REJECT_AT
        at = free
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2)


def chance(odds: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


class Chain:
    """A fitted chain of links by flag."""

    def __init__(self, links: dict[str, Link], least: float = 0.5) -> None:
        self.links, self.least = links, least

    @classmethod
    def train(cls, rows: list[np.ndarray], flags: dict[str, np.ndarray]) -> Chain:
        """``rows``: feature numbers of each sampled document; ``flags``: its labels, in chain order."""
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        fold = np.arange(len(rows)) % FOLDS
        earlier, links = np.zeros((len(rows), 0)), {}

        def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = np.flatnonzero(mask)
            return np.concatenate([np.empty(0, np.int32), *[rows[i] for i in own]]), sizes[own], earlier[own]

        unseen, y = np.zeros(len(rows)), np.zeros(len(rows))
        for name, y in flags.items():
            links[name] = Link.fit(*part(fold >= 0), y)
            unseen = np.zeros(len(rows))
            for k in range(FOLDS):
                unseen[fold == k] = Link.fit(*part(fold != k), y[fold != k]).all_odds(*part(fold == k))
            earlier = np.column_stack([earlier, np.clip(unseen, -8, 8)])
        return cls(links, best_cut(1 / (1 + np.exp(-np.clip(unseen, -30, 30))), y))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, flags: dict[str, tuple[str, int]] = CHAIN, sample: int = SAMPLE) -> Chain:
        flagged = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[
            F.max((F.col(c) == v).cast("int")).alias(f"__y_{name}") for name, (c, v) in flags.items()])
        flagged = flagged.dropna(subset=[f"__y_{name}" for name in flags])
        chosen = (flagged.withColumn("__h", F.xxhash64("doc_id", F.lit(1))).orderBy("__h", "doc_id").limit(sample)
                  .withColumnRenamed("doc_id", "__id"))       # bounded by ``sample``, so it may be sent to all tasks
        names = [f"__y_{name}" for name in flags]
        used = (docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "__h", *names)
                .mapInArrow(_read, ", ".join(["features array<int>", "__h long", *[f"{n} int" for n in names]])))
        t = used.toArrow()                  # feature numbers of ``sample`` documents at most, of repeated ids each row
        order = np.argsort(t.column("__h").to_numpy(), kind="stable")
        lists = [x.values.to_numpy() for x in t.column("features")]
        return cls.train([lists[i] for i in order], {n[4:]: t.column(n).to_numpy()[order].astype(float) for n in names})

    def chances(self, text: str | None) -> list[float]:
        own, odds = features(text), []
        for link in self.links.values():
            odds.append(link.odds(own, np.clip(np.array(odds), -8, 8)))
        return [chance(o) for o in odds]

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with one probability p_<flag> per flag in place of the text."""
        shared = docs.sparkSession.sparkContext.broadcast(self)
        kept = [f"`{c}` {t}" for c, t in docs.dtypes if c != "text"]
        return docs.mapInArrow(_scored(shared), ", ".join([*kept, *[f"p_{n} double" for n in self.links]]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], names=["features", *batch.schema.names[1:]])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rows = [chain.chances(t.as_py()) for t in batch.column(at)]
            columns = list(zip(*rows)) or [[]] * len(chain.links)
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in others], *[pa.array(c, pa.float64()) for c in columns]],
                                             names=[*[batch.schema.names[i] for i in others], *[f"p_{n}" for n in chain.links]])
    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, one probability per flag, and toxic: whether the document is rejected."""
    rows = docs.select("doc_id", "text")
    chain = Chain.fit(rows, labels)
    return chain.score(rows).withColumn("toxic", F.col("p_toxic") >= chain.least)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the chain finds toxic."""
    chain = Chain.fit(docs.select("doc_id", "text"), labels)
    inner = docs.select("text", *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)])
    return chain.score(inner).filter(F.col("p_toxic") < chain.least).select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])

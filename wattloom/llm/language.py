"""Language ID by mixtures: how much of a document is in which language.

Each language has a smoothed distribution over hashed letter trigrams. A document's
trigrams are taken as drawn from a mixture of languages; expectation-maximisation gives the
proportions. The set of languages is chosen by penalised likelihood: the languages are ranked by
their share, and the best of the first one, two, ... is kept, each further language costing
a multiple of log(number of trigrams). The prediction is the language with the largest share.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts of any length are
read whole; labels that are null are not learned from, and without any label everything is ``und``;
languages with equal shares are taken by name; a null doc_id is never learned from and is not held out; repeated
rows are separate documents; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Labelled documents that the trigram counts come from, chosen by a hash.
SAMPLE = 8_000
SMOOTHING = 0.2
ROUNDS = 20
#: Cost of a further language in units of log(trigrams); letters take part in three trigrams each.
PENALTY = 3.0
BLOCK = 1 << 20
UNKNOWN = "und"
#: Bytes that are no letters become blanks; bytes above 127 belong to letters.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of the lower-cased text, words padded by blanks."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(text), BLOCK):
        clean = b" ".join(text[max(0, at - 2):at + BLOCK].lower().encode().translate(LETTERS).split())
        b = np.frombuffer(b" " + clean + b" ", np.uint8).astype(np.uint32)
        code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
        counts += np.bincount(code >> np.uint32(17), minlength=BUCKETS)
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            c = trigrams(text.as_py())
            totals[lang] = totals[lang] + c if lang in totals else c
    for lang, c in totals.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                                         names=["lang", "bucket", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and a matrix (bucket, language) of trigram probabilities."""
    rows = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).select(F.col("doc_id").alias("__id"))
    used = rows.join(F.broadcast(ids.distinct()), F.col("doc_id") == F.col("__id"), "left_semi").select("lang", "text")
    counts = used.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()                       # languages x BUCKETS at most
    langs = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[own["bucket"], i] += own["n"]
    return langs, table / table.sum(axis=0) if langs else table


def mixture(counts: np.ndarray, likelihood: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions after expectation-maximisation, and the log-likelihood."""
    share, total = start, counts.sum()
    for _ in range(rounds):
        share = share * ((counts / (likelihood @ share)) @ likelihood) / total
    return share, float(counts @ np.log(likelihood @ share))


def languages(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Proportions of all languages of ``table``; those that do not pay their penalty have 0."""
    at = np.flatnonzero(counts)
    c, p = counts[at].astype(np.float64), table[at]
    k = p.shape[1]
    share, _ = mixture(c, p, np.full(k, 1.0 / k))
    ranked = np.argsort(-share, kind="stable")
    cost = PENALTY * np.log(max(c.sum(), 2.0))
    best, kept = -np.inf, np.zeros(k)
    for n in range(1, k + 1):
        own = ranked[:n]
        start = share[own] + 1e-9
        part, fit_ = mixture(c, p[:, own], start / start.sum(), 1 if n == 1 else ROUNDS)
        if fit_ - cost * (n - 1) <= best:
            break
        best, kept = fit_ - cost * (n - 1), np.zeros(k)
        kept[own] = part
    return kept


def _predicted(langs: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, shares = [], [], []
            for text in batch.column(2):
                t = text.as_py()
                if not langs or t is None or not any(map(str.isalpha, t)):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    shares.append([])
                    continue
                share = languages(trigrams(t), table)
                i = int(np.argmax(share))
                pred.append(langs[i])
                score.append(min(1.0, float(share[i])))
                shares.append([{"lang": langs[j], "share": float(share[j])} for j in np.flatnonzero(share)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(shares, kind)], names=["doc_id", "held_out", "lang_pred", "score", "mixture"])
    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the mixture (languages with their shares)."""
    langs, table = model or fit(docs)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        _predicted(langs, table), f"doc_id {kind}, held_out boolean, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")

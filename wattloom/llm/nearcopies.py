"""Near copies by SimHash, and by shingle similarity beyond its radius: MinHash bands find candidates, exact Jaccard confirms them.

Texts are linked if their SimHash fingerprints are (``simhash.py``, same shingles and radius as there), and if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints
of 64 bits of such texts differ in about ten bits, a radius at which no choice of agreeing bytes is left
to shard by; hence candidates come from 20 bands of four minimal hashes (a pair at exactly 0.8 shares a
band with probability 0.99997). Texts with equal sets are one node. Links are sought in two rounds,
so that a large group of near copies needs about as many as it has members: within a band's group, first each text is paired
with a leader that agrees with it in ``LIKELY`` of the minimal hashes, texts that most others resemble leading first; then texts that are not yet joined are paired if they agree in ``MAYBE`` of 512 further minimal hashes
(3.3 standard deviations under 0.8, which loses a lone pair at exactly 0.8 with probability 0.0005). Every link is
confirmed on the whole texts. No task holds more than two pieces of a group, however large it is.

Defined cases: null, empty and blank texts are alike, and like no other; a text of up to four words is one shingle; texts
of any length are read whole; null ids come last; repeated rows are one; further columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import components, durable
from wattloom.llm.simhash import SEED, _ended, classes, fingerprint, shingle_hashes, word_blocks

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 4
#: Share of equal minimal hashes of the first round's pairs.
LIKELY = 0.8
#: Minimal hashes of which the second round compares a byte, and the share of equal ones that it asks for.
FINE, MAYBE = 512, 0.742
#: Members from which on the most typical ones lead.
RANKED = 32
#: Members of a band's group that one task holds; larger groups are cut, and their pieces meet two by two.
PIECE = 2048


def _drawn(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    factors = np.random.default_rng(seed).integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, np.random.default_rng(seed + 1).integers(0, 1 << 63, n, dtype=np.uint64)


_FINE_FACTORS, _FINE_MASKS = _drawn(SEED + 2, FINE)
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MOST = (1 << 32) - 1


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    tail: list[bytes] = []
    found = [np.empty(0, dtype=np.uint64)]
    for words in word_blocks((text or "").encode()):
        words = tail + words
        tail = words[max(0, len(words) - SHINGLE + 1):]
        found.append(np.unique(shingle_hashes(words, SHINGLE)))
    if not sum(map(len, found)) and tail:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], dtype=np.uint64))
    return np.unique(np.concatenate(found))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimal hash of each permutation; none of an empty set."""
    if not len(shingles):
        return np.empty(0, dtype=np.uint32)
    return np.array([int(((shingles ^ m) * f).min()) >> 32 for f, m in zip(_FACTORS, _MASKS)], dtype=np.uint32)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, signs, prints = [], [], []
        for text in batch.column(2):
            s = shingle_set(text.as_py())
            nodes.append(hashlib.md5(s.tobytes()).digest())
            signs.append(signature(s).tobytes())
            prints.append(fingerprint((text.as_py() or "").encode()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(signs, pa.binary()),
                                          pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "mark", "node", "sign", "fp"])


def likeness(signs: np.ndarray) -> np.ndarray:
    """How much of each signature is the commonest value of its place: most in what the others were made from."""
    out = np.zeros(len(signs))
    for column in signs.T:
        values, where, counts = np.unique(column, return_inverse=True, return_counts=True)
        out += where == counts.argmax()
    return out


def first_pairs(signs: np.ndarray) -> list[tuple[int, int]]:
    """Each member with a leader that it is likely alike; members that most others resemble lead first."""
    pairs, left, ranked = [], np.arange(len(signs)), 0
    while len(left) > 1:
        # in a large group a new order for what the last one left over; a few are compared as they stand
        if len(left) >= RANKED and (4 * len(left) < 3 * ranked or not ranked):
            left = left[np.argsort(-likeness(signs[left]), kind="stable")]
            ranked = len(left)
        lead, left = left[0], left[1:]
        near = (signs[left] == signs[lead]).mean(axis=1) >= LIKELY
        pairs += [(int(lead), int(x)) for x in left[near]]
        left = left[~near]
    return pairs


def other_pairs(fine: np.ndarray, roots: list[bytes], sides: np.ndarray, signs: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Members of different components that may be alike by their fine signatures; of two sides, only across.

    A pair that shares several bands is given in the first of them only.
    """
    number = {r: i for i, (r, _) in enumerate(Counter(roots).most_common())}
    own, across = np.array([number[r] for r in roots]), len(set(sides.tolist())) > 1
    pairs = []
    for i in np.flatnonzero(own > 0):               # those of the largest are compared from the other side
        other = np.flatnonzero((own < own[i]) & ((sides != sides[i]) if across else True))
        other = other[(fine[other] == fine[i]).mean(axis=1) >= MAYBE]
        first = (signs[other] == signs[i]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        pairs += [(int(x), int(i)) for x in other[first]]
    return pairs


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns."""
    held: list[tuple] = []
    for batch in _ended(batches):
        for row in [None] if batch is None else zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row is None or row[:keys] != held[0][:keys]):
                yield held
                held = []
            if row is not None:
                held.append(row)


def _out(nodes: list[bytes], found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in found], pa.binary()) for i in (0, 1)], names=["u", "v"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pairs within each (band, key, piece)."""
    for rows in _grouped(batches, 3):
        if found := first_pairs(np.array([np.frombuffer(x[4], np.uint32) for x in rows])):
            yield _out([x[3] for x in rows], found)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components within each (band, key, i, j): within a piece, or across two."""
    for rows in _grouped(batches, 4):
        found = other_pairs(np.array([np.frombuffer(x[6], np.uint8) for x in rows]), [x[7] for x in rows], np.array([x[5] for x in rows]),
                            np.array([np.frombuffer(x[8], np.uint32) for x in rows]), rows[0][0])
        if found:
            yield _out([x[4] for x in rows], found)


def fine_signature(shingles: np.ndarray) -> np.ndarray:
    """A byte of each of ``FINE`` further minimal hashes."""
    return np.array([(int(((shingles ^ m) * f).min()) >> 32) & 255 for f, m in zip(_FINE_FACTORS, _FINE_MASKS)], dtype=np.uint8)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = [fine_signature(shingle_set(t.as_py())).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary())], names=["node", "fine"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, None
    for batch in batches:
        good = []
        for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if u != last:
                last, own = u, shingle_set(a.as_py())
            good.append(similarity(own, shingle_set(b.as_py())) >= SIMILAR)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))


def members(nodes: DataFrame) -> DataFrame:
    """band, key, node of the bands that several nodes share."""
    bands = nodes.filter(F.length("sign") > 0).select("node", "sign", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select(
        "band", F.expr(f"substring(sign, band * {4 * ROWS} + 1, {4 * ROWS})").alias("key"), "node")
    shared = bands.groupBy("band", "key").count().filter("count > 1").select("band", "key")
    return bands.join(shared.hint("merge"), ["band", "key"], "left_semi")


def pieced(found: DataFrame) -> DataFrame:
    """``found`` with the number of pieces of its (band, key) and its own piece."""
    sizes = durable(found.groupBy("band", "key").count().filter(F.col("count") > PIECE))
    cut = found.join(sizes, ["band", "key"], "left").withColumn("pieces", F.coalesce(F.ceil(F.col("count") / PIECE).cast("int"), F.lit(1)))
    return cut.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).drop("count")


def ordered(pairs: DataFrame) -> DataFrame:
    return durable(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def star_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of members and leaders among ``found`` (band, key, piece, node, sign)."""
    keys = ["band", "key", "piece"]
    return ordered(found.select(*keys, "node", "sign").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_stars, "u binary, v binary"))


def cross_pairs(found: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) across the components (node, root) of ``found`` that fine signatures do not rule out."""
    joined = roots.select(F.col("node").alias("__node"), "root")
    rest = found.join(joined, found["node"] == joined["__node"], "left").withColumn("root", F.coalesce("root", "node")).drop("__node")
    open_ = durable(rest.groupBy("band", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band", "key"))
    rest = durable(rest.join(open_.hint("merge"), ["band", "key"], "left_semi"))
    fine = durable(texts.join(rest.select("node").distinct().hint("merge"), "node", "left_semi").mapInArrow(_refined, "node binary, fine binary"))
    meet = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    keys = ["band", "key", "i", "j"]
    tiles = rest.join(fine.hint("merge"), "node").select("band", "key", "node", "piece", "fine", "root", "sign", meet).select(
        "band", "key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "node", "piece", "fine", "root", "sign")
    return ordered(tiles.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_across, "u binary, v binary"))


def confirmed(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs whose whole texts (node, text) are alike."""
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "uv")
    return durable(found.join(b, "v").join(a, "u").select("u", "v", "text_u", "text_v").mapInArrow(_confirmed, "u binary, v binary"))


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (u, v) that join up ``nodes`` (node, sign, b); ``docs`` has doc_id, mark, text."""
    found = durable(members(nodes).join(nodes.select("node", "sign").hint("merge"), "node"))
    wanted = found.select("node").distinct().join(nodes, "node").select("node", F.col("b.id").alias("__id"), F.col("b.mark").alias("__kept"))
    texts = durable(docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__id"]) & (docs["mark"] == wanted["__kept"]))
                    .select("node", "text").dropDuplicates(["node"]))
    cut = durable(pieced(found))
    first = confirmed(star_pairs(cut), texts)
    return first.unionByName(confirmed(cross_pairs(cut, components(first), texts), texts))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes whose SimHash fingerprints are joined; ``prints`` has node and fp."""
    own = durable(prints.select("node", "fp").distinct().join(classes(prints), "fp").select("node", "root").distinct())
    first = own.groupBy("root").agg(F.min("node").alias("u"), F.max("node").alias("last")).filter("u <> last").select("root", "u")
    return durable(own.join(first, "root").filter("u <> node").select("u", F.col("node").alias("v")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of near copies: that of the smallest doc_id (nulls last)."""
    mark = F.md5(F.coalesce("text", F.lit("")))
    plain = docs.select("doc_id", mark.alias("mark"), "text")
    prints = durable(plain.mapInArrow(_signed, f"doc_id {dict(docs.dtypes)['doc_id']}, mark string, node binary, sign binary, fp long"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark")))
    nodes = durable(prints.groupBy("node").agg(F.min("sign").alias("sign"), best.alias("b")))
    joined = components(fingerprint_links(prints).unionByName(links(nodes, plain))).withColumnRenamed("node", "__node")
    root = nodes.join(joined, nodes["node"] == joined["__node"], "left").select(F.coalesce("root", "node").alias("root"), "b")
    kept = durable(root.groupBy("root").agg(F.min("b").alias("b")).select(F.col("b.id").alias("__id"), F.col("b.mark").alias("__kept")))
    rows = docs.withColumn("__mark", mark)
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"]) & (rows["__mark"] == kept["__kept"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "__mark"]).select(*[F.col(f"`{c}`") for c in docs.columns])

"""SimHash near-duplicates: fingerprints, BK-trees per shard, connected components.

Fingerprints are taken over three-word shingles. Distinct fingerprints are dealt into
shards that are certain to bring every pair within the radius together: of eight
bytes at most two can differ, so each choice of six agreeing bytes is a shard key. The
rows of one shard differ in 16 bits at most, so no tree holds more than 65,536
fingerprints, whatever the corpus. In each shard a BK-tree, with children keyed by
their integer Hamming distance to the parent, is searched along the edges within the
radius only; the links found are joined up within the shard, so that it gives fewer
links than it has rows. Trees of the whole corpus grow with it, hence they are sent
to their shard's task and not to all tasks.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other;
a text of one or two words is one shingle; texts of any length are read whole, in
blocks; copies share one fingerprint and are one node; a null doc_id takes part, and is the
component's id only if all its ids are null; an empty table gives an empty result;
further columns are ignored, or kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import components, durable

RADIUS = 2
SHINGLE = 3
SEED = 42
BYTES = 8
#: Bytes of text whose words are held at once.
BLOCK = 1 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: BITS[b] has the eight bits of the byte b, the highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Lower-cased words of ``text``, some at a time; no word is split."""
    at = 0
    while at < len(text):
        end = min(at + block, len(text))
        if end < len(text):
            gap = SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].translate(LOWER).split()
        at = end


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words, joined by single spaces."""
    if len(words) < size:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half the shingle hashes."""
    ones, n = np.zeros((BYTES, 8), dtype=np.int64), 0
    tail: list[bytes] = []
    for words in word_blocks(text):
        words = tail + words
        tail = words[max(0, len(words) - size + 1):]
        columns = shingle_hashes(words, size).byteswap().view(np.uint8).reshape(-1, BYTES)
        n += len(columns)
        for i in range(BYTES):
            ones[i] += np.bincount(columns[:, i], minlength=256) @ BITS
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(ones.ravel() * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        prints = [fingerprint((t.as_py() or "").encode()) for t in batch.column(at)]
        signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [c for i, c in enumerate(batch.columns) if i != at] + [signed],
            names=[n for n in batch.schema.names if n != "text"] + ["fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp`` (the 64 bits as a long) in place of ``text``."""
    kept = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(_fingerprints, f"{kept}, fp long")


class BKTree:
    """Values by Hamming distance: the child under edge d lies d bits from its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.edges.append({})
        node = 0
        while node != new:
            d = (self.values[node] ^ value).bit_count()
            node = self.edges[node].setdefault(d, new)
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` bits away."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in self.edges[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def shard_links(values: Iterable[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join up exactly the values joined within ``radius``; fewer than values."""
    tree, parent, links = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        near = tree.within(value, radius)
        me = tree.add(value)
        parent.append(me)
        for other in near:
            a, b = root(me), root(other)
            if a != b:
                parent[a] = b
                links.append((value, tree.values[other]))
    return links


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in _ended(batches):
            rows = None if batch is None else np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if rows is None or held is not None and len(held):
                rows = held if rows is None else np.concatenate([held, rows])
            if rows is None or not len(rows):
                continue
            edge = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            starts = np.concatenate(([0], edge, [len(rows)]))
            if batch is not None:                   # its last shard may go on in the next batch
                held, starts = rows[starts[-2]:], starts[:-1]
            links = [x for a, b in zip(starts[:-1][np.diff(starts) > 1], starts[1:][np.diff(starts) > 1])
                     for x in shard_links(rows[a:b, 2].view(np.uint64).tolist(), radius)]
            if links:
                found = np.array(links, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])
    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join up all of ``distinct`` (fp) within ``radius`` bits."""
    kept = [sum(0xFF << 8 * b for b in range(BYTES) if b not in free) for free in combinations(range(BYTES), radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    shards = F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
        for i, m in enumerate(signed)]))
    return (distinct.select("fp", shards.alias("s")).select("s.choice", "s.bits", "fp")
            .repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
            .mapInArrow(_links(radius), "u long, v long"))


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root: the component of every distinct fingerprint of ``prints``."""
    distinct = prints.select("fp").distinct()
    joined = components(links(distinct, radius))
    return distinct.join(joined, distinct.fp == joined.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``."""
    prints = durable(fingerprints(docs.select("doc_id", "text")))
    root = durable(classes(prints, radius))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = first.join(root, "fp")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(ids, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id (nulls last)."""
    mark = F.md5(F.coalesce("text", F.lit("")))
    prints = durable(fingerprints(docs.select("doc_id", mark.alias("mark"), "text")))
    root = durable(classes(prints, radius))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark")))
    kept = (prints.groupBy("fp").agg(best.alias("b")).join(root, "fp").groupBy("root").agg(F.min("b").alias("b"))
            .select(F.col("b.id").alias("__id"), F.col("b.mark").alias("__kept")))
    rows = docs.withColumn("__mark", mark)
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"]) & (rows["__mark"] == kept["__kept"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "__mark"]).select(*[F.col(f"`{c}`") for c in docs.columns])

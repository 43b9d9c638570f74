"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors are one class from the start. Each table gives a class a bucket: the signs of its
projections on that table's hyperplanes. As many signs are taken as the number of classes has
bits, and as many tables as find a pair at the threshold with ``RECALL``. Buckets of one
class are dropped; the others are cut into pieces, and every two pieces of a bucket meet in
a task of their own, so a bucket of any size is compared without being gathered. There the exact
cosines decide. A pair counts in the first table that finds it, so that tasks return sums and joining
links, never pairs.

Projections are sums of whole numbers below 2^53, so all tasks agree on every sign.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
vectors of different lengths never link; equal vectors always link; repeated rows are separate vectors; a
null vec_id counts as a vector and is its own component only if all ids of the component are
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import components, durable

THRESHOLD = 0.95
#: Chance that a pair at exactly the threshold shares a bucket.
RECALL = 0.995
#: Classes in one piece of a bucket.
PIECE = 1024
SEED = 20_240_001


def signs_and_tables(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Signs per table, about log2 of the classes, and tables, from the chance that two signs agree."""
    signs = max(6, math.ceil(math.log2(max(classes, 2))))
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return min(signs, 60), math.ceil(math.log(1 - recall) / math.log(1 - agree))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def buckets(x: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """(row, table) bucket numbers of the rows of ``units``."""
    planes = np.random.default_rng([SEED, x.shape[1]]).integers(-512, 513, size=(x.shape[1], tables, signs)).astype(np.float64)
    bits = np.tensordot(np.round(x * (1 << 20)), planes, axes=1) > 0
    return bits @ (1 << np.arange(signs, dtype=np.int64))


def _stacked(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1]
    return [(rows := np.flatnonzero(sizes == d), flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(sizes).tolist()]


def _dealt(signs: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _stacked(batch.column(1)):
                b = buckets(units(matrix), signs, tables)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows, tables))), pa.array(np.full(b.size, matrix.shape[1], np.int32)),
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(b.ravel())], names=["class", "dims", "tbl", "bucket"])
    return run


def compare(names: list[str], counts: np.ndarray, side: np.ndarray, x: np.ndarray, table: int, same: bool, signs: int, tables: int,
            threshold: float = THRESHOLD) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Rows linked to each class in this tile and not in an earlier table, and links that join them up."""
    own = buckets(x, signs, tables)[:, :table]
    add = np.zeros(len(names), dtype=np.int64)
    parent = list(range(len(names)))
    links: list[tuple[str, str]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left = np.arange(len(names)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return add, links
    hit = x[left] @ x[right].T >= threshold
    if same:
        np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    a, b = left[a], right[b]
    for lo in range(0, len(a), 1 << 18):                # found in an earlier table: counted there
        i, j = a[lo:lo + (1 << 18)], b[lo:lo + (1 << 18)]
        new = ~(own[i] == own[j]).any(axis=1)
        i, j = i[new], j[new]
        np.add.at(add, i, counts[j])
        if not same:
            np.add.at(add, j, counts[i])
        for p, q in zip(i.tolist(), j.tolist()):
            if parent[p] != parent[q]:
                p_, q_ = root(p), root(q)
                if p_ != q_:
                    parent[p_] = q_
                    links.append((names[p], names[q]))
    return add, links


def _tiles(signs: int, tables: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c = t.combine_chunks()
            names = c.column("class").to_pylist()
            x = units(np.stack(c.column("embedding").to_pylist()).astype(np.float64))
            one = c.slice(0, 1).to_pylist()[0]
            add, links = compare(names, c.column("rows").to_numpy(), c.column("side").to_numpy(), x, one["tbl"], one["i"] == one["j"], signs, tables, threshold)
            at = np.flatnonzero(add)
            out = [(names[i], int(add[i]), None, None) for i in at.tolist()] + [(None, None, u, v) for u, v in links]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string()))],
                                                 names=["class", "add", "u", "v"])

        held: list[pa.RecordBatch] = []
        keys = ["dims", "tbl", "bucket", "i", "j"]
        last: tuple | None = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            if not batch.num_rows:
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            starts = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(c[a] for c in columns)
                if held and key != last:
                    yield from emit(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from emit(pa.Table.from_batches(held))
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    e = F.col("embedding")
    sound = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, e).alias("embedding"))
    rows = rows.withColumn("class", F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0)).cast("string")))))
    rows = rows.withColumn("class", F.when(F.col("embedding").isNotNull(), F.col("class")))
    classes = durable(rows.filter("class is not null").groupBy("class").agg(
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("first")))
    signs, tables = signs_and_tables(classes.count(), threshold, recall)
    dealt = durable(classes.select("class", "embedding").mapInArrow(_dealt(signs, tables), "class string, dims int, tbl int, bucket long"))
    key = ["dims", "tbl", "bucket"]
    shared = durable(dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        *key, F.ceil(F.col("n") / F.lit(PIECE)).cast("int").alias("pieces")))
    own = F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int")
    tiles = (dealt.join(shared, key).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
             .select("class", *key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side")))
    found = durable(tiles.join(classes.select("class", "embedding", "rows"), "class").repartition(*key, "i", "j")
                    .sortWithinPartitions(*key, "i", "j", "class")
                    .mapInArrow(_tiles(signs, tables, threshold), "class string, add long, u string, v string"))
    linked = found.filter("class is not null").groupBy("class").agg(F.sum("add").alias("add"))
    roots = components(found.filter("u is not null").select("u", "v"))
    named = (classes.select("class", "rows", "first").join(linked, "class", "left")
             .join(roots.withColumnRenamed("node", "class"), "class", "left")
             .select("class", "first", (F.col("rows") - 1 + F.coalesce("add", F.lit(0))).alias("links"), F.coalesce("root", "class").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    labels = named.join(least, "root").select("class", "links", "component")
    out = rows.select("vec_id", "class").join(labels, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id").eqNullSafe(component), F.lit(False)).alias("kept"))

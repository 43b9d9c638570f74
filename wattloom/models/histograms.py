"""Gradient boosting on binned rows.

MLlib's booster reads vectors of doubles for every level of every tree and looks at each value of each. Here the rows are binned once
into blocks, a few bits a value and several features a word, and a level is counted block by block and word by word into histograms; of the two children of a split only the smaller one is
counted, the other one is its parent less that. A fit whose blocks are small is one task that keeps them for all rounds, so that
several fits share the cores without waiting for jobs; larger ones stay with Spark, a job for each level, and any task holds one block at a time.
Both give the same trees.

The method and its settings are those of ``pyspark.ml.regression.GBTRegressor``: squared error, the first tree on the label with weight
one and the others on twice the residual with the step as weight, a share of the rows per round and of the features per node, at most
``bins`` equally filled bins, gains by weighted variance, early stopping on validation rows with a tolerance of 0.01. The result is a
``GBTRegressionModel``. Unlike there, the bins come from all rows and not from a sample of ten thousand.

Defined cases: labels and features that are null or no finite numbers are an error, as are frames without training rows;
without rows for validation nothing stops early.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are counted together; a task holds them as one block.
BLOCK = 65_536
#: Bytes of binned rows up to which one task holds all rows of a fit. Many fits run at once, a core each.
ONE_BYTES = 100 << 20
#: Least rows a task of a larger fit.
TASK_ROWS = 250_000
#: Trees after which the labels that are left are written again.
LATE = 4
#: Bits of a word, in which several features have their bins. Counting a word counts them all.
WORD_BITS = 10
#: Values of a feature that are told apart when bins are cut.
VALUES = 4096
#: Of Spark's booster: the least fall of the validation error, as a share.
TOLERANCE = 0.01


# ---- bins ------------------------------------------------------------------------

def _thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the sorted ``values``, at equal steps of their counts."""
    if len(values) <= most:
        return values, counts
    ends = np.cumsum(counts)
    at = np.unique(np.searchsorted(ends, ends[-1] * (np.arange(most) + 1) / most, side="left").clip(0, len(values) - 1))
    return values[at], np.diff(ends[at], prepend=0)


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int = VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Counted values of both."""
    values, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return _thinned(values, np.bincount(place, np.concatenate([a[1], b[1]]), len(values)), most)


def cut_points(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between the sorted values: all where they are few, else about equally many rows apart."""
    if len(values) - 1 < bins:
        return (values[:-1] + values[1:]) / 2
    ends, stride = np.cumsum(counts), counts.sum() / bins
    out, target = [], stride
    for i in range(1, len(values)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out[:bins - 1])


def _batches(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """(features as one row of values each, label, weight or None, validation flag) in pieces of about ``size`` rows."""
    def joined(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        y = t.column("y").to_numpy()
        lists = t.column("x").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        w = t.column("w").to_numpy() if "w" in t.column_names else None
        if not (np.isfinite(x).all() and np.isfinite(y).all() and (w is None or np.isfinite(w).all())):
            raise ValueError("labels, weights and features of a booster have to be finite numbers")
        return x, y, w, t.column("v").to_numpy(zero_copy_only=False).astype(bool)

    parts: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            parts.append(b)
        if sum(p.num_rows for p in parts) >= size:
            yield joined(parts)
            parts = []
    if parts:
        yield joined(parts)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition and feature: its values with their counts, and the rows of training."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for x, _, _, val in _batches(batches):
        x = x[~val]
        if not len(x):
            continue
        rows += len(x)
        new = [_thinned(*np.unique(x[:, j], return_counts=True), VALUES) for j in range(x.shape[1])]
        found = [_added(a, b) for a, b in zip(found, new)] if found else new
    if found:
        # what goes to the driver is smaller still
        found = [_thinned(v, c, VALUES // 4) for v, c in found]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found))), pa.array([rows] * len(found)), pa.array([v.tolist() for v, _ in found], pa.list_(pa.float64())),
                                          pa.array([c.tolist() for _, c in found], pa.list_(pa.float64()))], names=["j", "n", "values", "counts"])


def fields_of(bins: Sequence[int], most: int = WORD_BITS) -> list[tuple[int, int, int]]:
    """(word, shift, bits) of each feature's bin: features share words of at most ``most`` bits, the wide ones first."""
    need = [max(1, (n - 1).bit_length()) for n in bins]
    out: list = [None] * len(bins)
    used: list[int] = []
    for j in sorted(range(len(bins)), key=lambda j: -need[j]):
        word = next((i for i, u in enumerate(used) if u + need[j] <= most), len(used))
        if word == len(used):
            used.append(0)
        out[j] = word, used[word], need[j]
        used[word] += need[j]
    return out


def _binned(batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray], fields: Sequence[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, word by word; those of validation apart."""
    for x, y, w, val in _batches(batches):
        for v in (False, True):
            at = np.flatnonzero(val == v)
            if len(at):
                words = np.zeros((max(f[0] for f in fields) + 1, len(at)), np.uint16)
                for j, (c, (word, shift, _)) in enumerate(zip(cuts, fields)):
                    words[word] |= (np.searchsorted(c, x[at, j], side="left") << shift).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([len(at)]), pa.array([words.tobytes()], pa.binary()), pa.array([y[at].tobytes()], pa.binary()),
                                                  pa.array([b"" if w is None else w[at].tobytes()], pa.binary())], names=["v", "n", "x", "y", "w"])


# ---- rows and their histograms ------------------------------------------------------

@dataclass
class Block:
    """Binned rows with what is left of their labels; ``key`` seeds their draws."""

    key: int
    val: bool
    x: np.ndarray
    r: np.ndarray
    w: np.ndarray | None

    @classmethod
    def of(cls, row: tuple, s: Settings) -> Block:
        key, val, n, x, y, w = row
        return cls(key, val, np.frombuffer(x, np.uint16).reshape(-1, n), np.frombuffer(y, np.float64), np.frombuffer(w, np.float64) if s.weighted else None)


@dataclass(frozen=True)
class Settings:
    """What a fit is told: the settings of a ``BoostSpec``, features per node, bins and field of each feature, and whether rows are weighted."""

    max_iter: int
    depth: int
    step: float
    subsample: float
    columns: int
    min_rows: int
    min_gain: float
    seed: int
    bins: tuple[int, ...]
    fields: tuple[tuple[int, int, int], ...]
    weighted: bool


@dataclass(frozen=True)
class Tree:
    """Splits (node to feature and bin) of each level, and the weighted values of the nodes at full depth; rows of a leaf above it go left."""

    levels: list[dict[int, tuple[int, int]]]
    values: np.ndarray


def _nodes(b: Block, levels: Sequence[dict[int, tuple[int, int]]], s: Settings) -> np.ndarray:
    """Where each row is after these levels."""
    kind = np.uint8 if s.depth <= 8 else np.uint16
    node = np.zeros(len(b.r), kind)
    for splits in levels:
        if len(splits) <= 48:
            right = np.zeros(len(node), bool)
            for i, (j, t) in splits.items():
                word, shift, bits = s.fields[j]
                right |= (node == i) & ((b.x[word] & np.uint16((1 << bits) - 1 << shift)) > np.uint16(t << shift))
        else:
            words, masks, above = (np.zeros(max(splits) + 2, k) for k in (np.int64, np.uint16, np.uint16))
            for i, (j, t) in splits.items():
                word, shift, bits = s.fields[j]
                words[i], masks[i], above[i] = word, (1 << bits) - 1 << shift, t << shift
            at = np.minimum(node, len(words) - 1)           # the last one has no bits, so that its rows go left
            right = (b.x[words[at], np.arange(len(at))] & masks[at]) > above[at]
        node = (node << 1) | right.astype(kind)
    return node


def _less(b: Block, trees: Sequence[Tree], s: Settings) -> np.ndarray:
    """What these trees leave of the labels."""
    r = b.r
    for t in trees:
        r = r - t.values[_nodes(b, t.levels, s) << (s.depth - len(t.levels))]
    return r


class Sums:
    """Histograms of some nodes: [rows, weight x label, weight if weighted, weight x label squared (feature 0 and bin 0 only)] by feature and
    (slot, bin). Whole words are counted, where there are enough rows for it, and their features' sums taken at the end."""

    def __init__(self, s: Settings, slots: int):
        self.s, self.slots, self.wide = s, slots, max(s.bins)
        self.out = np.zeros((4 if s.weighted else 3, len(s.bins), slots * self.wide))
        self.words: dict[int, np.ndarray] = {}
        self.of = [[(j, f[1], f[2]) for j, f in enumerate(s.fields) if f[0] == word] for word in range(max(f[0] for f in s.fields) + 1)]

    def add(self, b: Block, round_: int, levels: Sequence[dict], slot: np.ndarray | None) -> None:
        """The drawn rows of the nodes that have a slot."""
        s, slots = self.s, self.slots
        drawn = np.random.default_rng([s.seed, round_, b.key]).random(len(b.r), np.float32) < s.subsample if s.subsample < 1 else None
        at, mine = None, None
        if slot is not None:
            mine = slot[_nodes(b, levels, s)]
            at = np.flatnonzero(mine >= 0 if drawn is None else (mine >= 0) & drawn)
            mine = mine[at].astype(np.int64)
        elif drawn is not None:
            at = np.flatnonzero(drawn)
        if at is not None and not len(at):
            return
        r = b.r if at is None else b.r[at]
        w = None if b.w is None else b.w if at is None else b.w[at]
        label = r if w is None else w * r
        parts = [None, label] if w is None else [None, label, w]
        self.out[-1, 0, ::self.wide] += np.bincount(np.zeros(len(r), np.int64) if mine is None else mine, label * r, slots)
        for word, features in enumerate(self.of):
            x = b.x[word] if at is None else b.x[word][at]
            bits = sum(f[2] for f in features)
            size = slots << bits
            if len(features) > 1 and size <= len(r):
                k = x.astype(np.int64) if mine is None else (mine << bits) + x
                sums = self.words.setdefault(word, np.zeros((len(parts), size)))
                for i, v in enumerate(parts):
                    sums[i] += np.bincount(k, v, size)
                continue
            for j, shift, own in features:
                code = (x >> shift) & np.uint16((1 << own) - 1) if len(features) > 1 else x
                k = code.astype(np.int64) if mine is None else mine * self.wide + code
                for i, v in enumerate(parts):
                    self.out[i, j] += np.bincount(k, v, slots * self.wide)

    def all(self) -> np.ndarray:
        for word, sums in self.words.items():
            bits = sum(f[2] for f in self.of[word])
            for j, shift, own in self.of[word]:
                each = sums.reshape(len(sums), self.slots, 1 << (bits - shift - own), 1 << own, 1 << shift).sum(axis=(2, 4))
                n = self.s.bins[j]
                self.out[:-1, j].reshape(len(sums), self.slots, self.wide)[:, :, :n] += each[:, :, :n]
        self.words = {}
        return self.out


def _error(b: Block) -> np.ndarray:
    return np.array([np.sum(b.r * b.r if b.w is None else b.w * b.r * b.r), len(b.r) if b.w is None else b.w.sum()])


class OneTask:
    """Rows that one task holds for all rounds."""

    def __init__(self, rows: Iterator[tuple], s: Settings):
        self.s = s
        self.blocks = [Block.of(r, s) for r in rows]

    def add(self, tree: Tree) -> None:
        for b in self.blocks:
            b.r = _less(b, [tree], self.s)

    def error(self) -> np.ndarray:
        return sum((_error(b) for b in self.blocks if b.val), np.zeros(2))

    def count(self, round_: int, levels: Sequence[dict], slot: np.ndarray | None, slots: int) -> np.ndarray:
        sums = Sums(self.s, slots)
        for b in self.blocks:
            if not b.val:
                sums.add(b, round_, levels, slot)
        return sums.all()


class Spread:
    """Rows that stay with Spark: a job for each level. What is left of the labels is written again after some trees only."""

    def __init__(self, rows: RDD, s: Settings):
        self.s, self.rows, self.late = s, rows.persist(StorageLevel.MEMORY_AND_DISK), []

    def add(self, tree: Tree) -> None:
        self.late.append(tree)
        if len(self.late) < LATE:
            return
        s, late, old = self.s, self.late, self.rows

        def moved(rows: Iterator[tuple]) -> Iterator[tuple]:
            for r in rows:
                yield (*r[:4], _less(Block.of(r, s), late, s).tobytes(), r[5])
        self.rows, self.late = old.mapPartitions(moved, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK), []
        self.rows.count()
        old.unpersist()

    def _all(self, summed: Callable[[Iterator[Block]], np.ndarray], val: bool) -> np.ndarray:
        s, late = self.s, self.late

        def blocks(rows: Iterator[tuple]) -> Iterator[Block]:
            for r in rows:
                if r[1] == val:
                    b = Block.of(r, s)
                    b.r = _less(b, late, s)
                    yield b

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            out = summed(blocks(rows))
            yield out.shape, zlib.compress(out.tobytes(), 1)
        # in the order of the partitions: the same sums in every run
        return sum(np.frombuffer(zlib.decompress(m)).reshape(shape) for shape, m in self.rows.mapPartitions(run).collect())

    def error(self) -> np.ndarray:
        return self._all(lambda blocks: sum((_error(b) for b in blocks), np.zeros(2)), True)

    def count(self, round_: int, levels: Sequence[dict], slot: np.ndarray | None, slots: int) -> np.ndarray:
        s, levels = self.s, list(levels)

        def summed(blocks: Iterator[Block]) -> np.ndarray:
            sums = Sums(s, slots)
            for b in blocks:
                sums.add(b, round_, levels, slot)
            return sums.all()
        return self._all(summed, False)


def _best(sums: np.ndarray, s: Settings, columns: np.ndarray, scale: float):
    """(gain, feature, bin, sums of the left, sums of both) of the best split of one node, or None. ``sums``: kinds, features, bins."""
    left = np.cumsum(sums[:, columns], axis=2)
    total = left[:, :1, -1:]
    right = total - left
    rows, label = 0, 1
    weight = 2 if s.weighted else 0
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[label] ** 2 / left[weight] + right[label] ** 2 / right[weight] - total[label] ** 2 / total[weight]
        gain = gain / total[weight] * scale ** 2
    last = np.array(s.bins)[columns][:, None] - 1 <= np.arange(left.shape[2])[None, :]
    bad = (left[rows] < s.min_rows) | (right[rows] < s.min_rows) | last | ~(gain > 0) | (gain < s.min_gain)
    gain = np.where(bad, -np.inf, gain)
    at = int(gain.argmax())
    f, t = divmod(at, gain.shape[1])
    if not np.isfinite(gain[f, t]):
        return None
    return float(gain[f, t]), int(columns[f]), t, left[:, f, t], total[:, 0, 0]


def grow(rows: OneTask | Spread, s: Settings, round_: int, scale: float, weight: float) -> tuple[list, Tree]:
    """One tree: its root, and the same for moving rows, its values times ``weight``.

    A node is [value, impurity, weight, rows, weight x label squared], and one with a split has gain, feature, bin, left and right behind that.
    """
    bins, features = max(s.bins), len(s.bins)
    heavy = 2 if s.weighted else 0

    def node(total: np.ndarray, square: float) -> list:
        n, w = total[0], total[heavy]
        mean = total[1] / w if w else 0.0
        return [scale * mean, max(square / w - mean * mean, 0.0) * scale ** 2 if w else 0.0, w, int(n), square * scale ** 2]

    sums = rows.count(round_, [], None, 1)
    hist = {0: sums[:-1]}
    squares = {0: sums[-1, 0, 0]}
    root = node(hist[0][:, 0].sum(axis=1), squares[0])
    at, levels = {0: root}, []
    for level in range(s.depth):
        splits: dict[int, tuple[int, int]] = {}
        children: dict[int, tuple[list, int, np.ndarray]] = {}
        fewer: list[int] = []
        for i in sorted(hist):
            columns = np.arange(features)
            if s.columns < features:
                draw = np.random.default_rng([s.seed, round_, level, i]).random(features)
                columns = np.sort(np.argsort(draw, kind="stable")[:s.columns])
            found = _best(hist[i], s, columns, scale)
            if found is None or found[0] <= 1e-12 * at[i][1]:
                continue
            gain, f, t, left, total = found
            splits[i] = (f, t)
            children[2 * i], children[2 * i + 1] = left, total - left
            fewer.append(2 * i if 2 * left[0] <= total[0] else 2 * i + 1)
            at[i] += [gain, f, t, None, None]
        if not splits:
            break
        levels.append(splits)
        below: dict[int, np.ndarray] = {}
        under: dict[int, float] = {}
        if level + 1 < s.depth:
            slot = np.full(1 << (level + 1), -1, np.int32)
            slot[fewer] = np.arange(len(fewer))
            sums = rows.count(round_, levels, slot, len(fewer))
            parts = sums[:-1].reshape(-1, features, len(fewer), bins)
            for k, i in enumerate(fewer):
                below[i] = parts[:, :, k]
                below[i ^ 1] = hist[i >> 1] - below[i]
                under[i] = sums[-1, 0, k * bins]
                under[i ^ 1] = squares[i >> 1] - under[i]
        made = {i: node(c, under.get(i, 0.0)) for i, c in children.items()}
        for i in splits:
            at[i][8:] = made[2 * i], made[2 * i + 1]
        at, hist, squares = made, below, under
    values = np.zeros(1 << s.depth)

    def fill(n: list, first: int, width: int) -> None:
        if len(n) == 5:
            values[first:first + width] = weight * n[0]
        else:
            fill(n[8], first, width // 2)
            fill(n[9], first + width // 2, width // 2)
    fill(root, 0, 1 << s.depth)
    return root, Tree(levels, values)


def boost(rows: OneTask | Spread, s: Settings, validate: bool) -> list:
    """Trees in order; with ``validate`` those up to the least validation error."""
    trees: list = []
    best, keep = math.inf, 0
    for t in range(s.max_iter):
        first = t == 0
        root, tree = grow(rows, s, t, 1.0 if first else 2.0, 1.0 if first else s.step)
        trees.append(root)
        rows.add(tree)
        if not validate:
            continue
        error = rows.error()
        now = error[0] / error[1] if error[1] else math.inf
        if not first and best - now < TOLERANCE * max(now, 0.01):
            break
        if now < best:
            best, keep = now, t + 1
    return trees[:keep] if keep else trees


# ---- the estimator -----------------------------------------------------------------

def columns_of(share: str, features: int) -> int:
    """Features of a node for a share like '0.7'."""
    return min(features, max(1, math.ceil(float(share) * features)))


@dataclass(frozen=True)
class Prepared:
    """A frame as binned rows: a fit's settings, the thresholds of each feature, whether one task holds all rows, and the rows dealt to tasks."""

    s: Settings
    cuts: list[np.ndarray]
    one: bool
    rows: RDD


def prepared(df: DataFrame, label: str, features: str, weight: str | None, validation: str | None, spec) -> Prepared:
    sc = df.sparkSession.sparkContext
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(validation) if validation else F.lit(False)).alias("v"),
                     *([F.col(weight).cast("double").alias("w")] if weight else []))
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    n = 0
    for r in rows.mapInArrow(_summaries, "j long, n long, values array<double>, counts array<double>").collect():
        part = np.array(r["values"]), np.array(r.counts)
        found[r.j] = _added(found[r.j], part, 1 << 20) if r.j in found else part
        n += r.n if r.j == 0 else 0
    if not n:
        raise ValueError("a booster needs training rows")
    cuts = [cut_points(*found[j], min(spec.bins, n)) for j in range(len(found))]
    bins = tuple(len(c) + 1 for c in cuts)
    fields = tuple(fields_of(bins))
    s = Settings(spec.max_iter, spec.depth, spec.step, spec.subsample, columns_of(spec.features, len(cuts)), spec.min_rows, spec.min_gain, spec.seed & 0xFFFFFFFF,
                 bins, fields, weight is not None)
    blocks = rows.mapInArrow(lambda b: _binned(b, cuts, fields), "v boolean, n long, x binary, y binary, w binary")
    one = n * (2 * (max(f[0] for f in fields) + 1) + (16 if s.weighted else 8)) <= ONE_BYTES
    tasks = 1 if one else max(1, min(sc.defaultParallelism, n // TASK_ROWS))

    def keyed(part: int, rows_: Iterator) -> Iterator:
        # the blocks of a partition go to the tasks in turn, each partition's beginning with another one
        for i, r in enumerate(rows_):
            yield part + i, (part << 32 | i, *r)
    return Prepared(s, cuts, one, blocks.rdd.mapPartitionsWithIndex(keyed).partitionBy(tasks, lambda k: k).values())


def fit_trees(df: DataFrame, label: str, features: str, weight: str | None, validation: str | None, spec) -> tuple[list, list[np.ndarray]]:
    """(trees, thresholds of each feature)."""
    p = prepared(df, label, features, weight, validation, spec)
    s, validate = p.s, validation is not None
    if p.one:
        return p.rows.mapPartitions(lambda rows: [boost(OneTask(rows, s), s, validate)]).collect()[0], p.cuts
    spread = Spread(p.rows, s)
    try:
        return boost(spread, s, validate), p.cuts
    finally:
        spread.rows.unpersist()


def leaf_places(root: list, depth: int) -> list[int]:
    """Nodes at full depth of the leaves from left to right, as MLlib numbers them."""
    def below(n: list, first: int, width: int) -> list[int]:
        return [first] if len(n) == 5 else below(n[8], first, width // 2) + below(n[9], first + width // 2, width // 2)
    return below(root, 0, 1 << depth)


def pinball_rounds(rows: Iterator[tuple], s: Settings, q: float, start: float, every: int) -> tuple[list, list[list[float]], list[float]]:
    """(trees on the sign residuals, what each leaf adds, losses of every so many rounds) of a quantile's booster, its rows in one task."""
    task = OneTask(rows, s)
    gaps = [b.r - start for b in task.blocks]
    weights = [np.ones(len(b.r)) if b.w is None else b.w for b in task.blocks]
    w = np.concatenate(weights)
    roots, leaves, losses = [], [], []
    for i in range(s.max_iter):
        for b, gap in zip(task.blocks, gaps):
            b.r = np.where(gap > 0, q, q - 1.0)
        root, tree = grow(task, s, i, 1.0, 1.0)
        nodes = [_nodes(b, tree.levels, s) << (s.depth - len(tree.levels)) for b in task.blocks]
        node, gap = np.concatenate(nodes), np.concatenate(gaps)
        values, moves = np.zeros(1 << s.depth), []
        for at in leaf_places(root, s.depth):
            inside = np.flatnonzero(node == at)
            order = inside[np.argsort(gap[inside], kind="stable")]
            total = np.cumsum(w[order])
            # the least residual with at least q of the weight at or below it
            moves.append(s.step * float(gap[order[min(np.searchsorted(total, q * total[-1] * (1 - 1e-12)), len(order) - 1)]]))
            values[at] = moves[-1]
        gaps = [g - values[n] for g, n in zip(gaps, nodes)]
        roots.append(root)
        leaves.append(moves)
        if i % every == 0 or i == s.max_iter - 1:
            loss = sum(float(np.sum(np.maximum(g * q, g * (q - 1)) * x)) for g, x in zip(gaps, weights))
            losses.append(loss / float(w.sum()))
    return roots, leaves, losses


def java_trees(sc: SparkContext, trees: list, cuts: Sequence[np.ndarray]) -> list:
    """The trees as MLlib's, on the side of Java."""
    jvm = sc._jvm
    ml = jvm.org.apache.spark.ml
    leaf_, inner_, split_ = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    stats_, numbers = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.org.apache.spark.mllib.util.NumericParser.parse
    tree_, uid = ml.regression.DecisionTreeRegressionModel, ml.util.Identifiable.randomUID

    def build(n: list):
        value, impurity, w, count, square = (float(v) for v in n[:5])
        stats = stats_(numbers(f"[{w!r},{value * w!r},{square!r}]"), int(count))
        if len(n) == 5:
            return leaf_(value, impurity, stats)
        return inner_(value, impurity, n[5], build(n[8]), build(n[9]), split_(n[6], float(cuts[n[6]][n[7]])), stats)
    return [tree_(uid("dtr"), build(t), len(cuts)) for t in trees]


def as_model(sc: SparkContext, trees: list, cuts: Sequence[np.ndarray], step: float) -> GBTRegressionModel:
    """The trees as a model of ``pyspark.ml``, which scores, saves and weighs features."""
    ml = sc._jvm.org.apache.spark.ml
    array = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, t in enumerate(java_trees(sc, trees, cuts)):
        array[i], weights[i] = t, 1.0 if i == 0 else step
    java = ml.regression.GBTRegressionModel(ml.util.Identifiable.randomUID("gbtr"), array, weights, len(cuts))
    model = GBTRegressionModel(java)
    model._resetUid(java.uid())
    return model


class HistogramBooster:
    """Estimator with the columns of a ``GBTRegressor`` and the settings of a ``BoostSpec``."""

    def __init__(self, label: str, spec, features: str = "features", prediction: str = "prediction", weight: str | None = None, validation: str | None = None):
        self.label, self.spec, self.features, self.prediction, self.weight, self.validation = label, spec, features, prediction, weight, validation

    def setPredictionCol(self, name: str) -> HistogramBooster:
        return HistogramBooster(self.label, self.spec, self.features, name, self.weight, self.validation)

    def fit(self, df: DataFrame) -> GBTRegressionModel:
        trees, cuts = fit_trees(df, self.label, self.features, self.weight, self.validation, self.spec)
        model = as_model(df.sparkSession.sparkContext, trees, cuts, self.spec.step)
        return model.setFeaturesCol(self.features).setPredictionCol(self.prediction)

"""Mutual information from nearest neighbours, over all rows and exactly.

For each column and the target the k-th nearest neighbour of every point is sought in the plane of both, in the
larger of the two distances (each divided by its standard deviation); then the points within that distance along either axis
are counted, and the digamma of the counts averaged (Kraskov's first estimator).

Equal points are one row with a multiplicity. The plane is cut into strips of about equal numbers of points along the
column, a strip of many points into slabs along the target. First each slab finds the neighbours among its
own points; then a point whose neighbourhood reaches into other slabs asks these, with the distance found so far. A point asks
few slabs, so no table grows with the square. The counts along an axis are sums of whole strips and a search in
the two strips where the interval ends. Strips follow the data, so a hot value fills a strip of its own and is one row there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import as_number, unpivot
from wattloom.session import durable

#: A strip has about as many points as a square of this many would have along one side, times this many.
STRIP = 1024
SLAB = 1 << 18
CHUNK = 1 << 21


def digamma(n):
    """Of a positive integer column: sums of reciprocals for small numbers, the asymptotic series beyond."""
    table, psi = [], -0.5772156649015329
    for i in range(1, 20):
        table.append(psi)
        psi += 1 / i
    x = n.cast("double")
    s = 1 / (x * x)
    series = F.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s / 240)))
    return F.when(n < 20, F.element_at(F.array(*[F.lit(t) for t in table]), F.least(n, F.lit(19)).cast("int"))).otherwise(series)


def near(qx: np.ndarray, qy: np.ndarray, r: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, sx: float, sy: float, k: int,
         own: np.ndarray | None = None) -> np.ndarray:
    """The k least distances (infinite where there are fewer) from each query to points sorted by y, within r.

    A point of multiplicity m counts m times; ``own`` is each query's place among the points, which counts once less.
    """
    out = np.full((len(qx), k), np.inf)
    reach = np.where(np.isfinite(r), r, np.inf) * sy * (1 + 1e-9)
    low, high = np.searchsorted(y, qy - reach, side="left"), np.searchsorted(y, qy + reach, side="right")
    sizes = high - low
    ends = np.cumsum(sizes)
    at = 0
    while at < len(qx):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        size = sizes[at:to]
        who = np.repeat(np.arange(at, to), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[who]
        d = np.maximum(np.abs(x[place] - qx[who]) / sx, np.abs(y[place] - qy[who]) / sy)
        times = m[place].copy()
        if own is not None:
            times[place == own[who]] -= 1
        keep = (d <= r[who]) & (times > 0)
        who, d, times = who[keep], d[keep], np.minimum(times[keep], k)
        who, d = np.repeat(who, times), np.repeat(d, times)
        order = np.lexsort((d, who))
        who, d = who[order], d[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        first = nth < k
        out[who[first], nth[first]] = d[first]
        at = to
    return out


def _lists(best: np.ndarray) -> pa.Array:
    k = best.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, k * len(best) + 1, k, dtype=np.int32), pa.array(best.ravel()))


def _inside(axis_edges: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The strip of each value: how many edges lie under it."""
    return np.searchsorted(axis_edges, v, side="left")


class Plane:
    """Where strips and slabs are cut, per column; a few numbers for each, from sketches."""

    def __init__(self, scale: dict, x: dict, y: dict, slabs: dict):
        self.scale, self.x, self.y, self.slabs = scale, x, y, slabs

    def place(self, column: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        strip = _inside(self.x[column], x)
        slab = np.zeros(len(x), np.int32)
        for s, cut in self.slabs.get(column, {}).items():
            mine = strip == s
            slab[mine] = _inside(cut, y[mine])
        return strip.astype(np.int32), slab

    def asked(self, column: str, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, strip, slab) of all slabs that the open square around each point reaches into."""
        sx, sy = self.scale[column]
        grow = 1 + 1e-9
        first, last = _inside(self.x[column], x - r * sx * grow), _inside(self.x[column], x + r * sx * grow)
        count = last - first + 1
        who = np.repeat(np.arange(len(x)), count)
        strip = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[who]
        parts = [(who, strip, np.zeros(len(who), np.int64))]
        for s, cut in self.slabs.get(column, {}).items():
            whole = parts[0]
            here = whole[1] == s
            parts[0] = tuple(p[~here] for p in whole)
            mine = whole[0][here]
            a, b = _inside(cut, y[mine] - r[mine] * sy * grow), _inside(cut, y[mine] + r[mine] * sy * grow)
            n = b - a + 1
            parts.append((np.repeat(mine, n), np.full(n.sum(), s), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _by_column(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    names = batch.column("column").dictionary_encode()
    index = names.indices.to_numpy()
    for i, c in enumerate(names.dictionary.to_pylist()):
        yield c, batch.filter(pa.array(index == i))


def _numbers(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in names]


def nearest_distances(points: DataFrame, plane: Plane, k: int) -> DataFrame:
    """``points`` (column, x, y, m) with r, the distance to the k-th nearest other point (infinite if there are fewer)."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, own in _by_column(batch):
                strip, slab = plane.place(c, *_numbers(own, "x", "y"))
                yield pa.RecordBatch.from_arrays([own.column("column"), pa.array(strip), pa.array(slab), own.column("x"), own.column("y"), own.column("m")],
                                                 names=["column", "strip", "slab", "x", "y", "m"])
    at = durable(points.mapInArrow(placed, "column string, strip int, slab int, x double, y double, m long"))

    def within(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        sx, sy = plane.scale[table.column("column")[0].as_py()]
        x, y, m = _numbers(table, "x", "y", "m")
        n, bound = len(x), np.full((len(x), 0), np.inf)
        # neighbours in the order of y bound the search
        for step in range(1, min(n - 1, k + 8) + 1):
            d = np.full((n, 2), np.inf)
            gap = np.maximum(np.abs(x[step:] - x[:-step]) / sx, np.abs(y[step:] - y[:-step]) / sy)
            d[step:, 0], d[:-step, 1] = gap, gap
            bound = np.sort(np.column_stack([bound, d]), axis=1)[:, :k]
        r = bound[:, k - 1] if bound.shape[1] >= k else np.full(n, np.inf)
        best = near(x, y, r, x, y, m, sx, sy, k, np.arange(n))
        return table.append_column("best", _lists(best))
    first = durable(at.groupBy("column", "strip", "slab").applyInArrow(
        within, "column string, strip int, slab int, x double, y double, m long, best array<double>"))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, own in _by_column(batch):
                x, y, strip, slab = _numbers(own, "x", "y", "strip", "slab")
                r = np.array([b[-1] for b in own.column("best").to_pylist()])
                who, to, part = plane.asked(c, x, y, r)
                other = (to != strip[who]) | (part != slab[who])
                who, to, part = who[other], to[other], part[other]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()).take(pa.array(np.zeros(len(who), np.int64))), pa.array(to.astype(np.int32)),
                                                  pa.array(part.astype(np.int32)), pa.array(x[who]), pa.array(y[who]), pa.array(r[who])],
                                                 names=["qcolumn", "qstrip", "qslab", "qx", "qy", "r"])
    questions = first.mapInArrow(asking, "qcolumn string, qstrip int, qslab int, qx double, qy double, r double")

    def answered(table: pa.Table, asks: pa.Table) -> pa.Table:
        none = pa.table({"column": pa.array([], pa.string()), "x": pa.array([], pa.float64()), "y": pa.array([], pa.float64()), "best": pa.array([], pa.list_(pa.float64()))})
        if not len(table) or not len(asks):
            return none
        table = table.sort_by("y")
        x, y, m = _numbers(table, "x", "y", "m")
        best = near(*_numbers(asks, "qx", "qy", "r"), x, y, m, *plane.scale[table.column("column")[0].as_py()], k)
        some = np.isfinite(best[:, 0])
        return pa.table({"column": asks.column("qcolumn").filter(pa.array(some)), "x": asks.column("qx").filter(pa.array(some)),
                         "y": asks.column("qy").filter(pa.array(some)), "best": _lists(best[some])})
    others = at.groupBy("column", "strip", "slab").cogroup(questions.groupBy("qcolumn", "qstrip", "qslab")).applyInArrow(
        answered, "column string, x double, y double, best array<double>")
    both = first.select("column", "x", "y", "m", "best").unionByName(others.withColumn("m", F.lit(None).cast("long")))
    # a point has one row for each slab that it asked
    return both.groupBy("column", "x", "y").agg(F.max("m").alias("m"), F.get(F.array_sort(F.flatten(F.collect_list("best"))), F.lit(k - 1)).alias("r"))


def counts_within(points: DataFrame, plane: Plane, totals: dict) -> DataFrame:
    """``points`` (column, x, y, m, r) with nx and ny: all points, itself included, nearer than r along each axis (as near as 0 if r is 0)."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, own in _by_column(batch):
                v, m = _numbers(own, "v", "m")
                axis = own.column("axis").to_numpy(zero_copy_only=False)
                strip = np.where(axis == 0, _inside(plane.x[c], v), _inside(plane.y[c], v)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column("column"), own.column("axis"), pa.array(strip), own.column("v"), own.column("m")],
                                                 names=["column", "axis", "strip", "v", "m"])
    values = points.select("column", F.inline(F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("v")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("v")))), "m")
    axes = durable(values.groupBy("column", "axis", "v").agg(F.sum("m").alias("m")).mapInArrow(
        lines, "column string, axis int, strip int, v double, m long"))
    before: dict = {}
    for r in sorted(axes.groupBy("column", "axis", "strip").agg(F.sum("m").alias("m")).collect(), key=lambda r: r.strip):
        before.setdefault((r.column, r.axis), []).append((r.strip, r.m))

    def prefix(c: str, axis: int, strips: np.ndarray) -> np.ndarray:
        own = before[c, axis]
        return np.concatenate([[0], np.cumsum([m for _, m in own])])[np.searchsorted([s for s, _ in own], strips, side="left")]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, own in _by_column(batch):
                x, y, r = _numbers(own, "x", "y", "r")
                for axis, v in ((0, x), (1, y)):
                    for side in (1, -1):
                        # the neighbour at r itself is not nearer than r; it may be where a strip ends, so an upper end stays under it
                        reach = r * plane.scale[c][axis] * (1 - 1e-12 if side > 0 else 1)
                        strip = _inside((plane.x if axis == 0 else plane.y)[c], v + side * reach).astype(np.int32)
                        n = len(v)
                        yield pa.RecordBatch.from_arrays([own.column("column"), pa.array(np.full(n, axis, np.int32)), pa.array(strip), own.column("x"), own.column("y"),
                                                          own.column("r"), pa.array(np.full(n, side, np.int32)), pa.array(prefix(c, axis, strip))],
                                                         names=["qcolumn", "qaxis", "qstrip", "x", "y", "r", "side", "base"])
    questions = points.select("column", "x", "y", "r").mapInArrow(
        ends, "qcolumn string, qaxis int, qstrip int, x double, y double, r double, side int, base long")

    def counted(table: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(asks):
            return pa.table({"column": pa.array([], pa.string()), "x": pa.array([], pa.float64()), "y": pa.array([], pa.float64()),
                             "axis": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        table = table.sort_by("v")
        v, m = _numbers(table, "v", "m")
        upto = np.concatenate([[0], np.cumsum(m)])
        c, axis = asks.column("qcolumn")[0].as_py(), asks.column("qaxis")[0].as_py()
        scale = plane.scale[c][axis]
        q, r, side, base = _numbers(asks, "x" if axis == 0 else "y", "r", "side", "base")
        bound = np.nextafter(r, 0)

        def close(i: np.ndarray, who: np.ndarray) -> np.ndarray:
            return np.abs(v[i] - q[who]) / scale <= bound[who]
        # T: values up to the upper end; values before the lower end. The rounded end is mended by the distance itself.
        up = side > 0
        i = np.searchsorted(v, np.where(up, np.maximum(q + r * scale, q), np.minimum(q - r * scale, q)), side="left")
        everyone = np.arange(len(q))
        while True:                         # the upper end goes on over close values, or values not above q
            go = up & (i < len(v))
            go[go] = (v[i[go]] <= q[go]) | close(i[go], everyone[go])
            back = up & (i > 0)
            back[back] = (v[i[back] - 1] > q[back]) & ~close(i[back] - 1, everyone[back])
            low = ~up & (i > 0)
            low[low] = (v[i[low] - 1] >= q[low]) | close(i[low] - 1, everyone[low])
            on = ~up & (i < len(v))
            on[on] = (v[i[on]] < q[on]) & ~close(i[on], everyone[on])
            move = go.astype(int) + on - (back & ~go) - (low & ~on)
            if not move.any():
                break
            i = i + move
        return pa.table({"column": asks.column("qcolumn"), "x": asks.column("x"), "y": asks.column("y"), "axis": asks.column("qaxis"),
                         "n": pa.array(side * (base + upto[i]), pa.int64())})
    ended = axes.groupBy("column", "axis", "strip").cogroup(questions.groupBy("qcolumn", "qaxis", "qstrip")).applyInArrow(
        counted, "column string, x double, y double, axis int, n long")
    sums = ended.groupBy("column", "x", "y").agg(F.sum(F.when(F.col("axis") == 0, F.col("n"))).alias("nx"), F.sum(F.when(F.col("axis") == 1, F.col("n"))).alias("ny"))
    return points.join(sums, ["column", "x", "y"])


def neighbour_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3, strip: int = STRIP, slab: int = SLAB) -> DataFrame:
    """``column, n, mi`` (nats, at least 0) of each column with the target, over the rows where both are finite.

    A column without spread, or with no more than k complete rows, has no information.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    long = unpivot(df, {c: as_number(c) for c in columns}, as_number(target).alias("y")).withColumnRenamed("value", "x").filter(finite[0] & finite[1])
    points = durable(long.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("m")))
    stats = {r.column: r for r in long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).collect()}
    good = {c: r for c, r in stats.items() if r.n > k and r.sx > 0 and r.sy > 0}
    spark = df.sparkSession
    if not good:
        return spark.createDataFrame([(c, stats[c].n if c in stats else 0, 0.0) for c in columns], "column string, n long, mi double")
    kept = points.filter(F.col("column").isin(list(good)))
    distinct = {r.column: r.d for r in kept.groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
    strips = {c: max(1, round(math.sqrt(d / strip))) for c, d in distinct.items()}
    most = max(strips.values())
    probs = [i / most for i in range(1, most)] or [0.5]
    edges = kept.groupBy("column").agg(*[F.percentile_approx(v, probs, 20 * most + 1000).alias(f"e{v}") for v in "xy"]).collect()

    def cut(found: Sequence[float], c: str) -> np.ndarray:
        wanted = strips[c]
        return np.array(sorted({found[max(0, round(i * most / wanted) - 1)] for i in range(1, wanted)}))
    plane = Plane({c: (r.sx, r.sy) for c, r in good.items()}, {r.column: cut(r.ex, r.column) for r in edges}, {r.column: cut(r.ey, r.column) for r in edges}, {})
    # strips that are much fuller than the others are cut along the target
    plane.slabs = _full_strips(kept, plane, slab)
    measured = durable(nearest_distances(kept, plane, k))
    counted = counts_within(measured, plane, distinct)
    n = F.sum("m")
    mi = (digamma(n) + digamma(F.lit(k)) - F.sum(F.col("m") * (digamma(F.col("nx")) + digamma(F.col("ny")))) / n)
    found = counted.groupBy("column").agg(n.alias("n"), F.greatest(mi, F.lit(0.0)).alias("mi"))
    rest = [(c, stats[c].n if c in stats else 0, 0.0) for c in columns if c not in good]
    return found.unionByName(spark.createDataFrame(rest, "column string, n long, mi double")) if rest else found


def _full_strips(points: DataFrame, plane: Plane, slab: int) -> dict:
    """Cuts along y of the strips with more than ``slab`` points."""
    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, own in _by_column(batch):
                yield pa.RecordBatch.from_arrays([own.column("column"), pa.array(_inside(plane.x[c], _numbers(own, "x")[0]).astype(np.int32)), own.column("y")],
                                                 names=["column", "strip", "y"])
    sizes = points.mapInArrow(strips, "column string, strip int, y double").groupBy("column", "strip").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("y", [i / 256 for i in range(1, 256)], 5000).alias("e")).filter(F.col("n") > slab)
    out: dict = {}
    for r in sizes.collect():
        parts = min(256, math.ceil(r.n / slab))
        out.setdefault(r.column, {})[r.strip] = np.array(sorted({r.e[round(i * 256 / parts) - 1] for i in range(1, parts)}))
    return out

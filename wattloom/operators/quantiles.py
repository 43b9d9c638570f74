"""Exact order statistics without sorting or gathering the data.

Spark's exact ``percentile`` keeps every distinct value of a group in one task.
Here a bounded quantile sketch proposes candidate values, one counting pass
verifies them exactly, and the bracket between the two nearest candidates is
searched again. Each pass is a scan with a partial aggregate; the driver sees a
handful of numbers per requested rank. All ranks of a column share its sketch, one
pass counts all candidates, and only brackets counted to be small are finished by
sorting their values, so that the number of scans does not follow the number of ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions import null_nan
from wattloom.session import chunks

ACCURACY = 10_000
DIRECT_ROWS = 500_000
#: Rows of all brackets that are read at once after a search, in units of what one bracket may have.
DIRECT_SHARES = 32
MAX_PASSES = 40


@dataclass
class _Bracket:
    name: str
    ranks: list[int]
    inside: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None
    candidates: list[float] = field(default_factory=list)

    def value(self) -> Column:
        v = F.col(f"`{self.name}`")
        keep = F.lit(True)
        if self.lo is not None:
            keep = keep & (v > F.lit(self.lo))
        if self.hi is not None:
            keep = keep & (v < F.lit(self.hi))
        return F.when(keep, v)

    def probabilities(self, accuracy: int) -> list[float]:
        margin = 2.0 / accuracy
        at = [(k - self.below + 0.5) / self.inside for k in self.ranks]
        return sorted({min(max(p + m, 0.0), 1.0) for p in at for m in (-margin, 0.0, margin)})


def _search(df: DataFrame, open_: list[_Bracket], found: dict, accuracy: int) -> list[_Bracket]:
    """One sketch pass and one verifying pass; returns the still open brackets."""
    sketched = df.agg(*[
        F.percentile_approx(b.value(), b.probabilities(accuracy), accuracy).alias(f"s{i}")
        for i, b in enumerate(open_)]).first()
    for i, b in enumerate(open_):
        b.candidates = sorted(set(sketched[i]))
    names = list(dict.fromkeys(b.name for b in open_))
    tables = [np.unique([x for b in open_ if b.name == n for x in b.candidates]) for n in names]
    counts = df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(_counter(tables), "c int, at int, lt long, le long")
    steps = [np.zeros((2, len(t) + 1), np.int64) for t in tables]
    for r in counts.groupBy("c", "at").agg(F.sum("lt"), F.sum("le")).collect():
        steps[r[0]][:, r[1]] = r[2], r[3]
    upto = {n: (t, *s.cumsum(axis=1)) for n, t, s in zip(names, tables, steps)}
    still: dict[tuple, _Bracket] = {}
    for b in open_:
        table, lt, le = upto[b.name]
        spans = [(x, int(lt[j]), int(le[j])) for x, j in zip(b.candidates, np.searchsorted(table, b.candidates))]
        for k in b.ranks:
            hit = next((x for x, lt, le in spans if lt <= k < le), None)
            if hit is not None:
                found[b.name][k] = hit
                continue
            # ranks separated by a resolved value search on in their own brackets
            lo = max(((x, le) for x, _, le in spans if le <= k), default=(b.lo, b.below),
                     key=lambda t: t[1])
            hi = min(((x, lt) for x, lt, _ in spans if lt > k),
                     default=(b.hi, b.below + b.inside), key=lambda t: t[1])
            own = still.setdefault((b.name, lo[0], hi[0]), _Bracket(b.name, [], hi[1] - lo[1], lo[1], lo[0], hi[0]))
            own.ranks.append(k)
    return list(still.values())


def _present(column: pa.Array) -> np.ndarray:
    return column.drop_null().to_numpy(zero_copy_only=False)


def _counter(tables: list[np.ndarray]) -> Callable:
    """Per column and place in its sorted table: values first below that entry, and first at or below it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(t) + 1), np.int64) for t in tables]
        for batch in batches:
            for column, t, s in zip(batch.columns, tables, sums):
                v = _present(column)
                after = np.searchsorted(t, v, "right")
                s[0] += np.bincount(after, minlength=len(t) + 1)
                s[1] += np.bincount(after - ((after > 0) & (t[after - 1] == v)), minlength=len(t) + 1)
        for c, s in enumerate(sums):
            at = np.flatnonzero(s.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)),
                                              pa.array(s[0, at]), pa.array(s[1, at])], names=["c", "at", "lt", "le"])
    return run


def _finish(df: DataFrame, open_: list[_Bracket], found: dict) -> None:
    """Read the ranks of brackets whose counted size is small.

    One scan keeps (bracket, value) of the values inside, so one short grouped aggregate
    serves any number of brackets and columns.
    """
    names = list(dict.fromkeys(b.name for b in open_))
    # the brackets of a column do not overlap
    order = [sorted((i for i, b in enumerate(open_) if b.name == n), key=lambda i: -math.inf if open_[i].lo is None else open_[i].lo)
             for n in names]
    long = df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(
        _inside([(at, [(open_[i].lo, open_[i].hi) for i in at]) for at in order]), "i int, v double")
    picked = long.groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("s"))
    wanted = F.array(*[F.array(*[F.lit(k - b.below) for k in b.ranks]) for b in open_])
    for r in picked.select("i", F.transform(F.get(wanted, F.col("i")), lambda k: F.get(F.col("s"), k)).alias("at")).collect():
        b = open_[r.i]
        found[b.name].update(zip(b.ranks, r["at"]))


def _inside(columns: list[tuple[list[int], list[tuple]]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [(np.array(at, np.int32), np.array([-np.inf if lo is None else lo for lo, _ in b]), np.array([np.inf if hi is None else hi for _, hi in b]),
                   b[0][0] is None, b[-1][1] is None) for at, b in columns]
        for batch in batches:
            for column, (at, lo, hi, first_open, last_open) in zip(batch.columns, bounds):
                v = _present(column)
                place = np.searchsorted(lo, v, "left") - 1          # the last bracket that begins below the value
                if first_open:
                    place = np.maximum(place, 0)
                keep = (place >= 0) & ((v < hi[place]) | (last_open & (place == len(hi) - 1)))
                yield pa.RecordBatch.from_arrays([pa.array(at[place[keep]]), pa.array(v[keep])], names=["i", "v"])
    return run


def _small_first(open_: list[_Bracket], direct_rows: int, together: int) -> tuple[list[_Bracket], list[_Bracket]]:
    total, small, large = 0, [], []
    for b in sorted(open_, key=lambda b: b.inside):
        total += b.inside
        (small if b.inside <= direct_rows and total <= together else large).append(b)
    return small, large


def order_statistics(df: DataFrame, values: Mapping[str, Column | str],
                     ranks: Callable[[str, int], Sequence[int]],
                     accuracy: int = ACCURACY, direct_rows: int = DIRECT_ROWS,
                     width: int = 48) -> tuple[dict[str, dict[int, float]], dict[str, int]]:
    """Exact values at zero-based ``ranks(name, n)`` of each numeric column.

    Returns ``({name: {rank: value}}, {name: n})``. NULL and NaN are ignored.
    ``width`` columns share one aggregate, so wide frames take several jobs.
    """
    found: dict[str, dict[int, float]] = {}
    sizes: dict[str, int] = {}
    for names in chunks(values, width):
        part = df.select(*[null_nan(_as_double(values[n])).alias(n) for n in names])
        row = part.agg(*[F.count(f"`{n}`").alias(n) for n in names]).first()
        open_ = []
        for n in names:
            sizes[n], found[n] = row[n], {}
            wanted = sorted({min(max(k, 0), row[n] - 1) for k in ranks(n, row[n])}) if row[n] else []
            if wanted:
                open_.append(_Bracket(n, wanted, row[n]))
        for turn in range(MAX_PASSES):
            small, open_ = _small_first(open_, direct_rows, direct_rows * (DIRECT_SHARES if turn else 1))
            if small:
                _finish(part, small, found)
            if not open_:
                break
            open_ = [s for batch in chunks(open_, width)
                     for s in _search(part, batch, found, accuracy)]
        if open_:
            raise RuntimeError(f"rank search did not converge for {[b.name for b in open_]}")
    return found, sizes


def _as_double(c: Column | str) -> Column:
    return (F.col(f"`{c}`") if isinstance(c, str) else c).cast("double")


def exact_percentiles(df: DataFrame, values: Mapping[str, Column | str],
                      probs: Sequence[float], accuracy: int = ACCURACY,
                      direct_rows: int = DIRECT_ROWS) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column (NULL where it is empty)."""
    def ranks(_: str, n: int) -> list[int]:
        return [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]

    found, sizes = order_statistics(df, values, ranks, accuracy, direct_rows)
    out: dict[str, list[float | None]] = {}
    for name, n in sizes.items():
        row: list[float | None] = []
        for p in probs:
            if not n:
                row.append(None)
                continue
            at = (n - 1) * p
            lo, hi = found[name][math.floor(at)], found[name][math.ceil(at)]
            row.append(lo + (hi - lo) * (at - math.floor(at)))
        out[name] = row
    return out


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_percentiles(df, {c: c for c in columns}, [0.5]).items()}


def grouped_quantiles(df: DataFrame, group: str, value: str, q: float, weight: str, accuracy: int = 200,
                      direct_rows: int = 20_000) -> dict:
    """Exact weighted lower quantile of ``value`` per group: the least value with at least ``q`` of the weight at or below it.

    For few groups (a dictionary of them comes back), of any size each: a sketch per group proposes values, one grouped pass
    weighs the rows between them, and the bracket that holds the quantile is searched again until the rows in all
    brackets are few enough to read.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).filter(
        "v is not null and w > 0")

    def per_group(values: Mapping) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(g) for g in values]), F.array(*[
            F.array(*[F.lit(float(x)) for x in v]) for v in values.values()]))
    goal: dict = {}
    # lo < quantile <= hi, the rows up to lo weigh ``below``; the first pass has no brackets yet
    open_: dict = {}
    out: dict = {}
    for turn in range(MAX_PASSES):
        inside = rows
        if turn:
            inside = rows.withColumn("b", F.try_element_at(per_group({g: b[1:] for g, b in open_.items()}), F.col("g"))).filter(
                "v > b[0] and v < b[1]").select("g", "v", "w")
        sketch = {r.g: r for r in inside.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"),
            F.percentile_approx("v", [i / 32 for i in range(1, 32)], accuracy).alias("c")).collect()}
        if not turn:
            goal = {g: q * r.w * (1 - 1e-12) for g, r in sketch.items()}
            open_ = {g: (0.0, float("-inf"), float("inf")) for g in sketch}
        for g, (below, _, hi) in list(open_.items()):
            if g not in sketch or below + sketch[g].w < goal[g]:
                out[g] = hi                             # everything under hi weighs too little
                del open_[g]
        cuts = {g: sorted(set(sketch[g].c)) for g in open_}
        if not cuts:
            return out
        if sum(sketch[g].n for g in open_) <= direct_rows:
            weights = {g: open_[g][0] for g in open_}
            for r in sorted(inside.groupBy("g", "v").agg(F.sum("w").alias("w")).collect(), key=lambda r: r.v):
                if r.g in open_:
                    weights[r.g] += r.w
                    if r.g not in out and weights[r.g] >= goal[r.g]:
                        out[r.g] = r.v
            return out | {g: open_[g][2] for g in open_ if g not in out}
        at = F.size(F.filter(F.try_element_at(per_group(cuts), F.col("g")), lambda c: c < F.col("v")))
        parts: dict = {g: {} for g in cuts}
        for r in inside.groupBy("g", at.alias("i")).agg(F.sum("w").alias("w")).collect():
            if r.g in parts:
                parts[r.g][r.i] = r.w
        for g, c in cuts.items():
            below, lo, hi = open_[g]
            for i in range(len(c) + 1):
                more = below + parts[g].get(i, 0.0)
                if more >= goal[g] or i == len(c):
                    open_[g] = (below, c[i - 1] if i else lo, c[i] if i < len(c) else hi)
                    break
                below = more
    raise RuntimeError("a bracket did not become small; do the values change between scans?")

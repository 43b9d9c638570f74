"""Feature quality, relevance and the physics-first cap. All statistics are
grouped or global partial aggregates; ranking works on one row per feature."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.functions import as_number, unpivot
from wattloom.operators.quantiles import exact_percentiles


def column_quality(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """``column, n, n_valid, sd, varies`` per column, one scan."""
    rows = df if target is None else df.filter(F.col(target).isNotNull())
    long = unpivot(rows, {c: as_number(c) for c in columns})
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"), F.stddev_samp("value").alias("sd"),
        F.coalesce(F.min("value") < F.max("value"), F.lit(False)).alias("varies"))


def usable_columns(df: DataFrame, columns: Sequence[str], min_valid: float = 0.0) -> list[str]:
    """Columns that vary and have more than ``min_valid`` of their rows present."""
    good = {r.column for r in column_quality(df, columns).collect()
            if r.varies and r.n_valid > min_valid * r.n}
    return [c for c in columns if c in good]


def absolute_correlation(df: DataFrame, columns: Sequence[str], target: str,
                         min_rows: int = 0) -> DataFrame:
    """``column, abs_r, n`` against the target over complete pairs, one scan."""
    long = unpivot(df, {c: as_number(c) for c in columns}, as_number(target).alias("_y"))
    both = F.col("value").isNotNull() & F.col("_y").isNotNull()
    out = long.groupBy("column").agg(
        F.abs(F.corr("value", "_y")).alias("abs_r"), F.count_if(both).alias("n"))
    return out.withColumn("abs_r", F.when((F.col("n") > min_rows) & ~F.isnan("abs_r"), F.col("abs_r")))


def binned_mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each column with the target on equal-frequency
    bins of all rows: ``column, mi``. Counts are combined before the shuffle, so it
    moves at most ``bins * bins`` numbers per column and task."""
    probs = [i / bins for i in range(1, bins)]
    names = [*columns, target]
    edges = exact_percentiles(df, {c: c for c in names}, probs)
    edges = [sorted({e for e in edges[c] if e is not None}) for c in names]
    places = [(i, np.array(e, dtype=np.float64)) for i, e in enumerate(edges)]
    counted = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).mapInArrow(
        _cells(places), "i int, bx int, by int, n long")
    label = F.get(F.array(*[F.lit(c) for c in columns]), F.col("i"))
    cells = counted.groupBy(label.alias("column"), "bx", "by").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("column")
    n, nx = F.sum("n").over(w), F.sum("n").over(Window.partitionBy("column", "bx"))
    ny = F.sum("n").over(Window.partitionBy("column", "by"))
    cells = cells.select("column", (F.col("n") / n).alias("p"), (nx / n).alias("px"), (ny / n).alias("py"))
    return cells.groupBy("column").agg(
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))


def _cells(places: list[tuple[int, np.ndarray]]):
    """Rows of a task per column, bin of the value and bin of the target (the last column); a bin is the number of edges below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *columns, (_, target) = places
        sums = [np.zeros((len(e) + 1, len(target) + 1), np.int64) for _, e in columns]
        for batch in batches:
            *values, y = batch.columns
            known = y.is_valid().to_numpy(zero_copy_only=False)
            by = np.searchsorted(target, y.fill_null(0.0).to_numpy(zero_copy_only=False))
            for (_, e), v, s in zip(columns, values, sums):
                both = known & v.is_valid().to_numpy(zero_copy_only=False)
                bx = np.searchsorted(e, v.fill_null(0.0).to_numpy(zero_copy_only=False)[both])
                s += np.bincount(bx * s.shape[1] + by[both], minlength=s.size).reshape(s.shape)
        for (i, _), s in zip(columns, sums):
            bx, by = np.nonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bx), i, np.int32)), pa.array(bx.astype(np.int32)),
                                              pa.array(by.astype(np.int32)), pa.array(s[bx, by])], names=["i", "bx", "by", "n"])
    return run


def percent_rank_average(column: str):
    """Rank share with ties averaged, over a table with one row per feature."""
    w, ties = Window.orderBy(column), Window.partitionBy(column)
    return (F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy())


def hybrid_rank(scores: DataFrame, first: str = "mi", second: str = "importance") -> DataFrame:
    """Mean of the two averaged-tie rank shares, as ``score``."""
    return scores.withColumn(
        "score", (percent_rank_average(first) + percent_rank_average(second)) / 2)


def physics_first(ranked: DataFrame, max_features: int = 250, keep_physics: bool = True) -> DataFrame:
    """The cap: physics columns first, then by score (names break ties)."""
    order = [F.col("score").desc(), F.col("column")]
    if keep_physics:
        order = [F.col("column").startswith(K.PHYSICS_PREFIX).desc(), *order]
    return (ranked.withColumn("position", F.row_number().over(Window.orderBy(*order)))
            .filter(F.col("position") <= max_features))


def top_features(importance: DataFrame, k: int = 25, value: str = "importance") -> DataFrame:
    return importance.orderBy(F.col(value).desc(), "column").limit(k)


def select_features(df: DataFrame, columns: Sequence[str], target: str, max_features: int = 250,
                    keep_physics: bool = True, importance: DataFrame | None = None,
                    bins: int = 10) -> list[str]:
    """Hybrid selection on training rows: usable, information, importance, cap.

    ``importance`` (``column, importance``) usually comes from a small tree model;
    without it absolute correlation is used.
    """
    rows = df.filter(F.col(target).isNotNull())
    usable = usable_columns(rows, columns)
    if not usable:
        return []
    mi = binned_mutual_information(rows, usable, target, bins)
    if importance is None:
        importance = absolute_correlation(rows, usable, target).select(
            "column", F.coalesce("abs_r", F.lit(0.0)).alias("importance"))
    ranked = hybrid_rank(mi.join(importance, "column"))
    return [r.column for r in physics_first(ranked, max_features, keep_physics).orderBy("position").collect()]

"""Leak-free splits, folds and samples from hashed row keys.

The label of a row depends on its key and the seed only, never on partitioning,
and no split shuffles the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.functions import hash_bucket, hash_uniform

#: Equal parts of the hashed key that ranks are counted in.
PARTS = 4096


def _cuts(sizes: Mapping[str, float]) -> list[tuple[str, float]]:
    total, out = 0.0, []
    for name, share in sizes.items():
        total = round(total + share, 10)
        out.append((name, total))
    return out


def _label(u: Column, cuts: Sequence[tuple[str, float | None]]) -> Column:
    out = None
    for name, cut in cuts[:-1]:
        if cut is None:
            return F.lit(name) if out is None else out.otherwise(F.lit(name))
        out = F.when(u < F.lit(cut), name) if out is None else out.when(u < F.lit(cut), name)
    last = F.lit(cuts[-1][0])
    return last if out is None else out.otherwise(last)


def hash_split(df: DataFrame, keys: Sequence[str], sizes: Mapping[str, float] = K.SPLIT_SIZES,
               seed: int = 42, target: str = "split") -> DataFrame:
    """Independent per-row split: expected sizes, no job and no shuffle."""
    return df.withColumn(target, _label(hash_uniform(list(keys), seed), _cuts(sizes)))


def _cut_table(rows: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``s, cut0, cut1, ...``: per stratum the hashed key at the rank of each share, NULL beyond its last row.

    Rows (s, u) are counted per stratum and part of the hash; the part that holds a rank is
    known from the running counts, and only the rows of such parts are numbered. No
    task sees a stratum, and any number of strata is one job.
    """
    part = F.floor(F.col("u") * PARTS).cast("int")
    counts = rows.groupBy("s", part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("s").orderBy("part")
    counts = counts.withColumns({
        "n": F.sum("c").over(Window.partitionBy("s")),
        "ahead": F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    near = lambda q: F.greatest(F.floor(F.col("n") * F.lit(q)) - 2, F.lit(0))
    first = lambda q: F.get(F.filter(F.sequence(near(q), near(q) + 5), lambda i: i / F.col("n") >= F.lit(q)), 0)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), first(q).alias("rank")) for i, q in enumerate(shares)])
    wanted = (counts.withColumn("w", F.explode(ranks)).filter("w.rank >= ahead and w.rank < ahead + c")
              .select(F.col("s").alias("_s"), F.col("part").alias("_part"), (F.col("w.rank") - F.col("ahead") + 1).alias("nth"), "w.i"))
    held = rows.withColumn("part", part)
    at = F.col("s").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_part"))
    numbered = (held.join(wanted.select("_s", "_part").distinct(), at, "left_semi")
                .withColumn("k", F.row_number().over(Window.partitionBy("s", "part").orderBy("u"))))
    hits = numbered.join(wanted, at & (F.col("k") == F.col("nth"))).groupBy("s").agg(
        *[F.max(F.when(F.col("i") == i, F.col("u"))).alias(f"cut{i}") for i in range(len(shares))])
    every = counts.select(F.col("s").alias("_s")).distinct()
    return every.join(hits, F.col("_s").eqNullSafe(F.col("s")), "left").drop("s")


def stratified_split(df: DataFrame, keys: Sequence[str], stratum: str,
                     sizes: Mapping[str, float] = K.SPLIT_SIZES, seed: int = 42,
                     min_stratum: int = 10, target: str = "split") -> DataFrame:
    """Exact shares inside every stratum.

    The cut points are exact order statistics of the hashed key per stratum, in a table of
    one row per stratum that is joined back. Falls back to one stratum if any has fewer
    than ``min_stratum`` rows.
    """
    least = df.groupBy(F.col(stratum)).count().agg(F.min("count")).first()[0]
    s = F.col(stratum) if (least or 0) >= min_stratum else F.lit("all")
    u, cuts = hash_uniform(list(keys), seed), _cuts(sizes)
    table = _cut_table(df.select(s.alias("s"), u.alias("u")), [share for _, share in cuts[:-1]])
    joined = df.withColumns({"_stratum": s, "_u": u}).join(table, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    label = F.lit(cuts[-1][0])
    for i in range(len(cuts) - 2, -1, -1):
        cut = F.col(f"cut{i}")
        label = F.when(cut.isNull() | (F.col("_u") < cut), cuts[i][0]).otherwise(label)
    columns = [c for c in df.columns if c != target]
    return joined.withColumn(target, label).select(*[F.col(f"`{c}`") for c in columns], target)


def add_fold(df: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 42,
             target: str = "fold") -> DataFrame:
    return df.withColumn(target, hash_bucket(list(keys), seed, folds))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of exactly ``n`` rows: the smallest hashed keys."""
    return df.orderBy(hash_uniform(list(keys), seed), *keys).limit(n)


def split_balance(df: DataFrame, stratum: str, split: str = "split") -> DataFrame:
    return df.groupBy(stratum, split).agg(F.count(F.lit(1)).alias("n"))


def group_label(df: DataFrame, zone: str = K.CLIMATE_SIMPLE_COL) -> Column:
    return F.col(zone).cast("string") if zone in df.columns else F.lit("ALL")

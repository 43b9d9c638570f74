"""Measured retrofit savings from before/after building stock.

The stock is one frame with an ``upgrade`` column (0 = baseline). Every estimator
handles all upgrades in one pass with conditional aggregates; only grouped
partial aggregates are shuffled and no building pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom import constants as K
from wattloom.functions import as_number
from wattloom.session import durable


#: Values of a driver column that are sent to all tasks.
FEW_VALUES = 50_000


def _per_upgrade(row: DataFrame, upgrades: Sequence[int], fields: dict[str, str]) -> DataFrame:
    """One wide row (``field_upgrade`` columns) to one row per upgrade."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(int(u)).alias("upgrade"),
                 *[F.col(f"{src}_{u}").alias(name) for name, src in fields.items()])
        for u in upgrades])))


def _energy(energy: str) -> Column:
    return as_number(energy)


def naive_delta(stock: DataFrame, upgrades: Sequence[int] = K.UPGRADES,
                energy: str = K.STOCK_ENERGY_COL) -> DataFrame:
    """Percent difference of the population means, and row coverage in percent."""
    e, u = _energy(energy), F.col("upgrade")
    row = stock.agg(
        F.avg(F.when(u == 0, e)).alias("mb"), F.count_if(u == 0).alias("nb"),
        *[F.avg(F.when(u == k, e)).alias(f"mu_{k}") for k in upgrades],
        *[F.count_if(u == k).alias(f"nu_{k}") for k in upgrades])
    row = row.select(*[
        ((1 - F.try_divide(F.col(f"mu_{k}"), F.col("mb"))) * 100).alias(f"naive_{k}") for k in upgrades], *[
        (F.col(f"nu_{k}") / F.greatest(F.col("nb"), F.lit(1)) * 100).alias(f"coverage_{k}") for k in upgrades], *[
        F.col(f"nu_{k}") for k in upgrades])
    return (_per_upgrade(row, upgrades, {"naive_pct": "naive", "coverage_pct": "coverage", "_n": "nu"})
            .filter(F.col("_n") > 0).drop("_n"))


def paired_delta(stock: DataFrame, upgrades: Sequence[int] = K.UPGRADES, building: str = "bldg_id",
                 energy: str = K.STOCK_ENERGY_COL, min_pairs: int = K.MIN_PAIRS) -> DataFrame:
    """Mean percent saving over all (baseline, upgraded) rows of the same building.

    For a building with several rows the mean over all its pairs is
    ``n_b*n_u - (sum 1/b)(sum u)``, so the pairs themselves are never formed and a
    building with very many copies stays one aggregated row.
    """
    e, u = _energy(energy), F.col("upgrade")
    base = (u == 0) & (e > 0)
    per_building = stock.filter(F.col(building).isNotNull()).groupBy(building).agg(
        F.count_if(base).alias("nb"), F.sum(F.when(base, 1.0 / e)).alias("ib"),
        *[F.count_if((u == k) & (e >= 0)).alias(f"nu_{k}") for k in upgrades],
        *[F.sum(F.when((u == k) & (e >= 0), e)).alias(f"su_{k}") for k in upgrades])
    pairs = {k: F.col("nb") * F.col(f"nu_{k}") for k in upgrades}
    row = per_building.filter(F.col("nb") > 0).agg(
        *[F.coalesce(F.sum(pairs[k]), F.lit(0)).alias(f"n_{k}") for k in upgrades],
        *[F.sum(F.when(pairs[k] > 0, pairs[k] - F.col("ib") * F.col(f"su_{k}"))).alias(f"s_{k}")
          for k in upgrades])
    row = row.select(*[F.col(f"n_{k}") for k in upgrades], *[
        F.when(F.col(f"n_{k}") > min_pairs, F.col(f"s_{k}") / F.col(f"n_{k}") * 100).alias(f"paired_{k}")
        for k in upgrades])
    return _per_upgrade(row, upgrades, {"n_pairs": "n", "paired_pct": "paired"})


def _cell_table(stock: DataFrame, upgrades: Sequence[int], keys: Sequence[str], energy: str,
                base_rows: dict[int, Column]) -> DataFrame:
    """Per cell: baseline rows and mean (per upgrade restriction), upgraded mean."""
    e, u = _energy(energy), F.col("upgrade")
    cells = stock.dropna(subset=list(keys)).groupBy(*keys)
    return cells.agg(
        *[F.count_if((u == 0) & base_rows[k]).alias(f"nb_{k}") for k in upgrades],
        *[F.avg(F.when((u == 0) & base_rows[k], e)).alias(f"mb_{k}") for k in upgrades],
        *[F.avg(F.when(u == k, e)).alias(f"mu_{k}") for k in upgrades])


def _cell_estimate(cells: DataFrame, upgrades: Sequence[int]) -> DataFrame:
    common = {k: F.col(f"mb_{k}").isNotNull() & F.col(f"mu_{k}").isNotNull() for k in upgrades}
    row = cells.agg(
        *[F.count_if(common[k]).alias(f"cells_{k}") for k in upgrades],
        *[F.sum(F.when(common[k], F.col(f"nb_{k}") * F.col(f"mu_{k}"))).alias(f"u_{k}") for k in upgrades],
        *[F.sum(F.when(common[k], F.col(f"nb_{k}") * F.col(f"mb_{k}"))).alias(f"b_{k}") for k in upgrades])
    row = row.select(*[F.col(f"cells_{k}") for k in upgrades], *[
        ((1 - F.try_divide(F.col(f"u_{k}"), F.col(f"b_{k}"))) * 100).alias(f"delta_{k}") for k in upgrades])
    return _per_upgrade(row, upgrades, {"n_cells": "cells", "delta_pct": "delta"})


def matched_cell_delta(stock: DataFrame, upgrades: Sequence[int] = K.UPGRADES,
                       keys: Sequence[str] = K.MATCH_KEYS, energy: str = K.STOCK_ENERGY_COL,
                       min_cells: int = K.MIN_MATCHED_CELLS) -> DataFrame:
    """Delta inside common cells, weighted by baseline rows; NULL below ``min_cells``."""
    keys = [k for k in keys if k in stock.columns]
    if len(keys) < 2:
        return naive_delta(stock, upgrades, energy).select(
            "upgrade", F.lit(0).cast("long").alias("n_cells"), F.lit(None).cast("double").alias("matched_pct"))
    cells = _cell_table(stock, upgrades, keys, energy, {k: F.lit(True) for k in upgrades})
    return _cell_estimate(cells, upgrades).select(
        "upgrade", "n_cells",
        F.when(F.col("n_cells") >= min_cells, F.col("delta_pct")).alias("matched_pct"))


# ---- driver columns and the restricted baseline --------------------------------

def _pinned_numeric(stock: DataFrame, upgrades: Sequence[int], columns: Sequence[str]) -> dict:
    """Numeric columns with a single upgraded value that the baseline also holds."""
    if not columns:
        return {}
    u = F.col("upgrade")
    num = {c: as_number(c) for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(F.when(u == 0, num[c])).alias(f"bl_{i}"), F.max(F.when(u == 0, num[c])).alias(f"bh_{i}")]
        for k in upgrades:
            aggs += [F.min(F.when(u == k, num[c])).alias(f"ul_{i}_{k}"),
                     F.max(F.when(u == k, num[c])).alias(f"uh_{i}_{k}")]
    r = stock.agg(*aggs).first()
    pinned = {(k, c): r[f"ul_{i}_{k}"] for i, c in enumerate(columns) for k in upgrades
              if r[f"ul_{i}_{k}"] is not None and r[f"ul_{i}_{k}"] == r[f"uh_{i}_{k}"]
              and r[f"bl_{i}"] is not None and r[f"bl_{i}"] < r[f"bh_{i}"]}
    if not pinned:
        return {}
    seen = stock.filter(u == 0).agg(*[
        F.count_if(num[c] == F.lit(v)).alias(f"{k}|{c}") for (k, c), v in pinned.items()]).first()
    return {key: [v] for key, v in pinned.items() if seen[f"{key[0]}|{key[1]}"] > 0}


def driver_table(stock: DataFrame, upgrades: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Distinct-value counts per text column and upgrade: ``upgrade, column, n_up,
    n_base, n_new`` (``n_new`` = upgraded values the baseline lacks)."""
    u = F.col("upgrade")
    long = stock.select(u, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))
    values = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.max(u == 0).alias("in_base"), *[F.max(u == k).alias(f"in_{k}") for k in upgrades])
    per_column = values.groupBy("column").agg(
        F.count_if("in_base").alias("n_base"),
        *[F.count_if(f"in_{k}").alias(f"up_{k}") for k in upgrades],
        *[F.count_if(F.col(f"in_{k}") & ~F.col("in_base")).alias(f"new_{k}") for k in upgrades])
    return per_column.select("column", "n_base", F.inline(F.array(*[
        F.struct(F.lit(int(k)).alias("upgrade"), F.col(f"up_{k}").alias("n_up"),
                 F.col(f"new_{k}").alias("n_new")) for k in upgrades])))


def driver_columns(stock: DataFrame, upgrades: Sequence[int] = K.UPGRADES,
                   columns: Sequence[str] | None = None, energy: str = K.STOCK_ENERGY_COL,
                   ids: Sequence[str] = ("bldg_id",)) -> dict[int, list[str]]:
    """Columns an upgrade pins: one value (numbers) or a strict subset (text).

    Numbers need only minima and maxima; only text columns are unpivoted. The
    driver receives one small row per column and upgrade. ``ids`` name rows and are never drivers.
    """
    skip = {"upgrade", energy, *ids}
    names = [c for c in (columns or stock.columns) if c not in skip]
    numeric = [c for c in names if isinstance(stock.schema[c].dataType, T.NumericType)]
    text = [c for c in names if c not in numeric]
    hits = set(_pinned_numeric(stock, upgrades, numeric))
    if text:
        for r in driver_table(stock, upgrades, text).collect():
            if 0 < r.n_up < r.n_base and r.n_new == 0:
                hits.add((r.upgrade, r.column))
    return {k: [c for c in names if (k, c) in hits] for k in upgrades}


def _support(stock: DataFrame, upgrades: Sequence[int], drivers: dict[int, list[str]]) -> tuple[DataFrame, dict[int, Column]]:
    """``stock`` with, per upgrade, whether a row has driver values that occur in that upgrade.

    One pass collects the values of all driver columns with the upgrades they occur in; a column's values are joined
    to the rows once, whichever upgrades ask for it. Few values go to the rows, which would meet in as few tasks as there
    are values; many are left to a shuffled join, which spreads them.
    """
    used = sorted({c for k in upgrades for c in drivers[k]})
    keep = {k: F.lit(True) for k in upgrades}
    if not used:
        return stock, keep
    u = F.col("upgrade")
    values = durable(stock.select(u, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in used]))).filter("value is not null")
        .groupBy("column", "value").agg(*[F.max(u == k).alias(f"in_{k}") for k in upgrades]))
    sizes = {r.column: r["count"] for r in values.groupBy("column").count().collect()}
    for i, c in enumerate(used):
        own = values.filter(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.struct(*[f"in_{k}" for k in upgrades]).alias(f"_f{i}"))
        own = F.broadcast(own) if sizes.get(c, 0) <= FEW_VALUES else own
        stock = stock.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_v{i}"), "left")
    for k in upgrades:
        for c in drivers[k]:
            keep[k] = keep[k] & F.coalesce(F.col(f"_f{used.index(c)}.in_{k}"), F.lit(False))
    return stock, keep


def restricted_stock(stock: DataFrame, upgrade: int, drivers: Sequence[str]) -> DataFrame:
    """One upgrade and the baseline rows whose driver values occur in it."""
    rows, keep = _support(stock, [upgrade], {upgrade: list(drivers)})
    u = F.col("upgrade")
    return rows.filter((u == upgrade) | ((u == 0) & keep[upgrade])).select(*[F.col(f"`{c}`") for c in stock.columns])


def shared_support_delta(stock: DataFrame, upgrades: Sequence[int] = K.UPGRADES,
                         keys: Sequence[str] = K.MATCH_KEYS, columns: Sequence[str] | None = None,
                         energy: str = K.STOCK_ENERGY_COL, min_cells: int = K.MIN_MATCHED_CELLS,
                         min_rows: int = K.MIN_DIAGNOSED_ROWS) -> DataFrame:
    """Delta on the baseline rows that share the upgrade's driver values.

    NULL without a driver column or with fewer than ``min_rows`` such baseline
    rows; a plain mean ratio when fewer than ``min(20, min_cells)`` cells match.
    All upgrades come from one conditional aggregate over cells.
    """
    drivers = driver_columns(stock, upgrades, columns, energy)
    keys = [k for k in keys if k in stock.columns]
    matched = len(keys) >= 2
    rows, keep = _support(stock, upgrades, drivers)
    e, u = _energy(energy), F.col("upgrade")
    aggs = []
    for k in upgrades:
        base = (u == 0) & keep[k]
        # cells carry counts and sums, so the plain ratio of all restricted rows is recovered from them as well
        aggs += [F.count_if(base).alias(f"nb{k}"), F.sum(F.when(base, e)).alias(f"sb{k}"), F.count(F.when(base, e)).alias(f"cb{k}"),
                 F.sum(F.when(u == k, e)).alias(f"su{k}"), F.count(F.when(u == k, e)).alias(f"cu{k}")]
    cells = (rows.groupBy(*keys) if matched else rows.groupBy()).agg(*aggs)
    named = F.lit(True)
    for c in keys if matched else []:
        named = named & F.col(c).isNotNull()
    wide = []
    for k in upgrades:
        nb, sb, cb, su, cu = (F.col(f"{x}{k}") for x in ("nb", "sb", "cb", "su", "cu"))
        common = named & (cb > 0) & (cu > 0)
        wide += [F.coalesce(F.sum(nb), F.lit(0)).alias(f"n_{k}"), F.count_if(common).alias(f"cells_{k}"),
                 F.sum(F.when(common, nb * su / cu)).alias(f"wu_{k}"), F.sum(F.when(common, nb * sb / cb)).alias(f"wb_{k}"),
                 F.try_divide(F.sum(su), F.sum(cu)).alias(f"mu_{k}"), F.try_divide(F.sum(sb), F.sum(cb)).alias(f"mb_{k}")]
    parts = []
    for k in upgrades:
        n, found = F.col(f"n_{k}"), F.col(f"cells_{k}")
        enough = (found >= min(20, min_cells)) & F.lit(matched)
        ratio = F.when(enough, F.try_divide(F.col(f"wu_{k}"), F.col(f"wb_{k}"))).otherwise(F.try_divide(F.col(f"mu_{k}"), F.col(f"mb_{k}")))
        usable = F.lit(bool(drivers[k])) & (n >= min_rows)
        parts.append(F.struct(F.lit(int(k)).alias("upgrade"), F.lit(",".join(drivers[k])).alias("drivers"), n.alias("n_base_restricted"),
                              F.when(usable, found).alias("n_cells"), F.when(usable, (1 - ratio) * 100).alias("shared_support_pct")))
    return cells.agg(*wide).select(F.inline(F.array(*parts)))


def measured_deltas(stock: DataFrame, upgrades: Sequence[int] = K.UPGRADES, building: str | None = "bldg_id",
                    keys: Sequence[str] = K.MATCH_KEYS, columns: Sequence[str] | None = None,
                    energy: str = K.STOCK_ENERGY_COL, min_cells: int = K.MIN_MATCHED_CELLS,
                    min_pairs: int = K.MIN_PAIRS) -> DataFrame:
    """All estimators side by side and the reported one per upgrade.

    Order: paired buildings, shared support (only below 95 % coverage), matched
    cells, population means. ``sign_flip`` marks composition bias. The inputs are
    aggregates with one row per upgrade.
    """
    out = naive_delta(stock, upgrades, energy)
    if building and building in stock.columns:
        out = out.join(paired_delta(stock, upgrades, building, energy, min_pairs), "upgrade", "left")
    else:
        out = out.withColumns({"n_pairs": F.lit(0).cast("long"), "paired_pct": F.lit(None).cast("double")})
    out = out.join(matched_cell_delta(stock, upgrades, keys, energy, min_cells), "upgrade", "left")
    shared = shared_support_delta(stock, upgrades, keys, columns, energy, min_cells)
    out = out.join(shared.drop("n_cells"), "upgrade", "left")
    partial = F.col("coverage_pct") < K.FULL_COVERAGE_PCT
    out = out.withColumn("shared_support_pct", F.when(partial, F.col("shared_support_pct")))
    best = F.coalesce("paired_pct", "shared_support_pct", "matched_pct")
    return out.withColumns({
        "reported_pct": F.coalesce(best, F.col("naive_pct")),
        "estimator": F.when(F.col("paired_pct").isNotNull(), "paired")
        .when(F.col("shared_support_pct").isNotNull(), "shared_support")
        .when(F.col("matched_pct").isNotNull(), "matched").otherwise("naive"),
        "sign_flip": F.coalesce(F.signum(best) != F.signum("naive_pct"), F.lit(False))})


# ---- pairs for the savings models ----------------------------------------------

def saving_pct(base: Column, upgraded: Column) -> Column:
    """Percent saving bounded to [-50, 90]."""
    return F.least(F.greatest((base - upgraded) / base * 100.0, F.lit(-50.0)), F.lit(90.0))


def duplicate_buildings(stock: DataFrame, building: str = "bldg_id") -> DataFrame:
    """Ids that occur more than once in an upgrade. Rows are counted per id, all upgrades side by side, so an id is
    shuffled once and not once per upgrade."""
    found = sorted((r.upgrade for r in stock.select("upgrade").distinct().collect()), key=lambda k: (k is not None, k))
    if not found:
        return stock.groupBy("upgrade").agg(F.count(F.lit(1)).alias("n_duplicate_ids"))
    kind = stock.schema["upgrade"].dataType
    per_id = stock.groupBy(building).agg(*[F.count_if(F.col("upgrade").eqNullSafe(F.lit(k))).alias(f"n{i}") for i, k in enumerate(found)])
    row = per_id.agg(*[F.count_if(F.col(f"n{i}") > 1).alias(f"d{i}") for i in range(len(found))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(k).cast(kind).alias("upgrade"), F.col(f"d{i}").alias("n_duplicate_ids")) for i, k in enumerate(found)]))).filter(
            "n_duplicate_ids > 0")


def building_pairs(stock: DataFrame, upgrade: int, features: Sequence[str], building: str = "bldg_id",
                   energy: str = K.STOCK_ENERGY_COL, min_base: float = 2000.0) -> DataFrame:
    """Upgraded rows with the baseline features and the saving of the same building.

    An id that repeats in the baseline or among the upgraded rows pairs with nothing
    for certain, so it is left out; ``duplicate_buildings`` counts such ids. Both sides
    are one row per id before they meet, so a hot id is only ever counted.
    """
    e, u = _energy(energy), F.col("upgrade")
    base = (stock.filter(u == 0).groupBy(building)
            .agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(e.alias("e_base"), *[F.col(c) for c in features])).alias("b"))
            .filter("_n = 1").select(building, "b.*"))
    up = (stock.filter(u == upgrade).groupBy(building).agg(F.count(F.lit(1)).alias("_n"), F.any_value(e).alias("e_up"))
          .filter("_n = 1 and e_up is not null").select(building, "e_up"))
    pairs = up.join(base, building)
    return (pairs.filter((F.col("e_base") > min_base) & (F.col("e_up") >= 0))
            .withColumn("saving_pct", saving_pct(F.col("e_base"), F.col("e_up"))))


def ordered_pairs(base: DataFrame, up: DataFrame, order: str, energy: str = K.STOCK_ENERGY_COL) -> DataFrame:
    """Row-aligned files without ids: pair on an explicit, unique ordering column
    that both files carry; refused if the row counts differ or it repeats."""
    sizes = [d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(order).alias("d")).first() for d in (base, up)]
    if sizes[0].n != sizes[1].n or any(s.n != s.d for s in sizes):
        raise ValueError("positional pairing needs equal row counts and a unique ordering column")
    return (base.withColumn("e_base", _energy(energy))
            .join(up.select(order, _energy(energy).alias("e_up")), order)
            .withColumn("saving_pct", saving_pct(F.col("e_base"), F.col("e_up"))))


def positions(df: DataFrame, place: str = "position") -> DataFrame:
    """``df``, read from Parquet files, with each row's place over all files in the order of their paths.

    A row's place within its file comes with the scan, and only the row counts of the files are added up, so no row is
    numbered by a pass over the ones before it. The metadata columns have to be reachable: call this on the scan.
    """
    at = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    files = at.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    ahead = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)      # one row per file
    starts = files.select("_file", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    # one row per file goes to the rows: dealt out by file, a file's rows would meet in one task
    return at.join(F.broadcast(starts), "_file").withColumn(place, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def positional_pairs(base: DataFrame, up: DataFrame, energy: str = K.STOCK_ENERGY_COL) -> DataFrame:
    """Rows of two Parquet tables paired by their place; refused if the tables have different numbers of rows.

    For files of one simulation batch, which list the same buildings in the same order without ids.
    """
    sizes = [d.count() for d in (base, up)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"positional pairing needs equal row counts, found {sizes[0]} and {sizes[1]}")
    upgraded = positions(up).select("position", _energy(energy).alias("e_up"))
    return (positions(base).withColumn("e_base", _energy(energy)).join(upgraded, "position")
            .withColumn("saving_pct", saving_pct(F.col("e_base"), F.col("e_up"))))


def pair_cell_keys(df: DataFrame, keys: Sequence[str] = K.PAIR_KEYS, area: str = K.SQFT_COL,
                   bin_ft2: float = 500.0) -> dict[str, Column]:
    """Coarsened text keys: area in half-even rounded bins, missing as 'NA'."""
    out = {}
    for k in keys:
        if k in df.columns:
            c = F.bround(as_number(k) / bin_ft2).cast("long") if k == area else F.col(k)
            out[k] = F.coalesce(c.cast("string"), F.lit("NA"))
    return out


def cell_pairs(stock: DataFrame, upgrade: int, features: Sequence[str] = (),
               keys: Sequence[str] = K.PAIR_KEYS, energy: str = K.STOCK_ENERGY_COL,
               medians: dict[str, float] | None = None, min_keys: int = 3) -> DataFrame:
    """Mean baseline and upgraded energy, and mean baseline features, per common
    cell: one grouped aggregate over baseline and upgrade together."""
    cells = {f"k_{k}": c for k, c in pair_cell_keys(stock, keys).items()}
    if len(cells) < min_keys:
        raise ValueError(f"cell pairing needs {min_keys} keys, found {len(cells)}")
    e, u = _energy(energy), F.col("upgrade")
    table = (stock.filter(u.isin(0, upgrade)).withColumns(cells).groupBy(*cells).agg(
        F.count_if(u == 0).alias("n_base"), F.count_if(u == upgrade).alias("n_up"),
        F.avg(F.when(u == 0, e)).alias("e_base"), F.avg(F.when(u == upgrade, e)).alias("e_up"),
        *[F.avg(F.when(u == 0, as_number(c))).alias(c) for c in features]))
    table = table.filter(F.col("e_base").isNotNull() & F.col("e_up").isNotNull())
    for c in features:
        fill = (medians or {}).get(c)
        table = table.withColumn(c, F.coalesce(F.col(c), F.lit(0.0 if fill is None else float(fill))))
    return table.withColumn("saving_pct", saving_pct(F.col("e_base"), F.col("e_up")))

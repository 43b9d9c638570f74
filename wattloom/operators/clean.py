"""Cleaning and target derivation: sentinels, vintage, intensities, zones, weights,
and the name guard that keeps energy and cost columns out of the features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom import constants as K
from wattloom.functions import as_number, clip, code_map, safe_ratio


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def vintage_year(df: DataFrame, source: str = K.YEAR_RANGE_COL,
                 target: str = K.YEAR_BUILT_COL) -> DataFrame:
    """Vintage band code to its midpoint year (run before sentinels are cleared)."""
    if source not in df.columns:
        return df
    return df.withColumn(target, code_map(as_number(source), K.VINTAGE_MIDPOINT))


def _is_sentinel(name: str, codes: Sequence[int]) -> Column:
    return F.col(f"`{name}`").isin([float(c) for c in codes])


def sentinels_to_null(df: DataFrame, columns: Sequence[str] | None = None,
                      codes: Sequence[int] = K.MISSING_CODES) -> DataFrame:
    """Missing-value codes of numeric columns become NULL, in one projection."""
    targets = set(numeric_columns(df) if columns is None else columns)
    return df.select(*[
        F.when(~_is_sentinel(c, codes), F.col(f"`{c}`")).alias(c) if c in targets else F.col(f"`{c}`")
        for c in df.columns])


def sentinel_counts(df: DataFrame, columns: Sequence[str] | None = None,
                    codes: Sequence[int] = K.MISSING_CODES) -> DataFrame:
    """Replaced values per column, one scan: ``(column, n_missing_codes)``."""
    targets = numeric_columns(df) if columns is None else list(columns)
    row = df.agg(*[F.count_if(_is_sentinel(c, codes)).alias(c) for c in targets])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing_codes"))
        for c in targets])))


def observed(df: DataFrame, counts: Mapping[str, Column], name: str = "counts") -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds ``counts`` (aggregates over its rows) once an action has read all of it.

    The counts are taken as the rows go by, so whatever writes the frame needs no scan of its own for them.
    """
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen


def observed_sentinels(df: DataFrame, columns: Sequence[str] | None = None, codes: Sequence[int] = K.MISSING_CODES,
                       name: str = "sentinels") -> tuple[DataFrame, Observation]:
    """Codes replaced by NULL, the replaced ones counted per column in the same pass."""
    targets = numeric_columns(df) if columns is None else list(columns)
    df, seen = observed(df, {c: F.count_if(_is_sentinel(c, codes)) for c in targets}, name)
    return sentinels_to_null(df, targets, codes), seen


def energy_intensity(df: DataFrame, total: str = K.TOTAL_COL, area: str = K.SQFT_COL,
                     enduses: Mapping[str, str] = K.ENDUSE_BTU) -> DataFrame:
    """``EUI``, and ``EUI_x`` / ``SHARE_x`` per end use; absent end uses become NULL."""
    sqft = clip(as_number(area), lo=1.0)
    whole = as_number(total)
    out = {K.EUI_COL: whole / sqft}
    for task, source in enduses.items():
        used = as_number(source) if source in df.columns else F.lit(None).cast("double")
        out[f"EUI_{task.upper()}"] = used / sqft
        out[f"SHARE_{task.upper()}"] = safe_ratio(used, whole)
    return df.withColumns(out)


def coarse_zone(c: Column | str) -> Column:
    """Climate zone text to Cold / Hot / Mixed; anything unknown is Mixed."""
    z = F.lower(F.col(c) if isinstance(c, str) else c)
    cold = z.contains("cold") | z.contains("very") | z.contains("subarctic")
    return F.when(cold, "Cold").when(z.contains("hot"), "Hot").otherwise("Mixed")


def add_coarse_zone(df: DataFrame, source: str = K.CLIMATE_COL,
                    target: str = K.CLIMATE_SIMPLE_COL) -> DataFrame:
    zone = coarse_zone(source) if source in df.columns else F.lit("Mixed")
    return df.withColumn(target, zone)


def survey_weight(df: DataFrame, name: str = K.WEIGHT_COL) -> Column:
    if name not in df.columns:
        return F.lit(1.0)
    return F.coalesce(as_number(name), F.lit(1.0))


def normalised_weights(df: DataFrame, weight: str = K.WEIGHT_COL, split: str = "split",
                       target: str = "w") -> DataFrame:
    """Weights divided by the mean of their split.

    The split means are one partial aggregate, one row per label; a split has few labels, so its
    means go to the rows. Dealt out by split, as a window or a shuffled join would do, most rows would meet in one task.
    """
    w = survey_weight(df, weight)
    means = df.groupBy(F.col(split).alias("_split")).agg(F.avg(w).alias("_mean"))
    joined = df.join(F.broadcast(means), F.col(split).eqNullSafe(F.col("_split")), "left")
    mean = F.coalesce(F.when(F.col("_mean") != 0, F.col("_mean")), F.lit(1.0))
    kept = [F.col(f"`{c}`") for c in df.columns if c != target]
    return joined.withColumn(target, w / mean).select(*kept, target)


def guarded_names(columns: Sequence[str], tokens: Sequence[str] = K.GUARD_TOKENS,
                  exclude: Sequence[str] = (K.ID_COL,),
                  exclude_prefix: Sequence[str] = (K.WEIGHT_COL,)) -> list[str]:
    """Names the guard removes: ids, (replicate) weights, energy and cost tokens."""
    return [c for c in columns
            if c in exclude or c.startswith(tuple(exclude_prefix))
            or any(t in c.upper() for t in tokens)]


def guard(df: DataFrame, **kw) -> DataFrame:
    removed = set(guarded_names(df.columns, **kw))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in removed])


def align_schema(df: DataFrame, schema: Sequence[str]) -> DataFrame:
    """Fixed column order; absent columns become NULL and unknown ones are dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("double").alias(c)
                       for c in schema])


def target_columns(df: DataFrame) -> DataFrame:
    """Numeric targets and the weight ``_w``, as columns of the same rows."""
    names = [K.TOTAL_COL, K.EUI_COL]
    names += [f"EUI_{t.upper()}" for t in K.ENDUSE_BTU] + [f"SHARE_{t.upper()}" for t in K.ENDUSE_BTU]
    return df.withColumns({
        **{c: as_number(c) for c in names if c in df.columns},
        "_w": survey_weight(df)})


def log_target(c: Column | str) -> Column:
    return F.log1p(clip(c if isinstance(c, Column) else as_number(c), lo=0.0))


def eui_report(df: DataFrame, eui: str = K.EUI_COL, lo: float = 20.0, hi: float = 80.0) -> DataFrame:
    """Count, mean, median, 1st and 99th percentile of intensity, and a range check."""
    from wattloom.operators.quantiles import exact_percentiles
    p01, p50, p99 = exact_percentiles(df, {"eui": eui}, [0.01, 0.5, 0.99])["eui"]
    return df.agg(
        F.count(eui).alias("n"), F.avg(eui).alias("mean_eui"),
        F.lit(p50).cast("double").alias("median_eui"),
        F.lit(p01).cast("double").alias("p01_eui"),
        F.lit(p99).cast("double").alias("p99_eui"),
        F.lit(p50 is not None and lo <= p50 <= hi).alias("in_range"))

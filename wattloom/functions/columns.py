"""Column helpers with the missing-value rules of the analysis: NULL is the only
missing value, clips never fill it, and unknown codes map to NULL or a default."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def null_nan(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def as_number(c: Column | str) -> Column:
    """Coerce to double; text that is not a number, and NaN, become NULL."""
    return null_nan(_col(c).try_cast("double"))


def is_finite(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite(c: Column | str) -> Column:
    c = _col(c)
    return F.when(is_finite(c), c)


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a column; NULL stays NULL (``greatest`` alone would fill it)."""
    c = _col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def default_number(df: DataFrame, name: str, default: float) -> Column:
    """Numeric read of an optional column, missing values and columns filled."""
    if name not in df.columns:
        return F.lit(float(default))
    return F.coalesce(as_number(name), F.lit(float(default)))


def code_map(c: Column | str, table: Mapping, default: float | None = None) -> Column:
    """Lookup in a short literal table; unknown and NULL codes give ``default``."""
    c = _col(c)
    out = None
    for key, value in table.items():
        k = F.lit(key if isinstance(key, str) else float(key))
        v = F.lit(value if isinstance(value, str) else float(value))
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(F.lit(None) if default is None else F.lit(default))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """``num/den`` where the denominator is positive, else NULL."""
    num, den = _col(num), _col(den)
    return F.when(den > 0, num / den)


def first_number(c: Column | str) -> Column:
    """First unsigned decimal number inside a text."""
    return F.nullif(F.regexp_extract(_col(c), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def unpivot(df: DataFrame, values: Mapping[str, Column], *kept: Column | str) -> DataFrame:
    """Rows ``(kept..., column, value)``: grouped by ``column``, one short aggregate
    serves hundreds of columns where one wide aggregate would outgrow codegen."""
    return df.select(*kept, F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), v.alias("value")) for name, v in values.items()])))


def _digest(keys: list[Column | str], seed: int | str) -> Column:
    return F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_uniform(keys: list[Column | str], seed: int | str) -> Column:
    """Uniform [0,1) derived from the row key: the same under any partitioning."""
    head = F.substring(_digest(keys, seed), 1, 13)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(16 ** 13))


def hash_bucket(keys: list[Column | str], seed: int | str, buckets: int) -> Column:
    head = F.substring(_digest(keys, seed), 1, 13)
    return (F.conv(head, 16, 10).cast("bigint") % buckets).cast("int")

"""Train-fitted feature encoder: column kinds, ordinal codes, winsorising, medians."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom import constants as K
from wattloom.functions import as_number, clip, unpivot
from wattloom.operators.clean import align_schema, numeric_columns
from wattloom.operators.quantiles import exact_percentiles
from wattloom.session import durable

MISSING = "MISSING"
LITERAL_LEVELS = 100


def level_counts(df: DataFrame, columns: Sequence[str], exact_below: int) -> dict[str, int]:
    """Distinct non-null values per column, exact where there are at most ``exact_below``.

    A sketch screens all columns in one scan. Columns that it puts well above ``exact_below`` keep its
    figure; the others are counted over (column, value) pairs combined before the shuffle.
    """
    long = unpivot(df, {c: F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))) for c in columns})
    out = {r.column: r.n for r in long.groupBy("column")
           .agg(F.approx_count_distinct("value").alias("n")).collect()}
    few = [c for c in columns if out[c] <= 2 * exact_below + 10]      # many times the sketch's error
    if few:
        exact = {r.column: r.n for r in column_levels(df, few).groupBy("column")
                 .agg(F.count(F.lit(1)).alias("n")).collect()}
        out.update({c: exact.get(c, 0) for c in few})
    return out


def column_levels(df: DataFrame, columns: Sequence[str], missing: str | None = None) -> DataFrame:
    """Distinct ``(column, value)`` pairs as text."""
    def text(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        return v if missing is None else F.coalesce(v, F.lit(missing))
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])))
    return long.filter(F.col("value").isNotNull()).distinct()


def column_kinds(df: DataFrame, columns: Sequence[str] | None = None,
                 max_levels: int = K.MAX_CATEGORY_LEVELS) -> tuple[list[str], list[str]]:
    """(categorical, numeric): text, or numbers with at most ``max_levels`` levels."""
    columns = list(columns or df.columns)
    numeric = [c for c in numeric_columns(df) if c in set(columns)]
    levels = level_counts(df, numeric, max_levels) if numeric else {}
    wide = {c for c in numeric if levels[c] > max_levels}
    return [c for c in columns if c not in wide], [c for c in columns if c in wide]


class FeatureEncoder(Estimator):
    """Fits on the rows it is given, which must be the training split only."""

    def __init__(self, columns: Sequence[str] | None = None, clip_q: float = 0.001,
                 max_levels: int = K.MAX_CATEGORY_LEVELS, keep: Sequence[str] = ()):
        super().__init__()
        self.columns, self.clip_q, self.max_levels, self.keep = columns, clip_q, max_levels, list(keep)

    def _fit(self, df: DataFrame) -> FeatureEncoderModel:
        schema = list(self.columns or [c for c in df.columns if c not in self.keep])
        cats, nums = column_kinds(df, schema, self.max_levels)
        text = [c for c in cats if isinstance(df.schema[c].dataType, T.StringType)]
        sizes = level_counts(df, text, LITERAL_LEVELS) if text else {}
        short = [c for c in cats if sizes.get(c, 0) <= LITERAL_LEVELS]
        levels: dict[str, list[str]] = {c: [] for c in short}
        if short:
            for r in column_levels(df, short, MISSING).collect():
                levels[r.column].append(r.value)
        # code order is code-point order, the same on every engine
        levels = {c: sorted(v) for c, v in levels.items()}
        dictionaries = {c: _dictionary(df, c) for c in cats if c not in levels}
        stats = exact_percentiles(df, {c: as_number(c) for c in nums},
                                  [self.clip_q, 0.5, 1 - self.clip_q]) if nums else {}
        medians = {c: 0.0 if s[1] is None else s[1] for c, s in stats.items()}
        bounds = {c: [medians[c] if s[0] is None else s[0], medians[c] if s[2] is None else s[2]]
                  for c, s in stats.items()}
        return FeatureEncoderModel(schema, levels, medians, bounds, dictionaries, self.keep)


def _dictionary(df: DataFrame, column: str) -> DataFrame:
    """Value to code for a long category list: a distributed sort, then numbering."""
    values = df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING)).alias("value")).distinct()
    numbered = values.sort("value").rdd.zipWithIndex().map(lambda t: (t[0][0], float(t[1])))
    return durable(df.sparkSession.createDataFrame(numbered, "value string, code double"))


class FeatureEncoderModel(Model):
    def __init__(self, schema, levels, medians, bounds, dictionaries=None, keep=()):
        super().__init__()
        self.schema, self.levels, self.medians, self.bounds = list(schema), levels, medians, bounds
        self.dictionaries, self.keep = dictionaries or {}, list(keep)

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.schema if c in self.levels or c in self.dictionaries]

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.schema if c in self.medians]

    def _code(self, c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING))
        if not self.levels[c]:
            return F.lit(-1.0)
        # a lookup, so that the text of a number is made once per row and not once per level
        codes = F.create_map(*[x for i, v in enumerate(self.levels[c]) for x in (F.lit(v), F.lit(float(i)))])
        return F.coalesce(F.try_element_at(codes, text), F.lit(-1.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        """Encoded schema columns plus the ``keep`` columns, untouched."""
        kept = [c for c in self.keep if c in df.columns]
        frame = align_schema(df, kept + [c for c in self.schema if c not in kept])
        for c, words in self.dictionaries.items():
            side = words.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
            text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING))
            frame = frame.join(side, text == F.col("_v"), "left").withColumn(
                c, F.coalesce("_c", F.lit(-1.0))).drop("_v", "_c")
        out = {}
        for c in self.schema:
            if c in self.levels:
                out[c] = self._code(c)
            elif c in self.medians:
                out[c] = F.coalesce(clip(as_number(c), *self.bounds[c]), F.lit(float(self.medians[c])))
        return frame.select(*[F.col(f"`{c}`") for c in kept],
                            *[out.get(c, F.col(f"`{c}`")).alias(c) for c in self.schema if c not in kept])

    def statistics(self, spark: SparkSession) -> DataFrame:
        """Fitted numbers, one row per numeric column."""
        rows = [(c, float(self.bounds[c][0]), float(self.medians[c]), float(self.bounds[c][1]))
                for c in self.numeric]
        return spark.createDataFrame(rows, "column string, lo double, median double, hi double")

    def save(self, spark: SparkSession, path: str) -> None:
        spec = json.dumps({"schema": self.schema, "levels": self.levels, "medians": self.medians,
                           "bounds": self.bounds, "keep": self.keep, "long": sorted(self.dictionaries)})
        spark.createDataFrame([(spec,)], "spec string").write.mode("overwrite").parquet(f"{path}/spec")
        for c, words in self.dictionaries.items():
            words.write.mode("overwrite").parquet(f"{path}/levels/{c}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureEncoderModel:
        s = json.loads(spark.read.parquet(f"{path}/spec").first().spec)
        words = {c: spark.read.parquet(f"{path}/levels/{c}") for c in s["long"]}
        return cls(s["schema"], s["levels"], s["medians"], s["bounds"], words, s["keep"])

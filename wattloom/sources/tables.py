"""Scans of survey, weather, station and building-stock files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom import constants as K
from wattloom.functions import as_number
from wattloom.operators import clean

# encodings in the order they are tried; the second decodes any byte
ENCODINGS = ("utf-8", "iso-8859-1")

_STOCK_NUMBERS = {"sqft", "total_energy_kwh", "elec_kwh", "gas_kwh", "eui_total", "bill_usd",
                  "co2e_kg", "weight"}


def find_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The column of the first alias that any column has, blanks and case aside.

    Among columns of one alias an exact match is preferred, then the earliest.
    """
    ranked = [(rank, column != alias, at, column)
              for rank, alias in enumerate(aliases) for at, column in enumerate(columns)
              if column.strip().casefold() == alias.strip().casefold()]
    return min(ranked)[-1] if ranked else None


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Select the known columns under their canonical names (metadata only)."""
    hits = {name: find_column(df.columns, options) for name, options in aliases.items()}
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in hits.items() if c])


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that decodes every line of the file."""
    lines = spark.read.text(path)
    return ENCODINGS[1] if lines.filter(~F.is_valid_utf8("value")).limit(1).count() else ENCODINGS[0]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             infer: bool = False, encoding: str | None = None, rows: int | None = None) -> DataFrame:
    """CSV with header; without a schema every column is text unless ``infer``.

    ``rows`` caps the rows read, for a quick look at a large file: the scan stops early, and the capped rows pass one task.
    """
    reader = spark.read.option("header", True).option(
        "encoding", encoding or detect_encoding(spark, path)).option("nullValue", "")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", infer).csv(path)
    return df if rows is None else df.limit(rows)


def load_survey(spark: SparkSession, path: str, schema: T.StructType | None = None, rows: int | None = None) -> DataFrame:
    """Survey microdata with vintage year, missing codes cleared, intensities,
    shares and the coarse climate zone."""
    df = read_csv(spark, path, schema, infer=schema is None, rows=rows)
    df = df.toDF(*[c.strip() for c in df.columns])
    df = clean.sentinels_to_null(clean.vintage_year(df))
    return clean.add_coarse_zone(clean.energy_intensity(df))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything to read at ``path``."""
    try:
        return bool(spark.read.text(path).columns)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def load_stations(spark: SparkSession, path: str) -> DataFrame | None:
    """Station metadata under canonical names; ``None`` if the file is absent."""
    if not exists(spark, path):
        return None
    meta = resolve_columns(read_csv(spark, path), K.STATION_ALIASES)
    return meta.withColumn("station_number", F.col("station_number").try_cast("long"))


def load_hourly(spark: SparkSession, path: str) -> DataFrame | None:
    """Hourly weather: only the station and the four series that are used."""
    if not exists(spark, path):
        return None
    df = resolve_columns(read_csv(spark, path), K.WEATHER_ALIASES)
    if not {"station_number", "dry_bulb"} <= set(df.columns):
        raise ValueError("station or dry-bulb column not found")
    return df.select(F.col("station_number").try_cast("long").alias("station_number"),
                     *[as_number(c).alias(c) for c in df.columns if c != "station_number"])


def stock_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Mapped stock columns under survey names, numbers typed; ``keep`` stays as is."""
    aliases = {k: v for k, v in K.STOCK_ALIASES.items() if k != "upgrade"}
    df = resolve_columns(df, aliases | {c: [c] for c in keep})
    typed = df.select(*[
        as_number(c).alias(c) if c in _STOCK_NUMBERS
        else F.col(c).try_cast("long").alias(c) if c == "bldg_id" else F.col(c) for c in df.columns])
    return typed.withColumnsRenamed({k: v for k, v in K.STOCK_TO_SURVEY.items() if k in typed.columns})


def load_stock(spark: SparkSession, files: Mapping[int, str], partitions: int | None = None,
               encoding: str = "utf-8", rows: int | None = None) -> DataFrame:
    """All upgrade files as one frame with an ``upgrade`` column (0 = baseline).

    ``rows`` caps the rows of each file.
    A gzip file is read by one task; ``partitions`` spreads the rows afterwards.
    Absent files are skipped.
    """
    out = None
    for upgrade, path in files.items():
        if not exists(spark, path):
            continue
        part = stock_columns(read_csv(spark, path, encoding=encoding, rows=rows))
        part = part.withColumn("upgrade", F.lit(int(upgrade)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no stock file found")
    return out if partitions is None else out.repartition(partitions)


def store_stock(stock: DataFrame, path: str) -> DataFrame:
    """Columnar copy partitioned by upgrade, so later scans prune to one upgrade."""
    stock.write.mode("overwrite").partitionBy("upgrade").parquet(path)
    return stock.sparkSession.read.parquet(path)


def bucket_stock(stock: DataFrame, table: str, buckets: int, building: str = "bldg_id") -> DataFrame:
    """Catalog table bucketed by building: pairing then needs no shuffle of it."""
    stock.write.mode("overwrite").bucketBy(buckets, building).sortBy(building).saveAsTable(table)
    return stock.sparkSession.table(table)

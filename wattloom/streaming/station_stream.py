"""Station climate kept up to date by a stream of hourly files.

Each micro-batch is reduced to mergeable sums per station and written under its batch number, which replaces what an
interrupted run may have left of the same batch. The features are read off the sum of all parts, so files of a station that
come late change its features exactly as a full recomputation would, and a restart neither loses nor repeats a batch.
``compact`` merges finished parts, so that their number stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wattloom import constants as K
from wattloom.functions import as_number, clip
from wattloom.operators.weather import SERIES, derived_features

#: Sums of one series: how many values, their sum, the sum of squares around the part's own mean, the largest.
PARTS = ("n", "mean", "m2", "max")


def station_sums(hourly: DataFrame, base_c: float = K.DEGREE_DAY_BASE_C, station: str = "station_number") -> DataFrame:
    """One row of mergeable sums per station."""
    series = [c for c in SERIES if c in hourly.columns]
    rows = hourly.select(F.col(station).alias("station_number"), *[as_number(c).alias(c) for c in series]).filter("station_number is not null")
    t = F.col("dry_bulb") if "dry_bulb" in series else F.lit(None).cast("double")
    aggs = [F.sum(clip(base_c - t, lo=0.0) / 24.0).alias("hdd"), F.sum(clip(t - base_c, lo=0.0) / 24.0).alias("cdd"),
            F.count(F.lit(1)).alias("hours")]
    for c in series:
        aggs += [F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{c}_m2"), F.max(c).alias(f"{c}_max")]
    return rows.groupBy("station_number").agg(*aggs)


def merged(parts: DataFrame) -> DataFrame:
    """Parts of a station added up; squares are carried over to the common mean, so that nothing cancels."""
    series = [c for c in SERIES if f"{c}_n" in parts.columns]
    first = parts.groupBy("station_number").agg(
        F.sum("hdd").alias("hdd"), F.sum("cdd").alias("cdd"), F.sum("hours").alias("hours"),
        *[x for c in series for x in (
            F.sum(f"{c}_n").alias(f"{c}_n"), F.try_divide(F.sum(F.col(f"{c}_n") * F.col(f"{c}_mean")), F.sum(f"{c}_n")).alias(f"{c}_mean"),
            F.max(f"{c}_max").alias(f"{c}_max"))])
    centre = first.select("station_number", *[F.col(f"{c}_mean").alias(f"_{c}") for c in series])
    spread = parts.join(centre, "station_number").groupBy("station_number").agg(*[
        F.sum(F.col(f"{c}_m2") + F.col(f"{c}_n") * F.pow(F.col(f"{c}_mean") - F.col(f"_{c}"), 2)).alias(f"{c}_m2") for c in series])
    return first.join(spread, "station_number").select(*parts.select("station_number", "hdd", "cdd", "hours", *[f"{c}_{p}" for c in series for p in PARTS]).columns)


def features(parts: DataFrame) -> DataFrame:
    """The annual features of ``weather.station_climate`` from the sums of all parts."""
    series = {c: s for c, s in SERIES.items() if f"{c}_n" in parts.columns}
    s = merged(parts)
    out = [F.coalesce("hdd", F.lit(0.0)).alias("TMY3_HDD65"), F.coalesce("cdd", F.lit(0.0)).alias("TMY3_CDD65")]
    for c, name in series.items():
        out += [F.col(f"{c}_mean").alias(f"TMY3_{name}_mean"),
                F.when(F.col(f"{c}_n") > 1, F.sqrt(F.col(f"{c}_m2") / (F.col(f"{c}_n") - 1))).alias(f"TMY3_{name}_std"),
                F.col(f"{c}_max").alias(f"TMY3_{name}_max")]
    return derived_features(s.select("station_number", *out, F.col("hours").alias("TMY3_n_hours")))


def keep_station_sums(spark: SparkSession, folder: str, schema: T.StructType, parts: str, progress: str, files_per_batch: int = 1,
                      file_format: str = "parquet", **how) -> StreamingQuery:
    """Reduce new files of ``folder`` to parts below ``parts``; all paths are shared folders, ``progress`` holds the stream's offsets."""
    hourly = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def put(batch: DataFrame, number: int) -> None:
        station_sums(batch, **how).write.mode("overwrite").parquet(f"{parts}/batch={number}")
    return hourly.writeStream.foreachBatch(put).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_parts(spark: SparkSession, parts: str) -> DataFrame:
    """All parts; those that a compacted part has taken in are left out."""
    found = spark.read.option("basePath", parts).parquet(f"{parts}/batch=*")
    upto = compacted(spark, parts)
    if upto is None:
        return found.drop("batch")
    base = spark.read.parquet(f"{parts}/upto={upto}")
    return base.unionByName(found.filter(F.col("batch") > upto).drop("batch"))


def compacted(spark: SparkSession, parts: str) -> int | None:
    """The last batch that a finished compacted part holds."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(parts)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName().split("=")[1]) for s in (fs.listStatus(path) if fs.exists(path) else [])
            if s.getPath().getName().startswith("upto=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=None)


def compact(spark: SparkSession, parts: str) -> int | None:
    """Merge all parts so far into one; a part that is not finished is ignored, so this can be stopped at any time."""
    last = spark.read.option("basePath", parts).parquet(f"{parts}/batch=*").agg(F.max("batch")).first()[0]
    if last is not None and compacted(spark, parts) != last:
        merged(read_parts(spark, parts)).write.mode("overwrite").parquet(f"{parts}/upto={last}")
    return last

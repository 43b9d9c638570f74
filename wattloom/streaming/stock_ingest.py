"""Incremental ingest of building-stock files in bounded steps.

Large stock deliveries are read a few files at a time; a restarted run continues
after the last committed step.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wattloom.sources.tables import stock_columns


def ingest_stock(spark: SparkSession, folder: str, schema: T.StructType, out: str, progress: str,
                 files_per_step: int = 1) -> StreamingQuery:
    """Append the ``upgrade<N>.csv.gz`` files of ``folder`` to a parquet table
    partitioned by upgrade. ``progress`` must be a shared folder."""
    raw = (spark.readStream.schema(schema).option("header", True)
           .option("maxFilesPerTrigger", files_per_step).csv(folder))
    tag = F.regexp_extract(F.col("_metadata.file_name"), r"upgrade(\d+)", 1).try_cast("int")
    mapped = stock_columns(raw.withColumn("_file_upgrade", tag), keep=["_file_upgrade"])
    return (mapped.withColumnRenamed("_file_upgrade", "upgrade").writeStream.format("parquet")
            .partitionBy("upgrade").option("path", out).option("checkpointLocation", progress)
            .trigger(availableNow=True).start())

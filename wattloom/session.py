"""Session helpers: durable lineage cuts and small conveniences."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by the cluster; a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(shared)
    return shared


#: Bytes of files that one task reads.
TASK_BYTES = 32 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Session setting for long formula chains such as the physics features.

    HotSpot never compiles methods above 8000 bytes of bytecode, so a whole-stage
    method beyond that runs interpreted, many times slower. With this limit Spark
    generates code per operator there instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # what a fit holds of a row is several times its size on disk, so a task reads few stored files
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_BYTES))
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one file of a stored frame. A task reads whole files, so this bounds what it holds.
FILE_ROWS = 250_000


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it from there.

    Unlike a checkpoint it is compressed, is read by column, and its partitions follow the size of what is stored and
    the cores there are, not the splits of the source.
    """
    path = run_folder(df.sparkSession, "frame")
    df.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small source to all cores: a file of one row group is read by one task, whatever its size.

    Sources with enough rows for all cores are left as they are. The rows are counted first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.count() < cores * FILE_ROWS else df


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of one run below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def chunks(items: Iterable, size: int) -> list[list]:
    items = list(items)
    return [items[i:i + size] for i in range(0, len(items), size)]

"""Helpers that several operators share: durable cuts, distributed ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared folder that the cluster names; a private one only for tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(shared)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and cut its lineage there."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], salt: Column, out: str,
                counted: DataFrame | None = None) -> DataFrame:
    """Add the 0-based rank ``out`` of each row within ``keys``, ordered by ``salt``, then ``order``.

    No task sees a whole key: rows are counted by (keys, salt), the counts are summed
    ahead of each salt, and rows are numbered within one (keys, salt) only. ``salt``
    has to be an integer of few values that spreads the rows of a key; ``counted`` is
    a cheaper frame with the same keys and salts. Keys may be null.
    """
    salted = df.withColumn("__salt", salt)
    counts = (counted.withColumn("__salt", salt) if counted is not None else salted).groupBy(*keys, "__salt").agg(
        F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    # "the rows of a key and salt" are dealt out once: the join and the window share the hash
    ahead = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__salt").alias("__s"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    match = F.col("__salt") == F.col("__s")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    own = Window.partitionBy(*keys, "__salt").orderBy(*order)
    return (salted.withColumn("__own", F.row_number().over(own)).join(ahead, match)
            .withColumn(out, F.col("__ahead") + F.col("__own") - 1)
            .drop("__salt", "__own", "__s", "__ahead", *[f"__k{i}" for i in range(len(keys))]))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of ``edges``: one row (node, root) per node, root the smallest node.

    Alternating large-star and small-star steps. Each step is a partial minimum per
    node and an equi join on the node, which Spark splits where a node is hot; its
    result is checkpointed, so a lost executor costs one step. Self links and nulls
    are ignored; nodes without links do not appear.
    """
    e = durable(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                .filter("u is not null and v is not null and u <> v").distinct())

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = durable(small.select("x.*").filter("u <> v").distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Thin settings layer over the ``pyspark.ml`` tree learners."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wattloom.models.histograms import HistogramBooster
from wattloom.session import ensure_checkpoint_dir, run_folder


@dataclass(frozen=True)
class BoostSpec:
    """Boosting settings; early stopping on the validation rows bounds ``max_iter``."""

    max_iter: int = 100
    depth: int = 5
    step: float = 0.1
    subsample: float = 0.8
    features: str = "0.7"
    min_rows: int = 5
    min_gain: float = 0.0
    bins: int = 32
    seed: int = 42

    def with_(self, **kw) -> BoostSpec:
        return replace(self, **kw)


def booster(label: str, spec: BoostSpec, features: str = "features", prediction: str = "prediction",
            weight: str | None = None, validation: str | None = None) -> HistogramBooster:
    return HistogramBooster(label, spec, features, prediction, weight, validation)


def forest(label: str, spec: BoostSpec, trees: int = 20, **cols) -> RandomForestRegressor:
    f = RandomForestRegressor(labelCol=label, featuresCol=cols.get("features", "features"),
                              predictionCol=cols.get("prediction", "prediction"), numTrees=trees,
                              maxDepth=spec.depth, subsamplingRate=spec.subsample,
                              featureSubsetStrategy=spec.features, minInstancesPerNode=spec.min_rows,
                              maxBins=spec.bins, seed=spec.seed, maxMemoryInMB=512)
    if cols.get("weight"):
        f = f.setWeightCol(cols["weight"])
    return f.setLeafCol(cols["leaf"]) if cols.get("leaf") else f


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Dense feature vector in the given column order; NULLs must be imputed."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def held(df: DataFrame) -> DataFrame:
    """Keep a training frame that several fits read; lost blocks are recomputed."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fit_early_stopped(df: DataFrame, label: str, spec: BoostSpec, split: str = "split", **cols):
    """Fit on train rows with early stopping on val rows when there are any."""
    rows = df.filter(F.col(split).isin("train", "val") & F.col(label).isNotNull())
    has_val = rows.filter(F.col(split) == "val").limit(1).count() > 0
    if not has_val:
        return booster(label, spec, **cols).fit(rows)
    rows = rows.withColumn("_is_val", F.col(split) == "val")
    return booster(label, spec, validation="_is_val", **cols).fit(rows)


def split_trees(model) -> list | None:
    """The trees of a fitted booster, from the node table it is saved with; None where a split is by category.

    A node is (feature, threshold, left, right), a leaf its value times the weight of its tree. Values up to the threshold go left.
    """
    spark = SparkSession.getActiveSession()
    path = run_folder(spark, "booster")
    model.write().save(path)
    nodes: dict[int, dict[int, Row]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    if any(d.split.numCategories >= 0 for tree in nodes.values() for d in tree.values()):
        return None

    def build(tree: dict[int, Row], i: int, weight: float):
        d = tree[i]
        if d.leftChild < 0:
            return d.prediction * weight
        return d.split.featureIndex, d.split.leftCategoriesOrThreshold[0], build(tree, d.leftChild, weight), build(tree, d.rightChild, weight)
    return [build(nodes[t], 0, weight) for t, weight in enumerate(model.treeWeights)]


#: Rows of all fits that run at once. A row takes some 300 bytes of executors while a forest is fitted (binned point, draws), so that many fits of a large frame push each other out to disk.
ROWS_AT_ONCE = 16_000_000


def fits_at_once(rows: int, most: int) -> int:
    """How many fits on ``rows`` rows are submitted together: ``most`` on small frames, one on large ones."""
    return max(1, min(most, ROWS_AT_ONCE // max(rows, 1)))


def run_parallel(tasks: Sequence[Callable], parallelism: int = 4) -> list:
    """Independent fits share the cluster: each is submitted from its own thread."""
    if not tasks:
        return []
    spark = SparkSession.getActiveSession()
    wrap = inheritable_thread_target(spark) if spark else inheritable_thread_target
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(wrap(t)) for t in tasks]]

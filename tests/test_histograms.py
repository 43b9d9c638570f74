"""The booster on binned rows: the same trees as MLlib's where both see the same bins, in either of its ways."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from wattloom.functions import hash_uniform
from wattloom.models import histograms
from wattloom.models.histograms import cut_points, fields_of
from wattloom.models.pinball import PinballBooster
from wattloom.models.trees import BoostSpec, assemble, booster, fit_early_stopped, split_trees

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """Few values a feature, so that every gap between values is a bin's end, here and in MLlib."""
    u = lambda s: hash_uniform(["id"], s)
    df = spark.range(4000).repartition(3, "id").withColumns({"a": F.floor(u("a") * 9) / 4, "b": F.floor(u("b") * 7) * 1.0, "c": F.floor(u("c") * 5) * 1.0, "w": 0.5 + u("w")})
    df = df.withColumn("y", F.expr("sin(2 * a) * b + if(c > 2, a, -b)") + u("noise"))
    out = assemble(df.withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train")), FEATURES).cache()
    yield out
    out.unpersist()


def scored(model, df):
    return [r.prediction for r in model.setPredictionCol("prediction").transform(df).orderBy("id").select("prediction").collect()]


@pytest.mark.parametrize("weight", [None, "w"])
def test_trees_are_those_of_mllib(planted, weight):
    spec = BoostSpec(max_iter=6, depth=4, subsample=1.0, features="1.0", min_gain=1e-4)
    mine = booster("y", spec, weight=weight).fit(planted)
    other = GBTRegressor(labelCol="y", maxIter=6, maxDepth=4, stepSize=0.1, minInstancesPerNode=5, minInfoGain=1e-4, maxBins=32, featureSubsetStrategy="all")
    other = (other.setWeightCol(weight) if weight else other).fit(planted)
    assert mine.treeWeights == other.treeWeights and [t.numNodes for t in mine.trees] == [t.numNodes for t in other.trees]
    assert np.allclose(scored(mine, planted), scored(other, planted), atol=1e-9)
    assert np.allclose(mine.featureImportances.toArray(), other.featureImportances.toArray(), atol=1e-9)


def test_a_fit_is_a_few_jobs_whatever_its_rounds(spark, planted):
    sc = spark.sparkContext
    sc.setJobGroup("histograms-fit", "")
    try:
        booster("y", BoostSpec(max_iter=25), weight="w").fit(planted)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("histograms-fit")) <= 6


def test_both_ways_give_the_same_trees(planted, monkeypatch):
    spec = BoostSpec(max_iter=9, depth=3)
    one = fit_early_stopped(planted, "y", spec, weight="w")
    monkeypatch.setattr(histograms, "ONE_BYTES", 0)
    monkeypatch.setattr(histograms, "TASK_ROWS", 1000)
    spread = fit_early_stopped(planted, "y", spec, weight="w")
    assert one.getNumTrees == spread.getNumTrees
    assert np.allclose(scored(one, planted), scored(spread, planted), atol=1e-9)


def test_early_stopping_keeps_the_best_rounds(planted):
    noisy = planted.withColumn("y", F.when(F.col("split") == "train", F.col("y")).otherwise(0.0))
    assert fit_early_stopped(noisy, "y", BoostSpec(max_iter=30)).getNumTrees < 30
    assert booster("y", BoostSpec(max_iter=30)).fit(planted).getNumTrees == 30


def test_a_model_is_one_of_mllib(spark, planted, tmp_path):
    model = booster("y", BoostSpec(max_iter=3, depth=2)).fit(planted)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert np.allclose(scored(model, planted), scored(GBTRegressionModel.load(str(tmp_path / "m")), planted))
    assert len(split_trees(model)) == 3


def test_deep_trees_and_leaves_above_full_depth(planted):
    model = booster("y", BoostSpec(max_iter=3, depth=9, min_rows=1, subsample=1.0, features="1.0")).fit(planted)
    other = GBTRegressor(labelCol="y", maxIter=3, maxDepth=9, minInstancesPerNode=1, maxBins=32, featureSubsetStrategy="all").fit(planted)
    gap = np.abs(np.array(scored(model, planted)) - np.array(scored(other, planted)))
    assert gap.max() < 1e-6


def test_odd_inputs(spark):
    flat = assemble(spark.range(50).selectExpr("1.0 a", "cast(id as double) y"), ["a"])
    assert booster("y", BoostSpec(max_iter=2, subsample=1.0)).fit(flat).transform(flat).first().prediction == pytest.approx(24.5)
    with pytest.raises(ValueError):
        booster("y", BoostSpec()).fit(flat.filter("y < 0"))
    with pytest.raises(Exception, match="finite"):
        booster("y", BoostSpec()).fit(flat.withColumn("y", F.lit(float("nan"))))


def test_cut_points():
    assert cut_points(np.array([1.0, 2.0, 4.0]), np.array([5.0, 1.0, 1.0]), 32).tolist() == [1.5, 3.0]
    cuts = cut_points(np.arange(1000.0), np.ones(1000), 4)
    assert cuts.tolist() == [249.5, 499.5, 749.5]
    assert cut_points(np.array([3.0]), np.array([9.0]), 32).size == 0


def test_fields_share_words_without_meeting():
    fields = fields_of([32, 32, 3, 8, 4, 5, 1, 64])
    for j, (word, shift, bits) in enumerate(fields):
        assert 1 << bits >= [32, 32, 3, 8, 4, 5, 1, 64][j] and shift + bits <= 10
        assert not any(word == w and shift < s + b and s < shift + bits for i, (w, s, b) in enumerate(fields) if i != j)
    assert max(f[0] for f in fields) < 4
    assert fields_of([2000, 2])[0] == (0, 0, 11)


def test_pinball_in_one_task_is_that_of_the_jobs(spark, planted, monkeypatch):
    spec = BoostSpec(max_iter=4, depth=3, min_gain=1e-5)
    sc = spark.sparkContext
    sc.setJobGroup("pinball-fit", "")
    try:
        one = PinballBooster.fit(planted, "y", 0.9, spec, "w")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("pinball-fit")) <= 12
    monkeypatch.setattr(histograms, "ONE_BYTES", 0)
    jobs = PinballBooster.fit(planted, "y", 0.9, spec, "w")
    assert [t.numNodes for t in one.trees] == [t.numNodes for t in jobs.trees] and np.allclose(one.losses, jobs.losses, atol=1e-9)
    pairs = jobs.transform(one.transform(planted, "p"), "q")
    assert pairs.filter("abs(p - q) > 1e-9").count() == 0

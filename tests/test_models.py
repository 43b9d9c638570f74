"""Fitted models on a planted signal: what they learn, what they promise, and their copies on disk."""

import pytest
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.functions import hash_uniform
from wattloom.models import validation
from wattloom.models.conserving import EnergyModel, LeafQuantiles, out_of_fold
from wattloom.models.stacking import StackedModel
from wattloom.models.trees import BoostSpec, assemble, booster
from wattloom.operators import split
from wattloom.operators.metrics import interval_coverage, regression_metrics

SPEC = BoostSpec(max_iter=12, depth=4, step=0.3)
FEATURES = ["a", "b", "junk"]


@pytest.fixture(scope="module")
def homes(spark):
    """Energy grows with ``a`` and ``b``; two end uses take known shares of it."""
    u = lambda s: hash_uniform(["id"], s)
    df = spark.range(3000).withColumns({"a": u("a"), "b": u("b"), "junk": u("junk"), "w": F.lit(1.0), K.SQFT_COL: F.lit(1000.0)})
    total = F.exp(8 + 2 * F.col("a") + F.col("b") + 0.05 * u("noise"))
    heat, cool = 0.3 + 0.3 * F.col("a"), 0.1 + 0.1 * F.col("b")
    df = df.withColumns({K.TOTAL_COL: total, "SHARE_HEATING": heat, "SHARE_COOLING": cool})
    df = df.withColumns({K.EUI_COL: F.col(K.TOTAL_COL) / 1000, "EUI_HEATING": F.col(K.TOTAL_COL) * F.col("SHARE_HEATING") / 1000,
                         "EUI_COOLING": F.col(K.TOTAL_COL) * F.col("SHARE_COOLING") / 1000, "y_log": F.log1p(K.TOTAL_COL),
                         "zone": (F.col("id") % 3).cast("string")})
    out = split.hash_split(df, ["id"]).cache()
    yield out
    out.unpersist()


def test_energy_model(spark, homes, tmp_path):
    m = EnergyModel.fit(homes, FEATURES, ["id"], SPEC, "w", tasks=["heating", "cooling"], quantile_trees=4)
    test = homes.filter("split = 'test'").select("id", *FEATURES, K.SQFT_COL, F.col(K.TOTAL_COL).alias("truth"))
    out = m.predict(test)
    assert regression_metrics(out, "truth", "total_btu").first().r2 > 0.8
    bad = out.filter("share_heating < 0 or share_cooling < 0 or share_heating + share_cooling > 1 + 1e-9 "
                     "or abs(share_heating + share_cooling + share_other - 1) > 1e-6")
    assert bad.count() == 0 and out.count() == test.count()
    for task, route in m.routing.items():
        s = m.val_scores[task]
        assert (route == "direct") == (s["direct"] is not None and (s["share"] is None or s["direct"] > s["share"]))
    bounds = m.predict_intervals(test)
    assert bounds.filter("lo > mid or mid > hi or lo < 0").count() == 0
    assert interval_coverage(bounds, "truth", "lo", "hi").first().coverage > 0.8
    m.save(spark, str(tmp_path / "energy"))
    again = EnergyModel.load(spark, str(tmp_path / "energy"))
    assert (again.routing, again.conformal_q, again.n_calib) == (m.routing, m.conformal_q, m.n_calib)
    pairs = out.select("id", "total_btu", "share_heating").join(again.predict(test).select("id", F.col("total_btu").alias("t"), F.col("share_heating").alias("s")), "id")
    assert pairs.filter("abs(total_btu - t) > 1e-6 or abs(share_heating - s) > 1e-9").count() == 0


def test_leaf_quantiles_are_ordered(homes):
    frame = assemble(homes.filter("split = 'train'"), FEATURES).select("id", "y_log", "features")
    out = LeafQuantiles.fit(frame, "y_log", spec=SPEC, trees=4).transform(frame)
    row = out.agg(F.count_if(F.expr("log_q10 > log_q50 or log_q50 > log_q90")).alias("bad"), F.avg((F.col("y_log") <= F.col("log_q90")).cast("double")).alias("under")).first()
    assert row.bad == 0 and row.under > 0.8


def test_out_of_fold_covers_each_row_once(homes):
    frame = split.add_fold(assemble(homes.filter("split = 'train'"), FEATURES), ["id"])
    out = out_of_fold(frame, lambda: booster("y_log", SPEC), 5, "oof")
    assert out.count() == frame.count() == out.select("id").distinct().count()
    assert regression_metrics(out, "y_log", "oof").first().r2 > 0.8


def test_stacked_model(spark, homes, tmp_path):
    train, test = homes.filter("split = 'train'"), homes.filter("split = 'test'")
    m = StackedModel.fit(train, FEATURES, "y_log", ["id"], "w", SPEC, folds=3, trees=5)
    assert all(c >= 0 for c in m.coef.values())
    assert m.oof_r2["stacked"] >= max(v for k, v in m.oof_r2.items() if k != "stacked") - 0.01
    assert m.score(test, "y_log") > 0.9
    m.save(spark, str(tmp_path / "stack"))
    both = m.transform(test).select("id", F.col("stacked_log_total").alias("p")).join(
        StackedModel.load(spark, str(tmp_path / "stack")).transform(test).select("id", F.col("stacked_log_total").alias("q")), "id")
    assert both.filter("abs(p - q) > 1e-9").count() == 0


def test_importance_ranks_the_signal(homes):
    got = {r.column: r.importance for r in validation.tree_importance(homes, FEATURES, "y_log", SPEC).collect()}
    assert got["a"] > got["b"] > got["junk"]

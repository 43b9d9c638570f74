"""Registered queries that fit models, with the operators' default settings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.models import attribution, pinball, signed, tuning, validation
from wattloom.models.conserving import EnergyModel, LeafQuantiles, out_of_fold
from wattloom.models.ledger import Ledger
from wattloom.models.stacking import StackedModel
from wattloom.models.transfer import Teacher
from wattloom.models.trees import BoostSpec, assemble, booster, fit_early_stopped, fits_at_once, held, run_parallel
from wattloom.operators import audit, clean, conservation, metrics, report, savings, scenarios, selection, split
from wattloom.plans import roles
from wattloom.plans.queries import DRIVER_COLUMNS, query, rounded
from wattloom.plans.roles import MODEL_FEATURES, ROW_KEY
from wattloom.session import ensure_checkpoint_dir

FULL = BoostSpec()


@query
def share_conservation(spark, sf):
    """Closed-form shares around one, conserved, with end-use energies."""
    df = roles.households(spark, sf).select(
        *ROW_KEY, K.SQFT_COL, F.col(K.TOTAL_COL).alias("total_btu"),
        (F.col("SHARE_HEATING") * 8).alias("share_heating"), (F.col("SHARE_COOLING") * 9).alias("share_cooling"),
        (F.col("SHARE_DHW") * 4 - 0.02).alias("share_dhw"))
    tasks = ["heating", "cooling", "dhw"]
    out = conservation.enduse_energy(conservation.conserve_shares(df, tasks), tasks)
    return rounded(out.groupBy((F.col("l_linenumber")).alias("line")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"share_{t}").alias(f"share_{t}") for t in [*tasks, "other"]],
        *[F.avg(f"btu_{t}").alias(f"btu_{t}") for t in tasks], F.avg("eui_heating").alias("eui_heating")), 4)


@query
def gbt_total(spark, sf):
    _, df = roles.encoded_households(spark, sf)
    # held: the fit reads it for every tree level, the scores once more
    frame = held(assemble(df, MODEL_FEATURES).select("split", "w", "y_log", "features"))
    model = fit_early_stopped(frame, "y_log", FULL, weight="w")
    return metrics.regression_metrics(model.transform(frame), "y_log", "prediction", "w", ["split"])


def _total_model(df):
    """The booster of ``gbt_total``; what it holds is released when it is fitted."""
    frame = held(assemble(df, MODEL_FEATURES).select("split", "w", "y_log", "features"))
    try:
        return fit_early_stopped(frame, "y_log", FULL, weight="w")
    finally:
        frame.unpersist()


def _energy_model(spark, sf, **kw):
    encoder, df = roles.encoded_households(spark, sf)
    return encoder, df, EnergyModel.fit(df, MODEL_FEATURES, ROW_KEY, FULL, "w", **kw)


@query
def enduse_shares_routed(spark, sf):
    """Test metrics of total, intensity and every end use, with routes."""
    _, df, model = _energy_model(spark, sf, quantiles=False)
    out = model.predict(df.filter("split = 'test'"))
    names = {"total_btu": K.TOTAL_COL, "eui": K.EUI_COL, "eui_direct_ablation": K.EUI_COL,
             **{f"eui_{t}": f"EUI_{t.upper()}" for t in model.routing}}
    long = out.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("metric"), F.lit(model.routing.get(p[4:], "")).alias("route"),
                 F.col(y).alias("y"), F.col(p).alias("p")) for p, y in names.items()])))
    return metrics.regression_metrics(long, "y", "p", by=["metric", "route"])


@query
def conformal_model(spark, sf):
    """Coverage of the calibrated interval of the total model on test rows."""
    _, df, model = _energy_model(spark, sf, tasks=(), quantiles=False)
    out = model.predict_intervals(df.filter("split = 'test'"))
    return metrics.interval_coverage(out, K.TOTAL_COL, "lo", "hi").withColumns(
        {"q": F.lit(model.conformal_q), "mode": F.lit(model.conformal_mode)})


@query
def cross_conformal(spark, sf):
    """Out-of-fold residual quantile inside train, five folds."""
    _, df = roles.encoded_households(spark, sf)
    train = split.add_fold(assemble(df.filter("split = 'train'"), MODEL_FEATURES), ROW_KEY)
    train = held(train.select("fold", "w", "y_log", "features"))
    oof = out_of_fold(train, lambda: booster("y_log", FULL, weight="w"), 5, "oof")
    q, n = metrics.conformal_quantiles(oof, F.col("y_log") - F.col("oof"), K.CURVE_ALPHAS)
    train.unpersist()
    return spark.createDataFrame([(float(a), n, q[a]) for a in q], "alpha double, n long, q double")


@query
def quantile_forest(spark, sf):
    """Observed share of test targets below each predicted quantile."""
    _, df = roles.encoded_households(spark, sf)
    frame = assemble(df, MODEL_FEATURES).select("split", "w", "y_log", "features")
    model = LeafQuantiles.fit(frame.filter("split = 'train'"), "y_log", spec=FULL, weight="w")
    out = model.transform(frame.filter("split = 'test'"))
    return out.agg(F.count(F.lit(1)).alias("n"), *[
        F.avg((F.col("y_log") <= F.col(f"log_q{q}")).cast("double")).alias(f"below_q{q}") for q in (10, 50, 90)])


@query
def stack_oof(spark, sf):
    """Out-of-fold scores, non-negative weights and the test score of the ensemble."""
    _, df = roles.encoded_households(spark, sf)
    model = StackedModel.fit(df.filter("split = 'train'"), MODEL_FEATURES, "y_log", ROW_KEY, "w", FULL)
    test = model.score(df.filter("split = 'test'"), "y_log")
    rows = [(n, float(r2), model.coef.get(n)) for n, r2 in model.oof_r2.items()] + [("stacked_test", test, None)]
    return spark.createDataFrame(rows, "learner string, r2 double, coef double")


@query
def held_out_zone(spark, sf):
    df = roles.model_households(spark, sf)
    return validation.leave_one_zone_out(df, MODEL_FEATURES, "y_log", ledger=_ledger(spark, "zones"))


@query
def feature_selection(spark, sf):
    """Hybrid selection with the importance of a small booster."""
    _, df = roles.encoded_households(spark, sf)
    train = held(df.filter("split = 'train'").select("y_log", *MODEL_FEATURES))
    importance = validation.tree_importance(train, MODEL_FEATURES, "y_log", FULL)
    chosen = selection.select_features(train, MODEL_FEATURES, "y_log", importance=importance)
    train.unpersist()
    return spark.createDataFrame([(i, c) for i, c in enumerate(chosen)], "position int, column string")


STOCK_FEATURES = [K.SQFT_COL, "TYPEHUQ", "FUELHEAT", "vintage"]


@query
def teacher_meta(spark, sf):
    """Teacher on baseline stock; its two columns on the households."""
    teacher = Teacher.fit(roles.stock(spark, sf).filter("upgrade = 0"), STOCK_FEATURES, ["bldg_id"])
    out = teacher.add_meta_features(roles.households(spark, sf))
    return out.groupBy(K.CLIMATE_SIMPLE_COL).agg(
        F.count(F.lit(1)).alias("n"), F.avg("TL_pred_logbtu").alias("mean_logbtu"), F.avg("TL_pred_eui").alias("mean_eui"),
        F.lit(teacher.metrics["holdout_r2_log"]).alias("holdout_r2_log"))


@query
def savings_teacher(spark, sf):
    """One savings model per upgrade, paired by building, beside the measured deltas."""
    stock = roles.stock(spark, sf)
    base = stock.filter("upgrade = 0")
    teacher = Teacher.fit(base, STOCK_FEATURES, ["bldg_id"])
    teacher.fit_savings(stock)
    return teacher.savings_table(base, savings.measured_deltas(stock, columns=DRIVER_COLUMNS))


@query
def savings_teacher_cells(spark, sf):
    """The same models from coarsened cells, for stock without building ids."""
    stock = roles.stock(spark, sf).drop("bldg_id")
    base = stock.filter("upgrade = 0")
    teacher = Teacher.fit(base, STOCK_FEATURES, STOCK_FEATURES)
    teacher.fit_savings(stock, building=None)
    return teacher.savings_table(base)


@query
def model_scenarios(spark, sf):
    """Scenarios scored by the fitted model: student layer of the combined report."""
    encoder, df, model = _energy_model(spark, sf, tasks=(), quantiles=False, calibrate=False)

    def scorer(frame):
        encoder.keep = [c for c in frame.columns if c not in MODEL_FEATURES]
        return model.predict_total(encoder.transform(frame))

    raw = roles.model_households(spark, sf).filter("split = 'test'")
    raw = raw.drop(*[c for c in raw.columns if c.startswith("PH_")])
    table = scenarios.run_scenarios(raw, scorer, savings.measured_deltas(roles.stock(spark, sf), columns=DRIVER_COLUMNS))
    return scenarios.combined_report(table)


@query
def seed_repetition(spark, sf):
    """All seeds of every arm, three of the ensemble, with the paired verdicts; a stopped run is resumed."""
    teacher = Teacher.fit(roles.stock(spark, sf).filter("upgrade = 0"), STOCK_FEATURES, ["bldg_id"])
    _, df = roles.encoded_households(spark, sf)
    df = teacher.add_meta_features(df)
    features = [*MODEL_FEATURES, "TL_pred_logbtu", "TL_pred_eui"]
    scores = validation.seed_scores(df, features, "y_log", ROW_KEY, weight="w", ledger=_ledger(spark, "seeds"))
    return report.model_table(*validation.seed_report(scores))


@query
def simple_baselines(spark, sf):
    teacher = Teacher.fit(roles.stock(spark, sf).filter("upgrade = 0"), STOCK_FEATURES, ["bldg_id"])
    _, df = roles.encoded_households(spark, sf)
    df = teacher.add_meta_features(df)
    return validation.simple_baselines(df, [*MODEL_FEATURES, "TL_pred_logbtu", "TL_pred_eui"], "y_log", weight="w")


@query
def quick_benchmark(spark, sf):
    _, df = roles.encoded_households(spark, sf)
    return validation.quick_benchmark(df, MODEL_FEATURES, "y_log", ROW_KEY)


@query
def random_search(spark, sf):
    _, df = roles.encoded_households(spark, sf)
    return validation.random_search(df, MODEL_FEATURES, "y_log", weight="w")[1]


@query
def permutation_importance(spark, sf):
    _, df = roles.encoded_households(spark, sf)
    model = _total_model(df)
    found = validation.resampled_importance(model, df.filter("split = 'test'"), MODEL_FEATURES, "y_log", ROW_KEY)
    return selection.top_features(found, 10)


@query
def monotonicity(spark, sf):
    _, df = roles.encoded_households(spark, sf)
    model = _total_model(df)
    return validation.monotonicity_violations(model, df.filter("split = 'test'"), MODEL_FEATURES)


def _ledger(spark, name: str) -> Ledger:
    """Finished fits of a query, beside the checkpoints of the job: a run that was stopped goes on where it was."""
    ensure_checkpoint_dir(spark)
    return Ledger(spark, f"{spark.sparkContext.getCheckpointDir()}/ledger-{name}")


@query
def successive_halving(spark, sf):
    """Sixty settings, up to 100 rounds, within a minute: what each rung found, and what the time cut off."""
    _, df = roles.encoded_households(spark, sf)
    return tuning.tune(df, MODEL_FEATURES, "y_log", trials=60, seconds=60, weight="w")[1]


@query
def pinball_quantiles(spark, sf):
    """Observed share of test targets below each boosted quantile, and the pinball loss beside that of a constant."""
    _, df = roles.encoded_households(spark, sf)
    frame = assemble(df, MODEL_FEATURES).select("split", "w", "y_log", "features")
    models = pinball.QuantileModels.fit(frame.filter("split = 'train'"), "y_log", weight="w")
    out = held(models.transform(frame.filter("split = 'test'")).select("y_log", *[f"log_q{q}" for q in (10, 50, 90)]))
    parts = []
    for q in (0.1, 0.5, 0.9):
        p, m = F.col(f"log_q{round(q * 100)}"), models.models[q]
        parts.append(out.agg(F.lit(q).alias("quantile"), F.count(F.lit(1)).alias("n"), F.avg((F.col("y_log") <= p).cast("double")).alias("below"),
                             F.avg(pinball.pinball(F.col("y_log"), p, q)).alias("loss"),
                             F.avg(pinball.pinball(F.col("y_log"), F.lit(m.start), q)).alias("constant_loss"), F.lit(len(m.trees)).alias("rounds")))
    return report.union_all(parts)


@query
def signed_model(spark, sf):
    """Violations of each sign by the free booster and by the signed model, and what the signs cost in test R2."""
    _, df = roles.encoded_households(spark, sf)
    frame = held(assemble(df, MODEL_FEATURES).select("split", "w", "y_log", "features"))
    test = df.filter("split = 'test'")
    parts = []
    for name, model in (("free", fit_early_stopped(frame, "y_log", BoostSpec(), weight="w")),
                        ("signed", signed.SignedModel.fit(frame, MODEL_FEATURES, "y_log", weight="w"))):
        r2 = metrics.regression_metrics(model.setPredictionCol("prediction").transform(frame.filter("split = 'test'")), "y_log", "prediction").first().r2
        parts.append(validation.monotonicity_violations(model, test, MODEL_FEATURES).withColumns({"model": F.lit(name), "test_r2": F.lit(r2)}))
    return report.union_all(parts)


@query
def shapley_attribution(spark, sf):
    """Mean absolute sampled Shapley value of each feature over all test rows."""
    _, df = roles.encoded_households(spark, sf)
    model = _total_model(df)
    frame = assemble(df, MODEL_FEATURES).select(*ROW_KEY, "split", "features")
    phi = attribution.shapley(model, frame.filter("split = 'test'"), MODEL_FEATURES, ROW_KEY, reference=frame.filter("split = 'train'"))
    return attribution.mean_absolute(phi)


def document_audit(homes, encoder, df, scores):
    """All checks of a run: the encoder's numbers are found again in its raw training rows, and both scales of the target are rebuilt."""
    return audit.run_audit(df, MODEL_FEATURES, "y_log", K.TOTAL_COL, encoder=encoder, raw_train=homes.filter("split = 'train'"), scores=scores)


@query
def run_document(spark, sf):
    """One run as one document: model, ensemble, teacher, scenarios, held-out zones and audit on one stored frame.

    Rows are (layer, key, value as JSON): the result tables two to five, the audit and the run's own numbers.
    """
    homes = roles.model_households(spark, sf)
    encoder, df = roles.encoded(homes)
    stock = roles.stock(spark, sf)
    base = stock.filter("upgrade = 0")
    test = df.filter("split = 'test'")

    def taught():
        teacher = Teacher.fit(base, STOCK_FEATURES, ["bldg_id"])
        teacher.fit_savings(stock)
        return teacher

    def stacked():
        model = StackedModel.fit(df.filter("split = 'train'"), MODEL_FEATURES, "y_log", ROW_KEY, "w", FULL)
        return [(n, float(r2), model.coef.get(n)) for n, r2 in model.oof_r2.items()] + [("stacked_test", model.score(test, "y_log"), None)]
    # none needs another's result
    model, teacher, ensemble, zones = run_parallel([
        lambda: EnergyModel.fit(df, MODEL_FEATURES, ROW_KEY, FULL, "w", quantiles=False), taught, stacked,
        lambda: validation.leave_one_zone_out(homes, MODEL_FEATURES, "y_log", ledger=_ledger(spark, "zones"))], fits_at_once(homes.count(), 4))
    scored = held(model.predict(test))
    names = {"total": K.TOTAL_COL, "eui": K.EUI_COL, **{f"eui_{t}": f"EUI_{t.upper()}" for t in model.routing}}
    predicted = {"total": "total_btu", **{n: n for n in names if n != "total"}}
    long = scored.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(y).alias("y"), F.col(predicted[n]).alias("p")) for n, y in names.items()])))
    performance = report.performance_table(metrics.regression_metrics(long, "y", "p", by=["metric"]))
    cover = metrics.interval_coverage(model.predict_intervals(test), K.TOTAL_COL, "lo", "hi").first()
    checks = document_audit(homes, encoder, df, {r.metric: r.r2 for r in performance.collect() if r.r2 is not None})
    passed = audit.verdict(checks)
    removed = audit.removed_ledger(spark, homes.columns, clean.guard(homes).columns)

    def scorer(frame):
        encoder.keep = [c for c in frame.columns if c not in MODEL_FEATURES]
        return model.predict_total(encoder.transform(frame))
    raw = homes.filter("split = 'test'")
    raw = raw.drop(*[c for c in raw.columns if c.startswith("PH_")])
    deltas = savings.measured_deltas(stock, columns=DRIVER_COLUMNS)
    both = scenarios.combined_report(scenarios.run_scenarios(raw, scorer, deltas), teacher.savings_table(base, deltas))
    summary = {"n_features": len(MODEL_FEATURES), "conformal_mode": model.conformal_mode, "conformal_coverage_90": cover.coverage,
               "conformal_mean_width": cover.mean_width, "routing": model.routing, "task_val_scores": model.val_scores,
               "teacher": teacher.metrics, "leakage_forbidden_patterns": list(K.GUARD_TOKENS)}
    layers = {"performance": performance, "ensemble": spark.createDataFrame(ensemble, "learner string, r2 double, coef double"),
              "scenarios": both, "zones": zones, "zones_summary": report.zone_summary(zones), "audit": checks, "audit_verdict": passed,
              "removed_by_guard": removed, "split": df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))}
    parts = [spark.createDataFrame([("summary", k, json.dumps(v)) for k, v in summary.items()], "layer string, key string, value string")]
    for name, table in layers.items():
        parts.append(table.select(F.lit(name).alias("layer"), F.col(table.columns[0]).cast("string").alias("key"),
                                  F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")))
    return report.union_all(parts)

"""Successive halving, quantile boosting, the signed model, the ledger and attributions."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from wattloom.models import attribution, pinball, signed, tuning, validation
from wattloom.models.ledger import Ledger, content, fingerprint
from wattloom.models.trees import BoostSpec, assemble, booster
from wattloom.operators.quantiles import grouped_quantiles
from wattloom.operators.split import hash_split


class Clock:
    """A clock that moves by one second per reading of ``tick``."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now


# ---- tuning ----------------------------------------------------------------------

def test_rungs_grow_by_the_factor():
    assert tuning.rungs(27, 4, 100, 3) == [(27, 4), (9, 12), (3, 36), (1, 100)]
    assert tuning.rungs(2, 100, 100, 3) == [(2, 100)]
    assert tuning.rungs(5, 500, 100, 2) == [(5, 100)]


def test_the_better_part_goes_on():
    specs = tuning.draw_specs(9, seed=1)
    true = {s.seed * 1000 + i: i for i, s in enumerate(specs)}
    ranked = {s.with_(max_iter=0): i for i, s in enumerate(specs)}
    seen = []

    def loss(spec):
        i = ranked[spec.with_(max_iter=0)]
        seen.append((i, spec.max_iter))
        return 1 / spec.max_iter + i / 1000
    best, rows = tuning.halving(specs, loss, tuning.Deadline(None), 10, 90, 3)
    assert len(true) == 9 and best == specs[0].with_(max_iter=90)
    assert [sorted(i for i, n in seen if n == rounds) for rounds in (10, 30, 90)] == [list(range(9)), [0, 1, 2], [0]]
    assert [(r[0], r[1], r[2], r[4]) for r in rows if r[1] > 0] == [(0, 1, 30, False), (1, 1, 30, False), (2, 1, 30, False), (0, 2, 90, False)]


def test_time_is_kept_and_the_best_so_far_returned():
    clock = Clock()
    specs = tuning.draw_specs(8, seed=2)
    deadline = tuning.Deadline(10, clock)

    def loss(spec):
        clock.now += 3
        return spec.step
    best, rows = tuning.halving(specs, loss, deadline, 5, 40, 2)
    done = [r for r in rows if not r[4]]
    assert len(done) == 4 and [r[4] for r in rows] == [False] * 4 + [True] * 4         # 0, 3, 6 and 9 seconds
    assert best.step == min(specs[r[0]].step for r in done) and best.max_iter == 5


def test_a_fit_cut_off_by_the_deadline_stops_only_its_trial():
    clock = Clock()
    specs = tuning.draw_specs(3, seed=3)
    first = specs[0].with_(max_iter=0)

    def loss(spec):
        if spec.with_(max_iter=0) == first:
            return 0.5
        clock.now = 100
        raise RuntimeError("cancelled")
    best, rows = tuning.halving(specs, loss, tuning.Deadline(10, clock), 5, 5)
    assert best == specs[0].with_(max_iter=5) and [r[4] for r in rows] == [False, True, True]

    def broken(spec):
        raise ValueError("not the clock")
    with pytest.raises(ValueError, match="not the clock"):
        tuning.halving(specs, broken, tuning.Deadline(None), 5, 5)


def test_nothing_finished_gives_no_answer():
    assert tuning.halving(tuning.draw_specs(2), lambda s: 1.0, tuning.Deadline(0, Clock()))[0] is None


def test_settings_lie_in_their_ranges():
    specs, r = tuning.draw_specs(200, seed=4), tuning.Ranges()
    for s in specs:
        assert r.step[0] <= s.step <= r.step[1] and r.depth[0] <= s.depth <= r.depth[1] and r.min_gain[0] <= s.min_gain <= r.min_gain[1]
        assert r.subsample[0] <= s.subsample <= r.subsample[1] and r.column_share[0] <= float(s.features) <= r.column_share[1]
    assert specs[:5] == tuning.draw_specs(5, seed=4) and {s.depth for s in specs} == set(range(4, 10))


def test_the_watch_cancels_tagged_jobs(spark):
    clock, done = Clock(), threading.Event()
    deadline = tuning.Deadline(5, clock)
    watch = threading.Thread(target=deadline.watch, args=(spark, "slow-fit", done, 0.05))
    watch.start()
    spark.sparkContext.addJobTag("slow-fit")
    try:
        clock.now = 6
        with pytest.raises(Exception, match="cancel"):
            spark.range(0, 1 << 40, 1, 64).select(F.sum(F.sha2(F.col("id").cast("string"), 256).cast("double"))).collect()
    finally:
        spark.sparkContext.removeJobTag("slow-fit")
        done.set()
        watch.join()
    assert spark.range(3).count() == 3


# ---- a planted table -------------------------------------------------------------

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(6)
    rows = [(i, *[r.uniform(0, 1) for _ in NAMES], r.gauss(0, 1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double")
    df = df.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + F.sin(6 * F.col("c")) + (0.2 + 0.8 * F.col("d")) * F.col("e"))
    df = hash_split(df, ["id"]).withColumn("w", 1.0 + F.col("id") % 3)
    return assemble(df, NAMES).coalesce(2).cache()


def test_tune_on_a_table(planted):
    best, table = tuning.tune(planted.drop("features"), NAMES, "y", trials=3, seconds=600, least=2, most=4, factor=2)
    rows = table.collect()
    assert best is not None and best.max_iter == 4
    assert [(r.rung, r.rounds) for r in rows] == [(0, 2)] * 3 + [(1, 4)] * 2 and not any(r.stopped for r in rows)
    top = min((r for r in rows if r.rung == 1), key=lambda r: r.loss)
    assert top.depth == best.depth and math.isclose(top.step, best.step)


# ---- quantiles -------------------------------------------------------------------

@pytest.mark.parametrize("direct", [10, 10 ** 6])
def test_grouped_quantiles_are_exact(spark, direct):
    r = random.Random(7)
    rows = [(g, v, w) for g in range(4) for v, w in [(float(round(r.gauss(0, 1), g)), r.choice([0.0, 0.5, 1.0, 2.5])) for _ in range(900)]]
    rows += [(9, 5.0, 1.0)] * 300 + [(9, 4.0, 1.0)] * 2 + [(8, 1.0, 1.0), (7, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = grouped_quantiles(df, "g", "v", q, "w", direct_rows=direct)
        for g in {x[0] for x in rows} - {7}:
            own = sorted((v, w) for h, v, w in rows if h == g and w > 0)
            total, at, want = sum(w for _, w in own), 0.0, own[-1][0]
            for v, w in own:
                at += w
                if at >= q * total * (1 - 1e-12):
                    want = v
                    break
            assert got[g] == want, (g, q)
        assert 7 not in got


def test_pinball_boosting_covers(planted):
    """Observed shares on test rows within three points of nominal."""
    models = pinball.QuantileModels.fit(planted.filter("split = 'train'"), "y", weight="w", spec=BoostSpec(max_iter=20, depth=3, step=0.3))
    out = models.transform(planted.filter("split <> 'train'")).cache()
    n = out.count()
    for q in (10, 50, 90):
        share = out.filter(F.col("y") <= F.col(f"log_q{q}")).count() / n
        assert abs(share - q / 100) <= 0.03, (q, share)
    assert out.filter("log_q10 > log_q50 or log_q50 > log_q90").count() == 0
    # the width follows the spread: narrow where d is small
    width = {r.s: r.w for r in out.groupBy((F.col("d") > 0.5).alias("s")).agg(F.avg(F.col("log_q90") - F.col("log_q10")).alias("w")).collect()}
    assert width[True] > 1.3 * width[False]
    for m in models.models.values():
        assert m.losses[-1] < m.losses[0]


# ---- signs -----------------------------------------------------------------------

def test_pool_adjacent_is_the_monotone_fit():
    r = random.Random(8)
    for _ in range(200):
        n = r.randrange(1, 8)
        v, w = [r.choice([-1.0, 0.0, 1.0, 2.5]) for _ in range(n)], [r.choice([0.5, 1.0, 3.0]) for _ in range(n)]
        # min-max formula of isotonic regression
        mean = lambda a, b: sum(x * y for x, y in zip(v[a:b], w[a:b])) / sum(w[a:b])
        want = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        assert signed.pool_adjacent(v, w) == pytest.approx(want)
        assert signed.pool_adjacent([-x for x in v], w, -1) == pytest.approx([-x for x in want])


def test_signed_model_keeps_all_signs(planted):
    signs = {"a": 1, "b": -1}
    model = signed.SignedModel.fit(planted, NAMES, "y", signs, BoostSpec(max_iter=20, depth=4), "w", rounds=40)
    test = planted.filter("split = 'test'").drop("features")
    out = validation.monotonicity_violations(model, test, NAMES, signs, share=0.3).collect()
    assert {r.column for r in out} == set(signs) and all(r.violation_share == 0 for r in out)
    free = booster("y", BoostSpec(max_iter=40, depth=4), weight="w").fit(planted.filter("split = 'train'"))
    rows = assemble(test, NAMES)
    from wattloom.operators.metrics import regression_metrics
    kept, loose = (regression_metrics(m.transform(rows), "y", "prediction").first().r2 for m in (model, free))
    assert kept > loose - 0.05 and kept > 0.5


def test_signed_model_with_and_without_signed_features(planted):
    none = signed.SignedModel.fit(planted, NAMES, "y", {}, BoostSpec(max_iter=3, depth=3))
    only = signed.SignedModel.fit(assemble(planted.drop("features"), ["a", "b"]), ["a", "b"], "y", {"a": 1, "b": -1}, rounds=10)
    assert none.transform(planted).filter("prediction is null").count() == 0 and only.rest is None
    assert only.transform(assemble(planted.drop("features"), ["a", "b"])).filter("prediction is null").count() == 0


# ---- ledger ----------------------------------------------------------------------

def test_a_stopped_run_refits_only_what_is_absent(spark, tmp_path):
    path, calls = str(tmp_path / "ledger"), []

    def fit(name, fails=False):
        def go():
            calls.append(name)
            if fails:
                raise RuntimeError(f"lost {name}")
            return {"score": len(name) / 7, "none": None}
        return go
    with pytest.raises(RuntimeError, match="lost b"):
        Ledger(spark, path).run({"a": fit("a"), "b": fit("b", True), "cc": fit("cc")}, parallelism=1)
    out = Ledger(spark, path).run({"a": fit("a"), "b": fit("b"), "cc": fit("cc")}, parallelism=2)
    assert sorted(calls) == ["a", "b", "b", "cc"]
    assert out == {"a": {"score": 1 / 7, "none": None}, "b": {"score": 1 / 7, "none": None}, "cc": {"score": 2 / 7, "none": None}}
    whole = Ledger(spark, str(tmp_path / "other")).run({"a": fit("a"), "b": fit("b"), "cc": fit("cc")})
    assert whole == out and Ledger(spark, path).table().count() == 3
    assert Ledger(spark, path).run({}) == {}


def test_fingerprints_tell_settings_and_data_apart(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert content(df, ["id", "x"]) == content(df.repartition(3), ["id", "x"]) != content(df.withColumn("x", F.col("x") + 1), ["id", "x"])
    assert fingerprint(BoostSpec(), 1) == fingerprint(BoostSpec(), 1) != fingerprint(BoostSpec(depth=6), 1)


def test_held_out_zones_resume(spark, planted, tmp_path, monkeypatch):
    df = planted.drop("features").coalesce(1).withColumn("zone", F.concat(F.lit("z"), F.col("id") % 3))
    spec = BoostSpec(max_iter=2, depth=2)
    fits = []
    real = validation.tree_importance

    def counted(*a, **k):
        fits.append(1)
        if len(fits) == 3 and not (tmp_path / "second").exists():
            raise RuntimeError("stopped")
        return real(*a, **k)
    monkeypatch.setattr(validation, "tree_importance", counted)
    with pytest.raises(RuntimeError, match="stopped"):
        validation.leave_one_zone_out(df, NAMES, "y", "zone", spec, parallelism=1, ledger=Ledger(spark, str(tmp_path / "zones")))
    (tmp_path / "second").mkdir()
    resumed = validation.leave_one_zone_out(df, NAMES, "y", "zone", spec, parallelism=1, ledger=Ledger(spark, str(tmp_path / "zones"))).collect()
    assert len(fits) == 4 and len(resumed) == 3
    third = validation.leave_one_zone_out(df, NAMES, "y", "zone", spec, zones=["z2"], parallelism=1).collect()
    assert [r for r in resumed if r.zone == "z2"] == third


# ---- attribution -----------------------------------------------------------------

class Additive:
    """A planted model over the vector's elements."""

    def __init__(self, expr, out="prediction"):
        self.expr, self.out = expr, out

    def setPredictionCol(self, name):
        return Additive(self.expr, name)

    def transform(self, df):
        from pyspark.ml.functions import vector_to_array
        x = vector_to_array("features")
        return df.withColumn(self.out, self.expr(x))


def test_attribution_of_an_additive_model_is_its_terms(planted):
    rows = planted.filter("id < 40")
    phi = attribution.shapley(Additive(lambda x: 5 * x[0] - 2 * x[1]), rows, NAMES, ["id"], orders=64, background=200, reference=planted)
    means = planted.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    found = {(r.id, r.column): r.phi for r in phi.collect()}
    assert len(found) == 40 * 4
    for r in rows.collect():
        assert found[r.id, "a"] == pytest.approx(5 * (r.a - means.a), abs=0.75)
        assert found[r.id, "b"] == pytest.approx(-2 * (r.b - means.b), abs=0.35)
        assert found[r.id, "c"] == pytest.approx(0, abs=1e-9) and found[r.id, "d"] == pytest.approx(0, abs=1e-9)
    top = attribution.mean_absolute(phi).orderBy(F.desc("mean_abs_phi")).collect()
    assert [r.column for r in top[:2]] == ["a", "b"]


def test_attribution_adds_up_to_the_prediction(planted):
    model = Additive(lambda x: x[0] * x[1] + F.sin(x[2]) * x[3])
    rows = planted.filter("id < 30")
    total = {r.id: r.s for r in attribution.shapley(model, rows, NAMES, ["id"], 4, 1, reference=planted).groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    base = attribution.background_rows(planted, ["id"], 1, 42)[0]
    start = base[0] * base[1] + math.sin(base[2]) * base[3]
    for r in model.transform(rows).collect():
        assert total[r.id] == pytest.approx(r.prediction - start)


def test_a_booster_is_walked_by_paths_and_its_steps_are_not_scored(planted):
    rows = planted.filter("id < 60")
    model = booster("y", BoostSpec(max_iter=6, depth=4), weight=None).fit(planted.withColumn("y", F.expr("a * b + if(c > 0.4, d, -a) + sin(9 * b)")))
    phi = attribution.shapley(model, rows.union(rows.filter("id < 2")), NAMES, ["id"], orders=3, background=5, reference=planted)
    plan = phi._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate explode(sequence" not in plan
    pool = attribution.background_rows(planted, ["id"], 5, 42)
    scored = attribution._by_steps(model, rows.union(rows.filter("id < 2")), NAMES, ["id"], 3, 42, pool)
    want, got = ({} for _ in range(2))
    for out, df in ((want, scored), (got, phi)):
        for r in df.collect():
            out.setdefault((r.id, r.column), []).append(r.phi)
    assert len(got) == 60 * 4 and sorted(got) == sorted(want) and sum(abs(v[0]) > 1e-3 for v in got.values()) > 60
    for at, values in want.items():
        assert len(values) == len(got[at]) == (2 if at[0] < 2 else 1)
        assert got[at] == pytest.approx(values, abs=1e-9)

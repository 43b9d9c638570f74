"""What grows with a table is dealt out: stored frames, split means, codes of categories."""

from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom import session
from wattloom.operators import clean
from wattloom.operators.features import FeatureEncoder
from wattloom.plans import roles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_frame_is_cut_into_bounded_files(spark, monkeypatch):
    monkeypatch.setattr(session, "FILE_ROWS", 100)
    out = session.stored(spark.range(1000).coalesce(1).withColumn("x", F.col("id") * 2.0))
    assert {(r.id, r.x) for r in out.collect()} == {(i, 2.0 * i) for i in range(1000)}
    assert out.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0] <= 100


def test_rows_do_not_meet_by_split(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"),
                                      (F.col("id") + 1.0).alias(K.WEIGHT_COL))
        out = clean.normalised_weights(df)
        assert "SortMergeJoin" not in plan(out) and "BroadcastHashJoin" in plan(out)
        means = {r.split: r.m for r in out.groupBy("split").agg(F.avg("w").alias("m")).collect()}
        assert all(abs(m - 1) < 1e-9 for m in means.values()) and len(means) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_codes_are_looked_up_once(spark):
    rows = [(None, "b"), (1.0, "a"), (2.5, None), (2.5, "b")]
    df = spark.createDataFrame(rows, "x double, t string")
    model = FeatureEncoder(["x", "t"]).fit(df.filter("t is null or t <> 'a'"))
    out = model.transform(df)
    assert [tuple(r) for r in out.collect()] == [(1.0, 1.0), (-1.0, -1.0), (0.0, 0.0), (0.0, 1.0)]
    assert "CASE WHEN" not in plan(out)


def test_the_model_frame_is_stored_once(spark, tmp_path):
    _, df = roles.encoded_households(spark, "/root/testdata/sf0.001")
    assert "Scan ExistingRDD" not in plan(df) and "FileScan parquet" in plan(df)


def test_large_frames_are_fitted_one_by_one(monkeypatch):
    from wattloom.models import trees
    assert trees.fits_at_once(0, 4) == trees.fits_at_once(1000, 4) == 4
    assert trees.fits_at_once(trees.ROWS_AT_ONCE // 2, 4) == 2 and trees.fits_at_once(10 * trees.ROWS_AT_ONCE, 4) == 1


def _shuffled_only(spark, make):
    """The plan where nothing is broadcast that is not marked for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(make())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_do_not_meet_by_file(spark, tmp_path):
    from wattloom.operators import savings
    spark.range(300).repartition(3).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert "SortMergeJoin" not in _shuffled_only(spark, lambda: savings.positions(rows))
    assert sorted(r.position for r in savings.positions(rows).collect()) == list(range(300))


def test_rows_do_not_meet_by_driver_value(spark, monkeypatch):
    from wattloom.operators import savings
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("upgrade"), F.when(F.col("id") % 4 == 1, "a").otherwise(
        F.element_at(F.array(F.lit("a"), F.lit("b")), (F.floor(F.col("id") / 2) % 2 + 1).cast("int"))).alias("c"))

    def support():
        rows, keep = savings._support(df, [1], {1: ["c"]})
        return rows.withColumn("k", keep[1])
    assert "SortMergeJoin" not in _shuffled_only(spark, support)
    few = sorted(map(tuple, support().select("upgrade", "c", "k").collect()))
    monkeypatch.setattr(savings, "FEW_VALUES", 0)
    assert "SortMergeJoin" in _shuffled_only(spark, support)
    assert sorted(map(tuple, support().select("upgrade", "c", "k").collect())) == few


def test_an_id_is_shuffled_once(spark):
    from wattloom.operators import savings
    rows = [(0, "x"), (0, "x"), (0, None), (0, None), (1, "x"), (1, "y"), (None, "z"), (None, "z"), (2, "y"), (2, "y")]
    df = spark.createDataFrame(rows, "upgrade int, bldg_id string")
    out = savings.duplicate_buildings(df)
    assert {r.upgrade: r.n_duplicate_ids for r in out.collect()} == {0: 2, None: 1, 2: 1}
    assert "hashpartitioning(upgrade" not in plan(out) and out.schema["upgrade"].dataType == df.schema["upgrade"].dataType
    assert savings.duplicate_buildings(df.limit(0)).count() == 0


def test_the_teacher_frame_does_not_keep_the_source_splits(spark, monkeypatch):
    from wattloom.models import transfer
    from wattloom.models.trees import BoostSpec
    files = []
    real = transfer.stored
    monkeypatch.setattr(session, "FILE_ROWS", 1000)
    monkeypatch.setattr(transfer, "stored", lambda df: files.append(real(df)) or files[-1])
    base = roles.stock(spark, "/root/testdata/sf0.001").filter("upgrade = 0").coalesce(1)
    teacher = transfer.Teacher.fit(base, [K.SQFT_COL, "TYPEHUQ"], ["bldg_id"], BoostSpec(max_iter=2, depth=2))
    assert len(files[0].inputFiles()) > 1 and teacher.metrics["n_holdout"] > 0


def test_a_small_source_is_dealt_to_all_cores(spark):
    df = roles.model_households(spark, "/root/testdata/sf0.01")
    parts = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism // 2 and sum(r[1] for r in parts) == 60000


def test_large_sources_are_not_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(session, "FILE_ROWS", 10)
    df = spark.range(100 * spark.sparkContext.defaultParallelism)
    assert session.spread(df) is df


def test_leaf_sketches_are_not_sorted_by_group(spark):
    from wattloom.models.conserving import _together
    parts = _together([32] * 10 + [200, 5])
    assert [i for p in parts for i in p] == list(range(12))
    assert parts[:4] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]] and parts[4:] == [[10], [11]]

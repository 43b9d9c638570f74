"""No side of the neighbour search passes the driver."""

from pyspark.sql import functions as F

from wattloom.llm import topk


def test_no_join_of_the_search_is_broadcast(spark, monkeypatch):
    plans = []
    whole = topk.durable

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df)
    monkeypatch.setattr(topk, "durable", seen)
    rows = spark.range(600).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * 7 + i * i).cast("float")).alias("embedding"))
    out = topk.nearest_vectors(rows)
    assert out.count() == 60
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)

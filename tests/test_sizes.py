"""Tables that Spark sizes too low, as after an explode, are not broadcast."""

from pyspark.sql import functions as F

from terracover.operators.joins import radius_join


def test_a_radius_join_broadcasts_neither_side(spark):
    at = spark.range(20_000).select("id", (F.lit(40.0) + F.rand(1)).alias("lat"), (F.lit(-74.0) + F.rand(2)).alias("lon"))
    plan = radius_join(at, at.withColumnRenamed("id", "cid"), 70.0, ["id"], ["cid"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

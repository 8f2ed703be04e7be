"""Tables that Spark sizes too low, as after an explode, are not broadcast."""

from pyspark.sql import functions as F

from terracover.llm import simhash
from terracover.llm.common import stored


def test_cells_of_fingerprints_are_not_broadcast(spark):
    fps = stored(spark.range(20_000).select(F.xxhash64("id").alias("fp")), "fps")  # some 160 KB, of which 34 rows each are made
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

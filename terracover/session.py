"""Session builder with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "terracover", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; on a cluster leave master to spark-submit."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

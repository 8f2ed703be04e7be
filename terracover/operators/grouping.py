"""Dealing groups out for work that is heavy in compute and light in bytes, and orders over whole tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows partitioned by keys over a fixed number of partitions.

    Adaptive execution merges small partitions by their bytes; groups of a few megabytes that take seconds
    each would then share one task. An explicit number is left alone, and a groupBy on the same keys needs
    no further exchange.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def fresh(df: DataFrame, name: str) -> str:
    """The name of a working column that the frame does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """The same rows, worked out once and checkpointed to the shared folder that spark.checkpoint.dir names (in local mode, else a temporary one)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="terracover-"))
    return df.checkpoint()


#: Buckets of a whole-table order, at most, and how many bounds are looked through at once.
BUCKETS, STEP = 1024, 32


def bucketed(df: DataFrame, order: str) -> tuple[DataFrame, str]:
    """df with a bucket that rises with a column, and the bucket's name: what a window over the whole table is cut into.

    The bounds between buckets are values of the column, a bounded number chosen by their hash.
    """
    n = min(BUCKETS, 4 * df.sparkSession.sparkContext.defaultParallelism)
    sample = df.select(order).where(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order), order).limit(16 * n).collect()
    bounds = sorted(r[0] for r in sample)[16::16]
    name = fresh(df, "bucket")
    if not bounds:
        return df.withColumn(name, F.lit(0)), name
    upto = lambda values: F.coalesce(F.size(F.filter(values, lambda b: b <= F.col(order))), F.lit(0))
    whole = F.array(*map(F.lit, bounds))
    coarse = upto(F.array(*map(F.lit, bounds[STEP - 1 :: STEP]))) * STEP if len(bounds) >= STEP else F.lit(0)
    first = fresh(df, "first")
    return df.withColumn(first, coarse).withColumn(name, F.col(first) + upto(F.slice(whole, F.col(first) + 1, F.lit(STEP)))).drop(first), name


def _by_bucket(sizes: DataFrame, bucket: str, value: str, step, start) -> Column:
    """What step makes of the values of all buckets before a row's own, as a column.

    One value for each bucket comes to the driver.
    """
    of = {r[bucket]: r[value] for r in sizes.collect()}
    out = [start]
    for k in range(max(of, default=0)):
        out.append(step(out[-1], of[k]) if k in of else out[-1])
    return F.get(F.array(*map(F.lit, out)), F.col(bucket))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with the row number from 0 in the order of a column (nulls first): the row in its bucket, and the rows before that."""
    rows, bucket = bucketed(settled(df), order)  # it is read three times
    before = _by_bucket(rows.groupBy(bucket).count(), bucket, "count", lambda a, b: a + b, 0)
    row = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    return rows.withColumn(name, (row - 1).cast("long") + before).drop(bucket)


def highest_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the greatest value of all rows before, in the order of a column; null for the first."""
    rows, bucket = bucketed(settled(df), order)  # it is read three times
    tops = rows.groupBy(bucket).agg(F.max(value).alias("top"))
    before = _by_bucket(tops, bucket, "top", lambda a, b: b if a is None else a if b is None else max(a, b), None)
    own = F.max(value).over(Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.greatest(before, own)).drop(bucket)

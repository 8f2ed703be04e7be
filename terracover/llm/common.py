"""Helpers shared by the corpus operators: scratch tables, sampling, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracover.llm.files import resolve


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where the session names none, one of our own, in local mode only:
    on a cluster the executors would not see it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="terracover-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_FOLDERS: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the driver ends, or with `dropped`."""
    folder = f"{scratch_root(spark)}/terracover-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_ended, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def dropped(path: str) -> None:
    """Deletes a scratch folder that nothing reads any more; one that is not there is no error."""
    system, name = resolve(path)
    if system.get_file_info(name).type == FileType.Directory:
        system.delete_dir(name)


def _ended(folder: str) -> None:
    with contextlib.suppress(OSError):
        dropped(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name of a working column that the frame does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows planned for fewer tasks than cores dealt out evenly, so that Python work on them uses all cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_out_mod: int, held_out: int, fit_rows: int) -> DataFrame:
    """(doc_id, text, y): at most fit_rows labelled training rows, chosen by a hash of doc_id.

    Rows whose crc32(doc_id) mod held_out_mod equals held_out never enter. fit_rows is the documented
    bound of the fit; the ids are bounded before the texts are read, so only fit_rows texts are joined.
    """
    ids = (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), held_out_mod) != held_out))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.col("text").isNotNull())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u long, v long) as rows (node, root), root the least node.

    Alternating large-star and small-star contraction. Neighbours are never gathered: each star takes
    the minimum with a pre-aggregated groupBy, which is checkpointed, and one join of two plain exchanges,
    so that adaptive skew joins split a hub holding a third of the edges. Every round is checkpointed to the
    shared folder; rounds go on until one changes nothing. Nulls and loops are dropped; nodes without edges
    do not appear.
    """
    spark = edges.sparkSession
    scratch_root(spark)
    cur = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low, "u").select(F.col("v"), F.col("m")).where("v <> m").union(low.select(F.col("u").alias("v"), "m"))
        cur = small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        now = mark(cur)
        if tuple(now) == tuple(seen):
            break
        seen = now
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""The numbered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracover.llm import byte_bpe, divergence, embed_dedup, langid, media, packing, periodic, pii, quality, sentencepiece_bpe, simhash, toxicity, warc
from terracover.llm.common import spread, stored, table
from terracover.llm.oracles import ORACLES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_documents(spark, sf_dir))


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spread(table(spark, sf_dir, "pages")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_bpe.digest(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    groups = simhash.near_duplicates(docs, also=(F.col("source").cast("string").alias("source"),))
    return packing.packed_rows(stored(groups.select("doc_id", "words", "source", F.col("group").alias("cluster")), "lengths"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def planted(docs: DataFrame) -> DataFrame:
    """Texts whose id's crc32 is divisible by ten repeat a stretch of their words from some word on, by column expressions."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def bound(value, then):
        """then(value), value computed once."""
        return F.transform(F.array(value), then)[0]

    def places(x):
        n = F.size(x["w"]).cast("long")
        a = x["g"] % n
        return F.struct(x["w"].alias("w"), a.alias("a"), (F.floor((n - a) / (F.lit(3) + x["g"] % 8)) + 1).alias("p"))

    def rewritten(y):
        i = F.sequence(F.lit(0), F.size(y["w"]) - 1)
        return F.array_join(F.transform(i, lambda i: F.get(y["w"], F.when(i < y["a"], i).otherwise(y["a"] + (i - y["a"]) % y["p"]).cast("int"))), " ")

    text = bound(F.struct(words.alias("w"), g.alias("g")), lambda x: F.when(F.size(x["w"]) > 0, bound(places(x), rewritten)).otherwise(""))
    return docs.withColumn("text", F.when(crc % 10 == 0, text).otherwise(F.col("text")))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(planted(_documents(spark, sf_dir).select("doc_id", "text")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_langid, op3_embed_dedup, op4_warc, op5_sentencepiece, op6_quality, op7_media, op8_simhash, op9_packing, op10_toxicity, op11_periodic, op12_divergence, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""The corpus pipeline: language, toxicity, near-duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents that
it keeps (the last: their pieces, texts and token ids with their places in the packed sequences), all
columns of documents but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terracover.llm import langid, packing, pii, simhash, toxicity
from terracover.llm.common import stored, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others go."""
    return langid.identified(docs)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the others go."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def by_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.deduplicated(docs)


def by_privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.redacted(docs)


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, as text and token ids, with their sequence and place in it."""
    import public_tokenizers

    return packing.sequences(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("near_duplicates", by_duplicates),
    ("personal_data", by_privacy),
    ("packing", by_packing),
]

#: The stages' models and groupings are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs

"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from terracover.llm import embed_dedup, langid, media, packing, pii, quality, sentencepiece_bpe, simhash, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "the quick brown fox said hello " * 3000
ROWS = [
    (1, "hello world and the rest", "en", "a", 10, "x"), (2, None, "en", None, None, None), (3, "", None, "a", 0, "y"), (None, "bonjour le monde et les gens", "fr", "b", 5, None),
    (5, LONG, "en", "a", 1, "z"), (6, " \n\t ", "en", "c", 3, "z"), (1, "hello world and the rest", "en", "a", 10, "x"), (8, "123 456 !!", None, "b", 1, ""), (9, "é𝔘中\x00a", "fr", "b", 1, ""),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, None, None), (5, 1, 0), (6, 0, 1), (9, 0, 0), (None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with an extra column whose name some operator uses."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumn("fp", F.lit("mine")).withColumn("found", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("y", F.lit(9)).withColumn("text", F.lit("clash"))


DIGESTS = {
    "pii": lambda d, x: pii.digest(d),
    "langid": lambda d, x: langid.digest(d),
    "sentencepiece": lambda d, x: sentencepiece_bpe.digest(d, MODEL),
    "quality": lambda d, x: quality.digest(d, x),
    "media": lambda d, x: media.digest(d),
    "simhash": lambda d, x: simhash.digest(d),
    "toxicity": lambda d, x: toxicity.digest(d, x),
}


@pytest.mark.parametrize("name", DIGESTS)
def test_one_row_per_document(docs, labels, name):
    out = DIGESTS[name](docs, labels)
    got = out.collect()
    assert len(got) == len(ROWS)
    assert sorted((r.doc_id or 0) for r in got) == sorted((r[0] or 0) for r in ROWS)
    again = [tuple(r) for r in got if r.doc_id == 1]
    assert again[0] == again[1]


@pytest.mark.parametrize("name", DIGESTS)
def test_empty_tables(docs, labels, name):
    assert DIGESTS[name](docs.limit(0), labels.limit(0)).count() == 0
    assert DIGESTS[name](docs, labels.limit(0)).count() == len(ROWS)


def test_defined_results(docs, labels):
    lang = {r.doc_id: r for r in langid.digest(docs).collect()}
    assert all(lang[k].lang_pred == "und" and lang[k].score == 0 for k in (2, 3, 6, 8))
    sim = {r.doc_id: r for r in simhash.digest(docs).collect()}
    assert sim[2].fingerprint == sim[3].fingerprint == sim[6].fingerprint == "0" * 16 and sim[6].component_id == 2
    enc = {r.doc_id: r for r in sentencepiece_bpe.digest(docs, MODEL).collect()}
    assert enc[2].n_tokens == enc[3].n_tokens == 1
    med = {r.doc_id: r for r in media.digest(docs).collect()}
    assert med[2].n_bytes == 0 and med[2].payload_bytes == 192 and med[2].media_sha256 == med[3].media_sha256
    assert all(0 <= r.score <= 1 for r in toxicity.digest(docs, labels).collect() + quality.digest(docs, labels).collect())


def test_packing(docs):
    got = packing.packed(docs, capacity=2048).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert all(r.bin_id is None for r in got if r.doc_id in (2, 3, 6))
    assert sum(r.n_words for r in got if r.doc_id == 5) == len(LONG.split()) and max(r.n_words for r in got) <= 2048
    assert packing.packed(docs.limit(0)).count() == 0


def test_filters_keep_columns(docs, labels):
    for out in (langid.identified(docs), toxicity.clean(docs, toxicity.fit(docs, labels)), simhash.deduplicated(docs), pii.redacted(docs)):
        assert out.columns == docs.columns
    assert {r.doc_id for r in langid.identified(docs).collect()} <= {1, None, 5, 9}
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert kept.count(1) == 1 and kept.count(None) == 1 and 3 not in kept and 2 in kept


def test_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0]
    rows = [(1, a, 0), (2, b, 0), (3, a, 1), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 0.0], 0), (7, [float("nan"), 1.0, 0.0], 0), (8, a, None), (None, a, 0), (1, a, 0), (9, [1.0, 0.0], 0), (10, [], 0), (11, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).withColumn("e", F.lit(2))
    got = {}
    for r in embed_dedup.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(2, 1, True)] * 2 and got[2] == [(2, 1, False)]
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == [(0, None, True)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(3, "u", "x" * 100), (2, None, "x" * 100), (2, "v", "x" * 100), (5, "a\nb", None), (6, "", "y" * 99), (7, "", "y" * 99), (None, "n", "x" * 100), (8, "é", "𝔘\x00é" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("mine")).withColumn("digest", F.lit(0))
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == [(0, 100, "revisit", 2), (2, 100, "response", None), (2, 100, "response", None), (3, 100, "revisit", 2), (5, 0, "response", None), (6, 99, "response", None), (7, 99, "response", None), (8, 350, "response", None)]
    assert warc.round_trip(df.limit(0)).count() == 0

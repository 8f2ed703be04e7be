"""op5 and op7 as queries against plain versions; rows of one id in the deduplication; the pipeline on edge rows."""

import hashlib
import zlib

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F

from terracover.llm import media, simhash
from terracover.llm.common import scratch_path, table
from terracover.llm.queries import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_encoding_query_is_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries()["op5_sentencepiece"](spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = sp.encode(r.text or "", add_eos=True)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def plain_feature(data):
    """Mean, variance, histogram and hash by plain sums."""
    n, s, q = len(data), sum(data), sum(x * x for x in data)
    hist = [sum(x // 32 == k for x in data) for k in range(8)]
    rows = [data[k : k + 192] for k in range(0, n, 192)]
    cuts = [int(len(rows) * k / 8) for k in range(9)]
    cells = []
    for a, b in zip(cuts, cuts[1:]):
        for c in range(0, 192, 24):
            part = [x for r in rows[a : max(b, a + 1)] for x in r[c : c + 24]]
            cells.append(int(sum(part) / len(part) * 256))
    bits = "".join("1" if v * 64 > sum(cells) else "0" for v in cells)
    return f"mean={s * 10000 // n};var={(q * n - s * s) * 100 // (n * n)};hist={'-'.join(map(str, hist))};hash={int(bits, 2):016x}"


def test_media_query_by_plain_sums(spark):
    docs = table(spark, SF, "documents")
    folder = scratch_path(spark, "media-test")
    media.write_archives(docs, folder)
    stored = {r.doc_id: bytes(r.media) for r in media.read_archives(spark, folder).collect()}
    got = {r.doc_id: r for r in queries()["op7_media"](spark, SF).collect()}
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        g, m = got[r.doc_id], stored[r.doc_id]
        assert (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) and g.feature == plain_feature(p)
        # the stored form by hand: its samples, row by row, behind a filter byte of zero
        at = m.index(b"IDAT")
        size = int.from_bytes(m[at - 4 : at], "big")
        raw = zlib.decompress(m[at + 4 : at + 4 + size])
        assert b"".join(raw[k + 1 : k + 193] for k in range(0, len(raw), 193)) == p and not any(raw[::193])


def test_rows_of_one_id(spark):
    """Other texts of an id are told apart; of equal rows one stays; a copy's row never stands for its id's other text."""
    a, b, c = ("one two three four five six", "something else entirely in here now", "a third text of quite other words")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "q"), (7, c, "p"), (None, a, "n"), (None, "alone here with nobody", "n"), (9, None, "z"), (10, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("text_hash", F.lit(1))
    got = sorted(((r.doc_id, r.text, r.source) for r in simhash.deduplicated(docs).collect()), key=repr)
    assert got == sorted([(3, a, "x"), (5, b, "x"), (7, c, "p"), (None, a, "n"), (None, "alone here with nobody", "n"), (9, None, "z")], key=repr)


def test_pipeline_on_edge_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, columns that clash with the stages' own; and an empty table."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    text = docs.where("length(text) between 500 and 900 and lang is not null").orderBy("doc_id").first().text
    extra = [(None, text, "en", "a", 1), (900_001, None, None, None, None), (900_002, "", "en", "a", 0), (900_003, text + " mail me at someone@example.org today", "en", None, 3), (900_003, text + " mail me at someone@example.org today", "en", None, 3)]
    more = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for c in ("__score", "score", "found", "__found", "text_hash", "words", "ids", "key"):
        more = more.withColumn(c, F.lit("mine"))
    more.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "a" / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    kept = [r for r in out if r.doc_id == 900_003]
    assert len({(r.doc_id, r.piece) for r in kept}) == len(kept) and "someone@example.org" not in "".join(r.text for r in out)
    assert any(r.doc_id is None for r in out) and not any(r.doc_id in (900_001, 900_002) for r in out)
    assert all(r.n_tokens == len(r.ids) for r in out)
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0

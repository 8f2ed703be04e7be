"""Byte-level BPE against the library: code points of every class, hard texts, the whole query, edges."""

import hashlib
import random
import struct

import pytest
import tiktoken

from terracover.llm import byte_bpe
from terracover.llm.common import table
from terracover.llm.queries import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})


def test_texts(spark, library):
    """All code points between letters and digits, long runs, random mixtures."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join("a" + chr(c) + "1" for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]
    rnd = random.Random(13)
    texts += ["a" * 3000, "=" * 2000, "ab" * 1500, "the" * 300, "中文字符测试" * 60, "日本語テキスト" * 20, "".join(rnd.choice("abcXYZ0189+/") for _ in range(8000)), "  \n\n  x", "don't we'll I'VE 'sa", "\u3000x\u00a0\u00a0y"]
    bits = [" ", "\n", "'s", "the", "The", "ing", "é", "ß", "a", "qu", "1", "23", "!", "...", "中", "й", "\t", "  ", "Zx", "_", "😀"]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = byte_bpe.encoded(docs, PATH, PATTERN)
    got = {r.doc_id: list(r.ids) for r in both.collect()}
    assert all(got[k] == library.encode_ordinary(t) for k, t in enumerate(texts)) and len(got) == len(texts)
    back = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decoded(both, PATH).collect()}
    assert all(back[k] == t for k, t in enumerate(texts))


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_query_is_the_library(spark, library):
    docs = table(spark, SF, "documents").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op13_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(docs) and all(got[r.doc_id] == expected(library, r.text) for r in docs)


def test_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, "hello there", None), (4, "hello there", "y"), (4, "hello there", "y"), (5, "word " * 20_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "1 as split", "2 as words")
    got = sorted((tuple(r) for r in byte_bpe.digest(docs, PATH, PATTERN).collect()), key=repr)
    assert got == sorted([(k, *expected(library, t)) for k, t, _ in rows], key=repr)
    assert byte_bpe.digest(docs.limit(0), PATH, PATTERN).count() == 0
    assert byte_bpe.digest(docs.where("doc_id < 3"), PATH, PATTERN).count() == 2


def test_files_are_read_by_split(spark, library, tmp_path):
    """Several splits, some of nulls only, each with a dictionary of its own."""
    rows = [(k, None if k < 40 else f"text number {k} of {k % 7} words"[: 5 + k % 30]) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(12, "doc_id").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.digest(spark.read.parquet(str(tmp_path / "d")), PATH, PATTERN).collect()}
    assert got == {k: expected(library, t) for k, t in rows}

"""Packed sequences against a plain best-fit search over whole documents, and their texts and ids against the library."""

import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

from terracover.llm import packing
from terracover.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def replayed(rows, chosen, capacity):
    """Places every (length, doc_id, piece, source, cluster), longest first, in its chosen bin: each time that bin must be
    a tightest one without a conflict, or a new one where there is none. Returns the places."""
    bins, out = {}, {}
    for n, doc, piece, source, cluster in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        fit = {k: b for k, b in bins.items() if b["left"] >= n and (source is None or source not in b["s"]) and cluster not in b["c"]}
        k = chosen[doc, piece]
        if k in bins:
            assert k in fit and bins[k]["left"] == min(b["left"] for b in fit.values())
        else:
            assert not fit
            bins[k] = {"left": capacity, "s": set(), "c": set()}
        out[doc, piece] = capacity - bins[k]["left"]
        bins[k]["left"] -= n
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
    return out


@pytest.mark.parametrize("shard_rows", [60, 20_000])
def test_packed_is_a_plain_best_fit(spark, shard_rows):
    """Dealing, cutting, both conflicts and the bins' ids; a third of the rows have one source."""
    docs = table(spark, SF, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    named = docs.select("doc_id", (F.col("doc_id") % 7).alias("cluster")).where("doc_id % 2 = 0")
    got = packing.packed(docs, capacity=300, shard_rows=shard_rows, clusters=named).toPandas()
    text = {r.doc_id: r for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    rows = []
    for d, r in text.items():
        words = len((r.text or "").encode().split())
        rows += [(min(300, words - at), d, k, r.source, d % 7 if d % 2 == 0 else r.h) for k, at in enumerate(range(0, words, 300))]
    shards = max(1, -(-len(rows) // shard_rows))
    assert (shards > 1) == (shard_rows == 60)
    keyed = spark.createDataFrame([(r[1], r[4], r[2]) for r in rows], "doc_id long, cluster long, piece int")
    at = {(r.doc_id, r.piece): r.s for r in keyed.withColumn("s", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards))).collect()}
    packed = got[got["bin_id"].notna()]
    chosen = {(d, p): b for d, p, b in zip(packed["doc_id"], packed["piece"], packed["bin_id"])}
    place = {(d, p): b for d, p, b in zip(packed["doc_id"], packed["piece"], packed["place"])}
    assert chosen.keys() == at.keys()
    want = {}
    for s in range(shards):
        want |= replayed([r for r in rows if at[r[1], r[2]] == s], chosen, 300)
    assert place == want and {(d, p): n for d, p, n in zip(packed["doc_id"], packed["piece"], packed["n_words"])} == {(r[1], r[2]): r[0] for r in rows}
    of = {}
    assert all(of.setdefault(b, at[k]) == at[k] for k, b in chosen.items())  # no bin of two shards
    source, cluster = {(r[1], r[2]): r[3] for r in rows}, {(r[1], r[2]): r[4] for r in rows}
    for _, b in got[got["bin_id"].notna()].groupby("bin_id"):
        keys = list(zip(b["doc_id"], b["piece"]))
        for held in ([source[k] for k in keys if source[k] is not None], [cluster[k] for k in keys]):
            assert len(held) == len(set(held))


def test_sequences_hold_whole_texts(spark):
    long = "The river 河流穿过城市河流穿过城市 bends.\n\n  Twice  𝔘é " * 400
    rows = [(1, long, "a"), (2, None, "a"), (3, " \n ", "b"), (4, "河" * 9000, "c"), (None, "one two", None), (6, "short text\nof two lines", "b"), (6, "short text\nof two lines", "b"), (8, "\x00 x " + "𝕏" * 700, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("ids", F.lit("mine"))
    out = packing.sequences(docs, MODEL, capacity=256)
    got = out.toPandas()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for doc, text, _ in rows:
        own = got[got["doc_id"].isna() if doc is None else got["doc_id"] == doc].sort_values("piece", kind="stable")
        if not (text or "").split():
            assert own["bin_id"].isna().all() and len(own) == 1 and own["n_tokens"].iloc[0] == 0
            continue
        own = own.drop_duplicates("piece")
        ids = [i for x in own["ids"] for i in x]
        assert "".join(own["text"]) == text and ids == sp.encode(text, add_eos=True)
        assert own["n_words"].sum() == len(text.encode().split()) and own["first_word"].tolist() == (own["n_words"].cumsum() - own["n_words"]).tolist()
        assert (own["n_tokens"] == own["ids"].map(len)).all() and own["n_tokens"].max() <= 256
    fill = got[got["bin_id"].notna()].sort_values(["bin_id", "place"])
    for _, b in fill.groupby("bin_id"):
        assert b["n_tokens"].sum() <= 256 and b["place"].tolist() == (b["n_tokens"].cumsum() - b["n_tokens"]).tolist()
    assert len(got[got["doc_id"] == 6]) == 2 and got[got["doc_id"] == 6]["bin_id"].nunique() == 2
    whole = packing.assembled(out).toPandas().set_index("bin_id")
    for k, b in fill.groupby("bin_id"):
        assert list(whole.loc[k, "ids"]) == [i for x in b["ids"] for i in x] and [None if pd.isna(x) else int(x) for x in whole.loc[k, "doc_ids"]] == [None if pd.isna(x) else int(x) for x in b["doc_id"]]
    assert packing.sequences(docs.limit(0), MODEL).count() == 0


def test_unbroken_texts_are_not_remembered():
    """Words of thousands of characters outside the vocabulary: the library's ids, and no memory of them."""
    import random

    import sentencepiece

    from terracover.llm import sentencepiece_bpe

    path = public_tokenizers.path("piece_bpe_32k.model")
    rnd, sp, own = random.Random(4), sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Codec(path)
    texts = ["".join(chr(rnd.choice([rnd.randrange(0x4E00, 0x9FFF), rnd.randrange(0x1F300, 0x1F5FF), 0x7F, 0xE9])) for _ in range(3000)) for _ in range(20)] + ["a b", "é" * 5000, ""]
    assert own.encode(texts) == [sp.encode(t, add_eos=True) for t in texts]
    assert len(list(own.digests(texts))) == len(texts) and max(map(len, own.ids)) <= sentencepiece_bpe.LONGEST and own.ids.held < 10_000 and own.known.held < 10_000
    own.ids.held = sentencepiece_bpe.MEMORY + 1
    own.encode(["a b c"])
    assert len(own.ids) == 3

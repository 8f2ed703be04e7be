"""Operators against brute force, exact round trips and held-out labels on the small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from terracover.llm import embed_dedup, langid, media, packing, quality, sentencepiece_bpe, simhash, toxicity, warc
from terracover.llm.common import components, scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def union_find(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(299, i) for i in range(100, 150)] + [(i, i + 1) for i in range(60)]
    want = union_find(300, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: want[i] for a, b in pairs if a != b for i in (a, b)}


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("block", [4, 2048])
def test_simhash(spark, block):
    """block 4: every group is dealt out in pieces."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    near = [(10_000 + i, (rows[0].text + f" extra{i}" * (i % 3)), None, None, 0) for i in range(30)]
    docs = docs.union(spark.createDataFrame(near, docs.schema))
    rows = docs.collect()
    fp = [brute_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = union_find(len(fp), pairs)
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r.doc_id), r.doc_id)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, block=block).collect()}
    for i, r in enumerate(rows):
        assert got[r.doc_id].fp & (2**64 - 1) == fp[i] and got[r.doc_id].component_id == least[root[i]]


def test_simhash_random_neighbours(spark):
    """Every pair within three bits of random fingerprints is connected, whatever bits differ."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(200)]
    flips = [b ^ sum(1 << k for k in rng.sample(range(64), rng.choice((1, 2, 3, 4)))) for b in base]
    fps = list(dict.fromkeys(base + flips))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    at = {f: i for i, f in enumerate(signed)}
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert union_find(len(fps), [(at[e.u], at[e.v]) for e in edges]) == want


def test_long_text_is_chunked(monkeypatch):
    text = "A b\tC d e\x0b\x0cf " * 500
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == want == brute_fingerprint(text)


@pytest.mark.parametrize("block", [16, 2048])
def test_embeddings(spark, block):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = df.collect()
    rng = np.random.default_rng(2)
    extra = [(100_000 + i, (np.array(rows[i % 3].embedding) + rng.normal(0, 0.02, 64) * (i % 2)).tolist(), rows[i % 3].label) for i in range(60)]
    df = df.select("vec_id", "embedding", "label").union(spark.createDataFrame(extra, "vec_id long, embedding array<float>, label int"))
    rows = df.collect()
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, block=block, cell_rows=40).collect()}
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    root = union_find(len(rows), np.argwhere(hit).tolist())
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r.vec_id), r.vec_id)
    assert hit.any()
    for i, r in enumerate(rows):
        g = got[r.vec_id]
        assert (g.n_links, g.component_id, g.kept) == (int(hit[i].sum()), least[root[i]], least[root[i]] == r.vec_id)


def test_sentencepiece_is_exact(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "é", "中", "𝔘", "▁", "the", "ing", "x" * 50, " " * 40, "<0x41>", "\t", "　", "ffi", "0", "==", "\x00", "</s>", "日本", "́", "ß"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [" " * k for k in range(40)] + ["ab" * k for k in range(40)]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    codec = sentencepiece_bpe.Codec(MODEL)
    want = [[*x, 2] for x in sp.encode(texts)]
    assert codec.encode(texts) == want
    for (n, ids, back), w in zip(codec.digests(texts), want, strict=True):
        assert n == len(w) and ids == hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest()
        assert back == hashlib.sha256(sp.decode(w).encode()).hexdigest()
    broken = [[3 + b for b in data] for data in (b"\xff\xfe", b"\xe4\xb8", b"a\xf0\x9f\x98b", b"\xc3\xa9\xc3")]
    assert [codec.decode(x) for x in broken] == [sp.decode(x) for x in broken]


def test_media_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in media.digest(docs).collect()}
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_media_ranges_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, "text %d " % i * 50) for i in range(40)], "doc_id long, text string").coalesce(2)
    folder = scratch_path(spark, "media-test")
    media.write_archives(docs, folder)
    whole = {r.doc_id: bytes(r.media) for r in media.read_archives(spark, folder).collect()}
    cut = {r.doc_id: bytes(r.media) for r in media.read_archives(spark, folder, split=700).collect()}
    assert whole == cut and sorted(whole) == list(range(40))
    good = media.to_png(*media.payload("abc"))
    with pytest.raises(ValueError):
        media.from_png(good[:60] + bytes([good[60] ^ 1]) + good[61:])


def test_media_retries_a_member(monkeypatch):
    class Flaky:
        def __init__(self, data, bad):
            self.data, self.bad = data, bad

        def open_input_file(self, name):
            self.bad -= 1
            if self.bad >= 0:
                raise OSError("lost")
            return self

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read_at(self, n, at):
            return self.data[at : at + n]

    import tarfile

    png = media.to_png(*media.payload("abc"))
    info = tarfile.TarInfo("7.png")
    info.size = len(png)
    data = info.tobuf(tarfile.USTAR_FORMAT) + png
    reader = media.ArchiveReader({"path": "x"})
    assert reader._member(Flaky(data, 2), "f", 0, len(png)) == (7, png, 0, 3)
    with pytest.raises(RuntimeError):
        reader._member(Flaky(data, 3), "f", 0, len(png))


@pytest.mark.parametrize("split", [257, 1 << 20])
def test_warc_round_trip(spark, split):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = pages.collect()
    got = {r.page_id: r for r in warc.read(warc.write(pages, scratch_path(spark, "warc-test")), split).collect()}
    assert len(got) == len(rows)
    for r in rows:
        b = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())


def test_warc_ignores_false_magic(tmp_path):
    """Bytes that look like a member but do not inflate to a WARC header are passed over."""
    good = warc.member(warc.record("1", "u", "<p>x</p>", hashlib.sha256(b"<p>x</p>").hexdigest(), 8, None))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"\x1f\x8b\x08junk" + warc.member(b"no header at all") + good + b"\x1f\x8b" + good)
    found = list(warc.Range(str(path), 0, path.stat().st_size))
    assert [f["fields"]["WARC-Type"] for f in found] == ["response", "response"] and found[0]["sha256"] == hashlib.sha256(b"<p>x</p>").hexdigest()


def test_packing_matches_plain_search():
    import pandas as pd

    rng = random.Random(4)
    rows = pd.DataFrame([(i, 0, rng.randint(1, 60), 0, rng.choice("abcdefgh") if i % 9 else None, rng.randrange(60)) for i in range(400)], columns=["doc_id", "piece", "n_words", "first_word", "source", "cluster"])
    got = packing.pack(rows, 64)
    bins = []
    for r in got.itertuples():
        fit = [b for b in bins if b["left"] >= r.n_words and (r.source is None or r.source not in b["s"]) and r.cluster not in b["c"]]
        tight = min((b["left"] for b in fit), default=64)
        own = next((b for b in bins if b["id"] == r.bin), None)
        if own is None:
            assert not fit
            bins.append(own := {"id": r.bin, "left": 64, "s": set(), "c": set()})
        else:
            assert own in fit and own["left"] == tight
        assert r.place == 64 - own["left"]
        own["left"] -= r.n_words
        own["s"].add(r.source)
        own["c"].add(r.cluster)


def held_out(spark, out, column, target):
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    return out.join(labels, "doc_id").where("held_out").select(column, target).toPandas()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    lang = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang["lang"] == lang["lang_pred"]).mean() > 0.98
    q = held_out(spark, quality.digest(docs, labels), "predicted", "quality")
    assert (q["predicted"] == q["quality"]).mean() > 0.95
    t = held_out(spark, toxicity.digest(docs, labels), "predicted", "toxic")
    assert (t["predicted"] == t["toxic"]).mean() > 0.93 and t[t["toxic"] == 0]["predicted"].mean() < 0.03


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    sizes, move = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    bad = rng.normal(size=8)
    p, pair, z = quality.marginals(bad, move, sizes)
    at, want_p, want_pair, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in sizes:
        total, own, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(1 << n):
            y = [k >> i & 1 for i in range(n)]
            w = np.exp(sum(bad[at + i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            own += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w
        want_p += (own / total).tolist()
        want_pair += pairs / total
        want_z += np.log(total)
        at += n
    assert np.allclose(p, want_p) and np.allclose(pair, want_pair) and np.isclose(z, want_z)


def test_grammar():
    s = toxicity.Scorer({"idiot": 3.0, "réeux+": 3.0})
    score = lambda text: s.features(text)[0]
    assert score("nothing at all") == 0 and score("réeux alone") == 0 and score("a réeuxal word") > 0
    plain = score("what an idiot")
    assert score("you idiot") > plain and score("not an idiot") < plain and score("he said what an idiot") < score("he is an idiot")
    assert score("i will kill you") > 0 and score("i will kill time") == 0
    assert toxicity.Scorer({}).features(None) == [0.0] * 4

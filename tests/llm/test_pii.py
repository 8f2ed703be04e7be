"""PII spans against a plain re-based version, and the defined edge cases."""

import hashlib
import re

import pytest

from terracover.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "nothing here", "a@b.c_d@e.f", "a@b.c%%d@e.f..g@h.i", "x@y", "é𝔘 me@ex.org, 10.0.0.1", "1.2.3.4.5.6.7.8 999.1.1.1.1 0001.002.3.255 256.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111", "12345678901234567890 4222222222222", "+1 (377) 555-0271 +12 +1+234567890 +1 234 567 8901 2345 678",
    "a" * 5000 + " " + "b.c" * 4000 + "@d.e" + ".f" * 5000, "7" * 20000, "1-" * 9000, "und.34@mail7.example.com 79927398713 1 2 3 4 5 6 7 8 9 0 1 2 3",
    "a@b.1.2.3.4 +49 30 1234567 x@1.2.3.4", "+1" + " " * 3000 + "2", "Konto IBAN DE89 3704 0044 0532 0130 00 und GB82WEST12345698765432, DE89370400440532013001",
    "ssn 078-05-1120 and 078-05-1120", "0.0.0.0\n1.1.1.1 3782 822463 10005 6011000990139424",
]


def test_matches_plain_version(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("x", "x")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, t and t[:80], got[i].spans, joined[:200])
        for k in BASE:
            assert got[i][f"n_{k}"] == sum(x[3] == k for x in want)
    assert got[17].spans.count("iban") == 2 and got[18].n_ssn == 1


def test_corpus_matches_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.digest(df).collect():
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_redaction_and_edges(spark):
    rows = [(1, "mail a@b.co now", "en"), (None, None, None), (1, "mail a@b.co now", "en"), (2, "clean text", None), (3, "a@1.2.3.4 end", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    out = sorted((r.doc_id or 0, r.text, r.found) for r in pii.redacted(df).collect() if r.text)
    assert out == [(1, "mail [EMAIL] now", "en"), (1, "mail [EMAIL] now", "en"), (2, "clean text", None), (3, "[EMAIL] end", "x")]
    assert pii.redacted(df).columns == df.columns and pii.digest(df).count() == 5
    assert pii.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", pii.KINDS)
def test_kinds_have_settings(kind):
    assert kind in pii.PATTERNS and kind in pii.SCORES and kind in pii.CONTEXT


def test_random_strings_match_plain_version(spark):
    import random

    rng = random.Random(11)
    cards = ["4111111111111111", "79927398713", "6011000990139424", "4222222222222"]
    bits = [*"0123456789", " ", "-", "+", "(", ")", ".", "@", "a", "B", "%", "_", "\n", "é", "𝔘", "127.0.0.1", "a@b.c", "+1 234", "٣", *cards]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 45))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(df).collect():
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (texts[r.doc_id], joined, r.spans)

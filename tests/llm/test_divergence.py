"""Source divergence: tries, leaves and shares against plain counts; edges. The query is held by its SQL twin."""

import random
import re
from collections import Counter

import numpy as np

from terracover.llm import divergence

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, least, top=50):
    """The audit by plain integers: rows of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, TERM.findall(text.translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, t) for g, s, t in found if g == lang]
        docs = Counter(w for _, t in own for w in set(t))
        kept = {w for w, n in docs.items() if n >= least}
        count = {s: Counter() for s, _ in own}
        for s, t in own:
            count[s].update(w for w in t if w in kept)
        share = lambda c, w, kept=kept: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(count.values(), Counter())
        for s in count:
            pairs = [(-sum(abs(share(count[s], w) - share(count[o], w)) for w in kept), o.encode(), o) for o in count if o != s]
            terms = [(-(share(count[s], w) - share(whole, w)), w.encode(), w) for w in kept if count[s][w] and share(count[s], w) > share(whole, w)]
            out += [(lang, s, part, item, -v, k + 1) for part, xs in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for k, (v, _, item) in enumerate(xs)]
    return sorted(out)


def test_trie():
    rnd = random.Random(1)
    words = [bytes(rnd.choice(b"ab\xc3") for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    one, two = divergence.Trie(), divergence.Trie()
    for k, w in enumerate(words):
        (one if k % 2 else two).add(w, ("x", str(k % 3)), 2, 1)
    one.merge(two)
    got = list(one.walk())
    want = Counter((w, str(k % 3)) for k, w in enumerate(words))
    assert [t for t, _ in got] == sorted(set(words))
    assert {(t, g[1]): v for t, c in got for g, v in c.items()} == {k: [2 * n, n] for k, n in want.items()}


def test_shares_are_exact():
    counts = np.array([0, 1, 5, 10**9, 10**12, 4 * 10**15], np.int64)
    for total in (5, 7, 10**6 + 3, 10**12 + 39, 4 * 10**15 + 5):
        fit = counts[counts + 5 <= total]
        assert divergence.share(fit, total).tolist() == [1 + 10**9 * (c + 5) // total for c in fit.tolist()]


def test_audit_is_plain_counts(spark):
    rnd = random.Random(2)
    words = ["One", "two", "drei", "été", "ÉTÉ", "中文", "x", "Yy", "zz-zz", "q1r", "\x85nbsp", "tab\tend"]
    rows = [(rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "ß", None]), " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for _ in range(160)]
    rows += [("de", "only", "ein wort"), ("xx", "s", None), ("xx", "t", ""), ("yy", "s", "1 2 3")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as doc_id", "2 as n", "'t' as term").repartition(5)
    for least, leaves in ((5, 300_000), (5, 7), (1, 3)):
        got = divergence.audit(docs, least, top=4, leaves=leaves)
        assert got.columns == COLUMNS and sorted(tuple(r) for r in got.collect()) == plain(rows, least, top=4)
    assert divergence.audit(docs.limit(0)).count() == 0

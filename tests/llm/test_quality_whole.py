"""Texts of any number and length of lines score as the plain chain over all their lines does."""

import numpy as np
import pytest

from terracover.llm import quality


def plain_features(lines):
    """One row a line, by Python strings."""
    rows = []
    for x in lines:
        kinds = [quality._TABLE[c] for c in x]
        c = [kinds.count(k) for k in range(9)]
        words = [bytes(w) for w in x.translate(bytes(32 if quality._TABLE[i] == 1 else i for i in range(256))).split(b" ") if w]
        n, w = max(len(x), 1), max(len(words), 1)
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        letters = max(c[2] + c[3], 1)
        rows.append([np.log1p(len(x)) / 6, c[3] / letters, c[4] / n, c[8] / n, c[7] / n, c[6] / n, (len(x) - c[1]) / w / 10, same / w, 1 - len(set(words)) / w, bool(x) and kinds[-1] == 5, bool(x) and kinds[0] == 3, lines.count(x) > 1, len(words) < 4, 1])
    return np.array(rows, float)


def plain_mean(text, w, move):
    lines = (text or "").encode().split(b"\n")
    n = np.array([len(lines)])
    p, _, _ = quality.marginals(quality.with_neighbours(plain_features(lines), n) @ w, move, n)
    size = np.array([len(x) + 1 for x in lines])
    return (p * size).sum() / size.sum()


TEXTS = ["a b c\nhello hello World!\n\nA b c", "", None, "one line only", "x y\n" * 300 + "end.", "é|  1 2 3\n" * 30, "\n", " \t\nQ! q! Q!\n " + "ab ab cd " * 400 + "\nz", "w" * 3000 + " w w"]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 64, "LINES": 5, "SPAN": 7}, {"BLOCK": 17, "LINES": 1, "SPAN": 1}])
def test_blocks_change_nothing(monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(quality, k, v)
    monkeypatch.setattr(quality, "_POWERS", [])
    rng = np.random.default_rng(3)
    w, move = rng.normal(size=3 * quality.FEATURES) * 0.4, rng.normal(size=(2, 2))
    want = [plain_mean(t, w, move) for t in TEXTS]
    assert np.allclose(quality.mean_marginals(TEXTS, w, move), want, atol=1e-9)
    curve = np.array([-2.0, -0.5, 1.0])
    score = 1 / (1 + np.exp(-(quality.badness(np.array(want)) @ curve[:-1] + curve[-1])))
    assert np.allclose(quality.score_texts(TEXTS, (w, move, curve)), score, atol=1e-9)


def test_two_million_line_ends(spark):
    """Within bounded memory; measured in a process of its own."""
    import subprocess
    import sys

    code = "import resource, numpy as np\nfrom terracover.llm import quality as q\nq.mean_marginals(['a'], np.ones(42), np.ones((2, 2)))\na = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nq.mean_marginals(['\\n' * 2_000_000], np.ones(42), np.ones((2, 2)))\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 400


def test_long_documents_are_learned_from(spark):
    """Bad documents that all have thousands of lines: the fit still sees both kinds."""
    good = "The road runs along the river, and the town lies on its left bank.\nPeople meet there on market days.\n"
    docs = [(i, good * (1 + i % 3) + f"Number {i} ends here.") for i in range(60)] + [(100 + i, f"$$ {i} ||| 1234 !!\n" * 3000) for i in range(30)]
    labels = [(d, int(d < 100)) for d, _ in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in quality.digest(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got == dict(labels)

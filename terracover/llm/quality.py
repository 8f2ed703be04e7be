"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; the forward-
backward marginals, weighted by line length, aggregate into the document's badness, which a logistic
curve maps to the score. Features are counted with numpy over a block of lines at once.

Whole texts are read in blocks of about BLOCK bytes: what a text needs beyond a block is one score, one
length and one flag a line, and the messages between blocks of SPAN lines. A line is never cut: a line
longer than a block is counted piece by piece, into the same numbers.

The field (line weights, two-by-two transitions) and the curve are fitted on at most `fit_rows` labelled
training rows (chosen by a hash of the id). The field learns from at most `runs` evenly spaced runs of RUN
lines of each (every line takes the document's label), the curve from the badness of the whole documents.

Defined results: null and empty texts are one empty line; with no training rows of both kinds the score
is 0.5; repeated rows each appear; a null doc_id appears with held_out null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracover.llm.common import crc_mod, labelled_sample
from terracover.llm.toxicity import logistic

BLOCK, LINES, SPAN, RUN = 1 << 20, 1 << 16, 1 << 16, 64
#: Byte classes: 0 line end, 1 blank, 2 lower case and non-ASCII, 3 upper case, 4 digit, 5 sentence mark, 6 exclamation mark, 7 bar, 8 other symbol.
_CLASSES = 9
_TABLE = np.full(256, 8, np.uint8)
for _chars, _class in ((b"\n", 0), (b" \t\r\x0b\x0c", 1), (bytes(range(97, 123)) + bytes(range(128, 256)), 2), (bytes(range(65, 91)), 3), (b"0123456789", 4), (b".,;:?'\"()-", 5), (b"!", 6), (b"|", 7)):
    _TABLE[list(_chars)] = _class
FEATURES = 14
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for hashes of any stretch from prefix sums."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        up, down = np.full(max(n, BLOCK + 1), _BASE, np.uint64), np.full(max(n, BLOCK + 1), pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _POWERS[0]


def _sums(b: np.ndarray) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(len(b) + 1)[0][: len(b)])]


def _blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of a text (a line end at its end) in blocks of at most LINES whole lines, of BLOCK bytes or one line."""
    start = 0
    while start < len(data):
        stop = min(start + BLOCK, len(data))
        cut = np.flatnonzero(data[start:stop] == 10)
        while not len(cut):  # one line, as long as it is
            more = data[stop : stop + BLOCK]
            cut = np.flatnonzero(more == 10)[:1] + (stop - start)
            stop += len(more)
        end = start + int(cut[:LINES][-1]) + 1
        yield data[start:end]
        start = end


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, a line end after each, and how many lines each has."""
    parts = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.array([p.count(b"\n") for p in parts])


def _line_hashes(b: np.ndarray) -> np.ndarray:
    """One hash of each line of a block."""
    ends = np.flatnonzero(b == 10)
    starts = np.r_[0, ends[:-1] + 1]
    if len(b) <= 2 * BLOCK:
        sums = _sums(b)
        return (sums[ends] - sums[starts]) * _powers(len(b) + 1)[1][starts]
    total = 0  # one line of many pieces
    for at in range(0, len(b) - 1, BLOCK):
        piece = b[at : min(at + BLOCK, len(b) - 1)]
        total += int(_sums(piece)[-1]) * pow(_BASE, at, 1 << 64)
    return np.array([total % (1 << 64)], np.uint64)


def _again(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each line stands elsewhere in its text."""
    own = np.concatenate([_line_hashes(b) for b in _blocks(data)])
    own += np.repeat(np.arange(len(counts), dtype=np.uint64) * _MIX, counts)
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    out = np.zeros(len(own), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _counted(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """size, class counts, words, repeats, distinct words, last and first class of the lines of a block."""
    kind = _TABLE[b]
    ends = np.flatnonzero(b == 10)
    size = np.diff(np.r_[-1, ends]) - 1
    n = len(ends)
    line = np.repeat(np.arange(n), size + 1)
    c = np.bincount(line * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    gap = kind < 2
    first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    last = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    sums = _sums(b)
    word = (sums[last] - sums[first]) * _powers(len(b) + 1)[1][first]
    at = line[first]
    words = np.bincount(at, minlength=n)
    repeats = np.bincount(at[1:][(word[1:] == word[:-1]) & (at[1:] == at[:-1])], minlength=n)
    _, one = np.unique(word + at.astype(np.uint64) * _MIX, return_index=True)
    distinct = np.bincount(at[one], minlength=n)
    tail, head = np.where(size > 0, kind[np.maximum(ends - 1, 0)], 0), np.where(size > 0, kind[ends - size], 0)
    return size, c, words, repeats, distinct, tail, head


def _counted_long(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for one long line, piece by piece; a word that goes on in the next piece is hashed on."""
    b = b[:-1]
    c, words, repeats, seen = np.zeros(_CLASSES), 0, 0, np.zeros(0, np.uint64)
    before: int | None = None  # the last finished word
    open_, length = 0, 0  # hash and length of a word that the last piece ended in
    for at in range(0, len(b), BLOCK):
        piece = b[at : at + BLOCK]
        kind = _TABLE[piece]
        c += np.bincount(kind, minlength=_CLASSES)
        gap = kind < 2
        first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        last = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
        sums = _sums(piece)
        word = (sums[last] - sums[first]) * _powers(len(piece) + 1)[1][first]
        found = word.tolist()
        if length:
            if len(first) and first[0] == 0:
                found[0] = (open_ + found[0] * pow(_BASE, length, 1 << 64)) % (1 << 64)
            else:
                found.insert(0, open_)
        grown = length + int(last[0]) if length and len(first) and first[0] == 0 else int(last[0] - first[0]) if len(first) else 0
        open_, length = 0, 0
        if len(last) and last[-1] == len(piece) and at + BLOCK < len(b):
            open_, length = found.pop(), grown if len(first) == 1 else int(last[-1] - first[-1])
        done = np.array(found, np.uint64)
        words += len(done)
        repeats += int((np.diff(np.r_[np.array([before] if before is not None else [], np.uint64), done]) == 0).sum()) if len(done) else 0
        before = found[-1] if found else before
        seen = np.union1d(seen, done)
    c[0] = 1
    one = lambda x: np.array([x])
    return one(len(b)), c[None], one(words), one(repeats), one(len(seen)), _TABLE[b[-1:]], _TABLE[b[:1]]


def _features(b: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Features of the lines of a block, one row each."""
    size, c, words, repeats, distinct, tail, head = _counted(b) if len(b) <= 2 * BLOCK else _counted_long(b)
    full, letters, w = np.maximum(size, 1), np.maximum(c[:, 2] + c[:, 3], 1), np.maximum(words, 1)
    return np.stack(
        [
            np.log1p(size) / 6, c[:, 3] / letters, c[:, 4] / full, c[:, 8] / full, c[:, 7] / full, c[:, 6] / full, (size - c[:, 1]) / w / 10,
            repeats / w, 1 - distinct / w, tail == 5, head == 3, again, words < 4, np.ones(len(size)),
        ],
        axis=1,
    )


def _rows(data: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and lengths (line ends counted) of the texts' lines, block by block."""
    again, at = _again(data, counts), 0
    for b in _blocks(data):
        size = np.diff(np.r_[-1, np.flatnonzero(b == 10)])
        yield _features(b, again[at : at + len(size)]), size
        at += len(size)


def with_neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its document."""
    ends = np.cumsum(sizes)
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[ends - sizes] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def marginals(bad: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(bad) of each line, expected transitions, log of the partition functions' product.

    bad: score of the label bad per line (good scores 0); move[a, b]: score of label b after a. All
    documents go forward and backward together, longest first.
    """
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    long = sizes[order]
    u = np.stack([np.zeros_like(bad), bad], axis=1)
    live = [int(np.searchsorted(-long, -t, side="left")) for t in range(int(long[0]))]  # documents with more than t lines
    f, g = np.zeros_like(u), np.zeros_like(u)
    f[start] = u[start]
    for t in range(1, len(live)):
        at = start[: live[t]] + t
        f[at] = np.logaddexp(f[at - 1, :1] + move[0], f[at - 1, 1:] + move[1]) + u[at]
    for t in range(len(live) - 2, -1, -1):
        at = start[: live[t + 1]] + t
        nxt = g[at + 1] + u[at + 1]
        g[at] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
    both = f + g
    z = np.logaddexp(both[:, 0], both[:, 1])
    p = np.exp(both[:, 1] - z)
    inner = np.ones(len(bad), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    pair = np.exp(f[at - 1][:, :, None] + move + (u + g)[at][:, None, :] - z[at][:, None, None]).sum(axis=0)
    return p, pair, float(z[start].sum())


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Line weights and transitions of greatest penalised likelihood, by Adam; y: 1 for bad, per document."""
    label = np.repeat(y, sizes).astype(float)
    inner = np.ones(len(label), bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), 1)
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p, pair, _ = marginals(x @ w[:-4], w[-4:].reshape(2, 2), sizes)
        grad = np.r_[x.T @ (p - label), (pair - seen).ravel()] / len(label) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w[:-4], w[-4:].reshape(2, 2)


def _products(step: np.ndarray) -> np.ndarray:
    """Products of each row's matrices (rows, k, 2, 2), in order, each scaled to a largest entry of one."""
    out = step[:, 0]
    for k in range(1, step.shape[1]):
        out = out @ step[:, k]
        out = out / out.max(axis=(1, 2), keepdims=True)
    return out


def _forward(step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The messages (n, 2) after each of n matrices from a first message, each of sum one.

    The chain is cut into about sqrt(n) rows that go on together, once their first messages are known.
    """
    n = len(step)
    k = max(1, int(np.sqrt(n)))
    rows = -(-n // k)
    padded = np.concatenate([step, np.broadcast_to(np.eye(2), (rows * k - n, 2, 2))]).reshape(rows, k, 2, 2)
    at = np.empty((rows, 2))
    m = first
    for i, p in enumerate(_products(padded)):
        at[i] = m
        m = m @ p
        m = m / m.sum()
    out = np.empty((rows, k, 2))
    for j in range(k):
        at = (at[:, None] @ padded[:, j])[:, 0]
        at = at / at.sum(axis=1, keepdims=True)
        out[:, j] = at
    return out.reshape(-1, 2)[:n]


def chain_marginals(bad: np.ndarray, start: np.ndarray, move: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, P(bad)) of the lines of documents one after another, SPAN lines at a time, from the last.

    start: whether a line is a document's first; a message does not pass from one document to the next.
    Only one message for each span is kept.
    """

    def steps(a: int, z: int) -> np.ndarray:
        """What takes the message at line i - 1 to that at line i, for lines a to z."""
        e = np.exp(np.stack([np.zeros(z - a), bad[a:z]], axis=1) - np.maximum(bad[a:z], 0)[:, None])
        return np.where(start[a:z, None, None], 1.0, np.exp(move - move.max())) * e[:, None]

    spans = [(a, min(a + SPAN, len(bad))) for a in range(0, len(bad), SPAN)]
    into = [np.full(2, 0.5)]
    for a, z in spans[:-1]:
        into.append(_forward(steps(a, z), into[-1])[-1])
    back = np.full(2, 0.5)
    for (a, z), m in zip(reversed(spans), reversed(into), strict=True):
        own = steps(a, z)
        f = _forward(own, m)
        g = _forward(own[::-1].transpose(0, 2, 1), back)[::-1]  # g[i]: what comes to line i - 1 from line i on
        both = f * np.concatenate([g[1:], back[None]])
        yield a, both[:, 1] / both.sum(axis=1)
        back = g[0]


def badness(means: np.ndarray) -> np.ndarray:
    """The length-weighted mean of the marginals per document, as itself and as log odds."""
    clipped = np.clip(means, 1e-4, 1 - 1e-4)
    return np.stack([means, np.log(clipped / (1 - clipped))], axis=1)


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts one after another, of about BLOCK characters or a single one."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t or "") > BLOCK:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t or "") + 1
    if group:
        yield group


def mean_marginals(texts: list[str | None], w: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The length-weighted mean marginal of each text."""
    weights = w.reshape(3, FEATURES).T
    out = [np.zeros(0)]
    for group in _groups(texts):
        data, counts = _joined(group)
        parts = [((x @ weights).T, size) for x, size in _rows(data, counts)]
        (bad, before, after), size = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
        starts = np.cumsum(counts) - counts
        start = np.zeros(len(bad), bool)
        start[starts] = True
        bad[1:] += np.where(start[1:], 0, before[:-1])
        bad[:-1] += np.where(start[1:], 0, after[1:])
        total = np.zeros(len(counts))
        for a, p in chain_marginals(bad, start, move):
            doc = np.searchsorted(starts, np.arange(a, a + len(p)), "right") - 1
            total += np.bincount(doc, p * size[a : a + len(p)], len(counts))
        out.append(total / np.add.reduceat(size.astype(float), starts))
    return np.concatenate(out)


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def _runs(text: str | None, most: int | None) -> list[np.ndarray]:
    """At most `most` (None: all) evenly spaced runs of RUN lines of a text, each line with its neighbours' features."""
    x = np.concatenate([f.astype(np.float32) for f, _ in _rows(*_joined([text]))])
    x = with_neighbours(x, np.array([len(x)]))
    n = -(-len(x) // RUN)
    return [x[k * RUN : (k + 1) * RUN] for k in np.unique(np.linspace(0, n - 1, min(n, most or n)).astype(int)).tolist()]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 3000, runs: int | None = 6) -> Model | None:
    """The model, learned from at most fit_rows labelled rows; the line weights from at most `runs` runs of RUN lines of each (None: from all)."""
    sample = labelled_sample(docs, labels, "quality", 3, 1, fit_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, y, t in zip(b["doc_id"], b["y"], b["text"], strict=True):
                yield pd.DataFrame([(d, int(y), k, x.tobytes()) for k, x in enumerate(_runs(t, runs))], columns=["doc_id", "y", "k", "x"])

    got = sample.mapInPandas(run, "doc_id long, y int, k int, x binary").toPandas().sort_values(["doc_id", "y", "k", "x"])
    if not len(got) or got["y"].min() == got["y"].max():
        return None
    x = [np.frombuffer(b, np.float32).reshape(-1, 3 * FEATURES) for b in got["x"]]
    sizes = np.array([len(r) for r in x])
    w, move = train(np.concatenate(x).astype(float), sizes, 1 - got["y"].to_numpy())
    del x, got

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "mean": mean_marginals(list(b["text"]), w, move)})

    means = sample.mapInPandas(judged, "y int, mean double").toPandas().sort_values(["y", "mean"])
    return w, move, logistic(badness(means["mean"].to_numpy()), means["y"].to_numpy(float))


def score_texts(texts: list[str | None], model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    w, move, curve = model
    b = badness(mean_marginals(texts, w, move))
    return 1 / (1 + np.exp(-np.clip(b @ curve[:-1] + curve[-1], -30, 30)))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs and the column score; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(score_texts(list(b), shared.value), dtype=float)

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col("text").cast("string")))


def digest(docs: DataFrame, labels: DataFrame, fit_rows: int = 3000, runs: int | None = 6) -> DataFrame:
    """doc_id, held_out, score, predicted; fit_rows and runs bound the fit alone."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, fit_rows, runs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

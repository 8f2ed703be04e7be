"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls back to its longest
known character n-grams (5 down to 1, with word borders). The mean over the words, weighed as if by at
most EVIDENCE words, gives the posterior.

The model is fitted on at most `fit_rows` training documents (chosen by a hash of the id, over all
documents with a language) and holds all their words and n-grams that occur `least_count` times or more, so
that what is broadcast is bounded by the rows of the fit. Only `text` enters a prediction.

Defined results: null texts and texts without a letter are `und` with score 0; letters that the model
has never seen give equal scores and the first language in alphabetical order; with no training rows
all is `und`; rows with a null doc_id are predicted too (held_out null); repeated rows each appear.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracover.llm.common import crc_mod, stored

LONGEST, EVIDENCE = 5, 40
#: Scored words that a worker remembers before it starts anew.
MEMORY = 200_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _has_letter(found) -> bool:
    return any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w)


class Model:
    """Log frequencies, one value per language: words {word: values}, grams {gram: row of table}."""

    def __init__(self, langs: list[str], sizes: np.ndarray, names: list[str], counts: np.ndarray):
        """sizes: n-gram lengths, 0 for words; names and counts per language, row by row."""
        self.langs = langs
        self.words: dict[str, np.ndarray] = {}
        self.grams: dict[str, int] = {}
        tables = [np.zeros((0, len(langs)))]
        for n in range(LONGEST + 1):
            own = np.flatnonzero(sizes == n)
            if not len(own):
                continue
            logs = np.log(counts[own] + 0.5) - np.log(counts[own].sum(axis=0) + 0.5 * len(own))
            if n:
                at = len(self.grams)
                self.grams.update((names[k], at + i) for i, k in enumerate(own.tolist()))
                tables.append(logs)
            else:
                self.words = dict(zip((names[k] for k in own.tolist()), logs, strict=True))
        self.table = np.concatenate(tables)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Mean values of each word's longest known n-grams; zeros where not even a letter is known."""
        out = np.zeros((len(words), len(self.langs)))
        left, known = range(len(words)), self.grams
        for n in range(LONGEST, 0, -1):
            hits, starts, owners, rest = [], [], [], []
            for j in left:
                got = [known[g] for g in grams(words[j], n) if g in known]
                if got:
                    starts.append(len(hits))
                    owners.append(j)
                    hits += got
                else:
                    rest.append(j)
            if hits:
                size = np.diff([*starts, len(hits)])
                out[owners] = np.add.reduceat(self.table[hits], starts, axis=0) / size[:, None]
            left = rest
        return out


class Scorer:
    """Scores texts; remembers the rows of the words that it has met, within MEMORY."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.table = np.zeros((MEMORY, len(model.langs)))

    def _learn(self, words: list[str]) -> None:
        """Rows of words not met before."""
        at, m = len(self.ids), self.model
        fresh = [w for w in words if w not in self.ids]
        self.ids.update((w, at + i) for i, w in enumerate(fresh))
        known = [m.words.get(w) for w in fresh]
        self.table[[at + i for i, k in enumerate(known) if k is None]] = m.unseen([w for w, k in zip(fresh, known, strict=True) if k is None])
        for i, k in enumerate(known):
            if k is not None:
                self.table[at + i] = k

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = Counter(words(text or ""))
        if not self.model.langs or not _has_letter(found):
            return "und", 0.0
        total, n = np.zeros(len(self.model.langs)), sum(found.values())
        keys, counts = list(found), np.fromiter(found.values(), float, len(found))
        for at in range(0, len(keys), MEMORY // 4):  # the memory holds any part at once
            part = keys[at : at + MEMORY // 4]
            if len(self.ids) + len(part) > MEMORY:
                self.ids = {}
            rows = list(map(self.ids.get, part))
            if None in rows:
                self._learn(part)
                rows = list(map(self.ids.get, part))
            total += counts[at : at + len(part)] @ self.table[rows]
        z = total / n * min(n, EVIDENCE)
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, fit_rows: int = 4000, least_count: int = 3) -> Model:
    """Counts words and n-grams of the sampled training documents per language, as Spark aggregates."""
    train = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    ids = train.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).distinct()
    sample = train.join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 100):  # for bounded memory
                for lang, texts in b.iloc[at : at + 100].groupby("lang")["text"]:
                    own: Counter = Counter()
                    for t in texts:
                        own.update(words(t))
                    out: Counter = Counter()
                    for w, c in own.items():
                        out[0, w] += c
                        for n in range(1, LONGEST + 1):
                            for g in grams(w, n):
                                out[n, g] += c
                    yield pd.DataFrame([(lang, *k, c) for k, c in out.items()], columns=["lang", "n", "gram", "c"])

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, n int, gram string, c long")
    langs = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]  # of the sample only
    by = [F.sum(F.when(F.col("lang") == k, F.col("c")).otherwise(0)).alias(f"c{i}") for i, k in enumerate(langs)]
    rows = counts.groupBy("n", "gram").agg(F.sum("c").alias("all"), *by).where(F.col("all") >= least_count)
    rows = stored(rows, "langid-counts") if langs else rows
    kept = rows.toPandas().sort_values(["n", "gram"])
    return Model(langs, kept["n"].to_numpy(), kept["gram"].tolist(), kept[[f"c{i}" for i in range(len(langs))]].to_numpy(float))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for b in batches:
            yield pd.DataFrame([score(t) for t in b], columns=["lang_pred", "score"])

    seen = F.pandas_udf(run, "lang_pred string, score double")(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), seen.alias("x")).select("doc_id", "x.*")


def digest(docs: DataFrame, fit_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = predict(docs, fit(docs, fit_rows))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least_score: float = 0.5, fit_rows: int = 4000) -> DataFrame:
    """The documents, all columns, without those that are `und` or below least_score. One pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Scorer(shared.value)
        for b in batches:
            yield pd.Series([lang != "und" and p >= least_score for lang, p in map(score, b)], dtype=bool)

    return docs.where(F.pandas_udf(run, "boolean")(F.col("text").cast("string")))

"""Toxicity by a weighted finite-state pattern grammar.

Every clause runs through the composition of five small transducers over word classes: insult, threat,
target, negation and reported speech. The composed machine (a product of their states) gives each
matched insult or threat its weight under the tags that hold there: aimed at a target, negated, or
reported. Clause scores, not isolated words, enter the document's score.

Insult weights are log ratios of how often a word, or a word prefix that goes on in several words, occurs
in toxic and in clean training texts, counted by distinct neighbours so that copies of a text count once. They
and the five coefficients of the final logistic curve are fitted on at most `fit_rows` labelled training
rows (chosen by a hash of the id), which bound the terms that are broadcast.

Defined results: null, empty and wordless texts get the score of a text without a match; with no
training rows of both kinds the seed words alone decide; repeated rows each appear; a null doc_id
appears with held_out null; labels other than 0 and 1 are not learned from; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracover.llm.common import crc_mod, fresh, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Lengths of prefixes; contexts, words and G2 that a term needs to be learned; weight that it needs to count.
SHORTEST, LONGEST, LEAST_CONTEXTS, LEAST_WORDS, LEAST_G2, LEAST_WEIGHT = 3, 8, 4, 4, 24.0, 1.5
#: Classified words that a worker remembers before it starts anew.
MEMORY = 200_000

# The word classes of the grammar in the corpus's languages.
SEEDS = {"idiot": 3.0, "moron": 3.0, "imbecile": 3.0, "scum": 3.0, "stupid": 2.0, "loser": 2.0, "worthless": 2.0, "pathetic": 2.0, "disgusting": 2.0, "trash": 2.0, "dumb": 2.0, "bastard": 3.0}
TARGETS = frozenset("you your yours u he she they him her them du dich dir ihr euch sie tu te toi vous usted ustedes vosotros ti".split())
NEGATIONS = frozenset("not no never isn aren nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says called claimed wrote quoted reported quote sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
MODALS = frozenset("will gonna going shall werde wirst vais va voy".split())
VIOLENCE = frozenset("kill hurt destroy shoot stab beat murder töten schlagen tuer frapper matar golpear".split())

#: What a tag does to a match: negated and reported matches count less, aimed ones more; and a threat's weight.
NEGATED, REPORTED, AIMED, THREAT = 0.3, 0.5, 1.25, 5.0


class Transducer:
    """Deterministic transducer over word classes: step(state, class) gives (state, tag or None)."""

    def __init__(self, states: range, step):
        self.states = states
        self.arcs = {(s, c): step(s, c) for s in states for c in CLASSES}


CLASSES = ("other", "insult", "target", "negation", "report", "modal", "violence")


def _negation(s: int, c: str):
    """Three words of scope after a negation."""
    return (3, None) if c == "negation" else (max(s - 1, 0), "negated" if s and c in ("insult", "violence") else None)


def _report(s: int, c: str):
    """From a reporting word to the end of the clause."""
    return (1, None) if c == "report" or s else (0, None)


def _target(s: int, c: str):
    """A target before the match; one after it is seen at the clause's end. 1: target, 2: match, 3: both."""
    if c == "target":
        return s | 1, None
    return (s | 2, None) if c in ("insult", "violence") else (s, None)


def _insult(s: int, c: str):
    return 0, "insult" if c == "insult" else None


def _threat(s: int, c: str):
    """modal, then violence within four words, then a target within three."""
    if c == "modal":
        return 4, None
    if 1 <= s <= 4 and c == "violence":
        return 7, None
    if 5 <= s <= 7 and c == "target":
        return 0, "threat"
    return (s - 1 if s not in (0, 5) else 0), None


def compose(*machines: Transducer) -> dict:
    """The product of the machines, as far as it is reachable: (states, class) -> (states, tags)."""
    start = tuple(0 for _ in machines)
    arcs, todo = {}, [start]
    while todo:
        state = todo.pop()
        if (state, CLASSES[0]) in arcs:
            continue
        for c in CLASSES:
            steps = [m.arcs[s, c] for m, s in zip(machines, state, strict=True)]
            nxt = tuple(x[0] for x in steps)
            arcs[state, c] = nxt, frozenset(x[1] for x in steps if x[1])
            todo.append(nxt)
    return arcs


def grammar() -> dict:
    ranges = (range(4), range(2), range(4), range(1), range(8))
    return compose(*(Transducer(r, f) for r, f in zip(ranges, (_negation, _report, _target, _insult, _threat), strict=True)))


class Lexicon:
    """Weights of words and of continuing prefixes; a word's own weight goes before its longest prefix's."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.seen = terms, {}

    def weight(self, word: str) -> float:
        got = self.terms.get(word)
        for n in range(min(LONGEST, len(word) - 1), SHORTEST - 1, -1):
            if got is not None:
                break
            got = self.terms.get(word[:n] + "+")
        return got if got is not None and got >= LEAST_WEIGHT else 0.0

    def marked(self, found: set[str]) -> set[str]:
        """The words of a text that are insults or violence."""
        seen = self.seen
        if len(seen) > MEMORY:
            seen.clear()
        for w in found:
            if w not in seen:
                seen[w] = self.weight(w)
        return {w for w in found if seen[w] or w in VIOLENCE}


class Scorer:
    """Features of a text: clause scores through the composed grammar."""

    def __init__(self, terms: dict[str, float]):
        self.lexicon, self.arcs, self.start = Lexicon(terms), grammar(), (0, 0, 0, 0, 0)

    def _class(self, w: str) -> str:
        if self.lexicon.seen.get(w):
            return "insult"
        for name, members in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("modal", MODALS), ("violence", VIOLENCE)):
            if w in members:
                return name
        return "other"

    def clause(self, clause: list[str]) -> float:
        """The summed weight of the clause's matches."""
        state, score, aimed_later = self.start, 0.0, 0.0
        for w in clause:
            before = state
            state, tags = self.arcs[state, self._class(w)]
            weight = self.lexicon.seen.get(w, 0.0) if "insult" in tags else THREAT if "threat" in tags else 0.0
            if weight:
                weight *= (NEGATED if "negated" in tags else 1.0) * (REPORTED if before[1] else 1.0)
                score += weight * (AIMED if before[2] & 1 else 1.0)
                aimed_later += 0.0 if before[2] & 1 else weight * (AIMED - 1.0)
        return score + (aimed_later if state[2] == 3 else 0.0)

    def features(self, text: str | None) -> list[float]:
        """log of the clause scores' sum, log of matched clauses, highest clause, sum by square root of words."""
        low = (text or "").lower()
        found = WORD.findall(low)
        marked = self.lexicon.marked(set(found))
        if not marked:
            return [0.0, 0.0, 0.0, 0.0]
        scores = []
        for part in CLAUSE.split(low):
            ws = WORD.findall(part)
            if not marked.isdisjoint(ws):
                scores.append(self.clause(ws))
        total = sum(scores)
        return [math.log1p(total), math.log1p(sum(x > 0 for x in scores)), min(max(scores, default=0.0), 12.0), min(total / math.sqrt(len(found)), 6.0)]


def _contexts(sample: DataFrame, only: dict[str, float] | None = None) -> DataFrame:
    """(term, ctx, word): hashed neighbours of each word and continuing prefix; of the given terms only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["text"]:  # one document at a time, for bounded memory
                out = set()
                ws = WORD.findall(text.lower())
                for before, w, after in zip(["", *ws], ws, [*ws[1:], ""], strict=False):
                    terms = [w, *(w[:n] + "+" for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))]
                    if only is not None:
                        terms = [t for t in terms if t in only]
                    if terms:
                        ctx, word = xxhash.xxh64_intdigest(f"{before} {w} {after}") >> 1, xxhash.xxh32_intdigest(w)
                        out.update((t, ctx, word) for t in terms)
                yield pd.DataFrame(list(out), columns=["term", "ctx", "word"])

    return sample.select("text").mapInPandas(run, "term string, ctx long, word long")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.diag([l2] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000) -> tuple[dict[str, float], np.ndarray]:
    """The insult weights and the coefficients."""
    sample = labelled_sample(docs, labels, "toxic", 3, 1, fit_rows).select("doc_id", "text", "y").checkpoint()
    toxic = _contexts(sample.where("y = 1")).groupBy("term").agg(F.countDistinct("ctx").alias("t"), F.countDistinct("word").alias("w"))
    toxic = toxic.where((F.col("t") >= LEAST_CONTEXTS) & (~F.col("term").endswith("+") | (F.col("w") >= LEAST_WORDS)))
    toxic = {r["term"]: r["t"] for r in toxic.collect()}  # of the sample only
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.sum(F.regexp_count("text", F.lit(r"\p{L}+"))).alias("n")).collect()}
    terms = dict(SEEDS)
    if toxic and sizes.get(0) and sizes.get(1):
        clean = _contexts(sample.where("y = 0"), toxic).groupBy("term").agg(F.countDistinct("ctx").alias("c"))
        clean = {r["term"]: r["c"] for r in clean.collect()}  # of the terms in `toxic` only
        n1, n0 = sizes[1], sizes[0]
        learned = []
        for term, t in toxic.items():
            c = clean.get(term, 0)
            weight = math.log((t + 0.5) / n1) - math.log((c + 0.5) / n0)
            e1 = (t + c) * n1 / (n1 + n0)
            g2 = 2 * (t * math.log(t / e1) + (c * math.log(c / (t + c - e1)) if c else 0.0))
            if g2 >= LEAST_G2:
                learned.append((weight, term))
        terms |= {term: min(w, 6.0) for w, term in sorted(learned)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(terms)
        for b in batches:
            yield pd.DataFrame([(int(y), *score.features(t)) for y, t in zip(b["y"], b["text"], strict=True)], columns=["y", "a", "b", "c", "d"])

    got = sample.select("y", "text").mapInPandas(run, "y int, a double, b double, c double, d double").toPandas()
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return terms, np.array([2.0, 0.0, 0.0, 0.0, -3.0])
    return terms, _rising(got[["a", "b", "c", "d"]].to_numpy(), y)


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic fit without negative coefficients: more matches never lower a score."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1] + 1)
        w[np.r_[use, True]] = logistic(x[:, use], y)
        if (w[:-1] >= 0).all():
            return w
        use &= w[:-1] >= 0


def _probability(features: list[float], w: np.ndarray) -> float:
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(features, w[:-1]) + w[-1]))))))


def scored(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], name: str = "score") -> DataFrame:
    """docs and a column with the score of the whole text; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, w = shared.value
        score = Scorer(terms)
        for b in batches:
            yield pd.Series([_probability(score.features(t), w) for t in b], dtype=float)

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text").cast("string")))


def digest(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, fit_rows))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], least: float = 0.7) -> DataFrame:
    """The documents below `least`, all columns."""
    name = fresh(docs, "score")
    return scored(docs, model, name).where(F.col(name) < least).drop(name)

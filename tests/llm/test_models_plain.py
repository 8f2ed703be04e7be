"""op2 and op10 against plain versions of their models: fit and scores, document by document."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from terracover.llm import langid, toxicity
from terracover.llm.common import crc_mod, labelled_sample, table
from terracover.llm.queries import queries

SF = "/root/testdata/sf0.001"


def plain_language(train, texts, least_count=3):
    """Counts per language; a word's log frequencies, else the mean of its longest known n-grams' ones."""
    langs = sorted({lang for lang, _ in train})
    counts = [Counter() for _ in range(6)]
    for lang, text in train:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[0][w, lang] += 1
            for n in range(1, 6):
                b = f"<{w}>" if n > 1 else w
                for i in range(len(b) - n + 1):
                    counts[n][b[i : i + n], lang] += 1
    logs = []
    for c in counts:
        keys = sorted({k for k, _ in c})
        keys = [k for k in keys if sum(c[k, x] for x in langs) >= least_count]
        totals = [sum(c[k, x] for k in keys) + 0.5 * len(keys) for x in langs]
        logs.append({k: np.array([math.log(c[k, x] + 0.5) - math.log(t) for x, t in zip(langs, totals)]) for k in keys})

    def of(word):
        if word in logs[0]:
            return logs[0][word]
        for n in range(5, 0, -1):
            b = f"<{word}>" if n > 1 else word
            known = [logs[n][b[i : i + n]] for i in range(len(b) - n + 1) if b[i : i + n] in logs[n]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    out = []
    for text in texts:
        ws = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not any(c.isalpha() for w in ws for c in w):
            out.append(("und", 0.0))
            continue
        z = sum(map(of, ws)) / len(ws) * min(len(ws), 40)
        p = np.exp(z - z.max())
        out.append((langs[int(p.argmax())], float(p.max() / p.sum())))
    return out


def test_language_query_is_the_plain_model(spark):
    docs = table(spark, SF, "documents")
    rows = docs.withColumn("out", crc_mod(F.col("doc_id"), 4) == 2).collect()
    train = [(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and not r.out]
    assert len(train) < 4000  # all are in the fit
    want = {r.doc_id: x for r, x in zip(rows, plain_language(train, [r.text for r in rows]))}
    got = queries()["op2_langid"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6


def plain_clause(words, weight):
    """Matches by place: what stands before and after each, without any machine."""
    t, total, later = toxicity, 0.0, 0.0
    kind = lambda w: "insult" if weight(w) else next((k for k, m in (("target", t.TARGETS), ("negation", t.NEGATIONS), ("report", t.REPORTS), ("modal", t.MODALS), ("violence", t.VIOLENCE)) if w in m), "other")
    kinds = [kind(w) for w in words]
    found = [(i, weight(words[i])) for i, k in enumerate(kinds) if k == "insult"]
    modals = [i for i, k in enumerate(kinds) if k == "modal"]
    for m, nxt in zip(modals, [*modals[1:], len(words)]):
        v = next((i for i in range(m + 1, min(m + 5, nxt)) if kinds[i] == "violence"), None)
        hit = None if v is None else next((i for i in range(v + 1, min(v + 4, nxt)) if kinds[i] == "target"), None)
        if hit is not None:
            found.append((hit, t.THREAT))
    for i, w in found:
        if kinds[i] == "insult" and "negation" in kinds[max(0, i - 3) : i]:
            w *= t.NEGATED
        if "report" in kinds[:i]:
            w *= t.REPORTED
        aimed = "target" in kinds[:i]
        total += w * (t.AIMED if aimed else 1)
        later += 0 if aimed else w * (t.AIMED - 1)
    aimed_at_end = "target" in kinds and ("insult" in kinds or "violence" in kinds)
    return total + (later if aimed_at_end else 0)


def plain_score(text, terms, w):
    def weight(word):
        if word in terms:
            return terms[word] if terms[word] >= toxicity.LEAST_WEIGHT else 0
        best = next((terms[word[:n] + "+"] for n in range(min(8, len(word) - 1), 2, -1) if word[:n] + "+" in terms), 0)
        return best if best >= toxicity.LEAST_WEIGHT else 0

    low = (text or "").lower()
    clauses = [re.findall(r"[^\W\d_]+", c) for c in re.split(r"[.!?;:\n]+", low)]
    scores = [s for s in (plain_clause(c, weight) for c in clauses) if s > 0]
    n = sum(map(len, clauses))
    x = [math.log1p(sum(scores)), math.log1p(len(scores)), min(max(scores, default=0), 12), min(sum(scores) / math.sqrt(max(n, 1)), 6)]
    return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, w[:-1]) + w[-1])))))


def plain_terms(sample):
    """Log ratios of the terms by their distinct neighbourhoods in toxic and clean texts."""
    seen = {0: {}, 1: {}}
    sizes = {0: 0, 1: 0}
    for y, text in sample:
        sizes[y] += len(re.findall(r"[^\W\d_]+", text))
        ws = re.findall(r"[^\W\d_]+", text.lower())
        for a, w, b in zip(["", *ws], ws, [*ws[1:], ""]):
            for term in [w, *(w[:n] + "+" for n in range(3, min(8, len(w) - 1) + 1))]:
                seen[y].setdefault(term, (set(), set()))
                seen[y][term][0].add((a, w, b))
                seen[y][term][1].add(w)
    terms = {}
    for term, (ctx, words) in seen[1].items():
        t, c = len(ctx), len(seen[0].get(term, ((),))[0])
        if t < 4 or (term.endswith("+") and len(words) < 4):
            continue
        e = (t + c) * sizes[1] / (sizes[0] + sizes[1])
        if 2 * (t * math.log(t / e) + (c * math.log(c / (t + c - e)) if c else 0)) >= 24:
            terms[term] = min(math.log((t + 0.5) / sizes[1]) - math.log((c + 0.5) / sizes[0]), 6.0)
    return toxicity.SEEDS | terms


def test_toxicity_query_is_the_plain_model(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    sample = [(r.y, r.text) for r in labelled_sample(docs, labels, "toxic", 3, 1, 6000).collect()]
    terms, w = toxicity.fit(docs, labels)
    want = plain_terms(sample)
    assert terms.keys() == want.keys() and all(abs(terms[k] - want[k]) < 1e-9 for k in want)
    got = {r.doc_id: r for r in queries()["op10_toxicity"](spark, SF).collect()}
    for r in docs.collect():
        p = plain_score(r.text, want, w)
        assert abs(got[r.doc_id].score - p) < 1e-9 and got[r.doc_id].predicted == int(p >= 0.7)


def test_clauses_match_by_place():
    words = ["idiot", "you", "not", "said", "will", "kill", "a", "b", "scum", "they"]
    rng = np.random.default_rng(8)
    s = toxicity.Scorer(dict(toxicity.SEEDS))
    for _ in range(3000):
        clause = rng.choice(words, rng.integers(1, 14)).tolist()
        s.lexicon.marked(set(clause))
        assert abs(s.clause(clause) - plain_clause(clause, lambda w: toxicity.SEEDS.get(w, 0.0))) < 1e-9, clause

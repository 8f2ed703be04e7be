"""run() against the stages one by one, with plain versions of what each keeps."""

import corpus_pipeline
from terracover.llm import langid, pii, simhash, toxicity
from terracover.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "personal_data", "packing"]
    docs = table(spark, SF, "documents")
    score = langid.Scorer(langid.fit(docs))
    kept = {r.doc_id: r.text for r in docs.collect() if score(r.text)[0] != "und" and score(r.text)[1] >= 0.5}
    got = corpus_pipeline.by_language(spark, docs, SF)
    assert {r.doc_id: r.text for r in got.collect()} == kept and got.columns == docs.columns

    terms, w = toxicity.fit(got, table(spark, SF, "labels"))
    judge = toxicity.Scorer(terms)
    kept = {d: t for d, t in kept.items() if toxicity._probability(judge.features(t), w) < 0.7}
    got = corpus_pipeline.by_toxicity(spark, got, SF)
    assert {r.doc_id for r in got.collect()} == set(kept)

    fps = {d: simhash.fingerprint(t) for d, t in kept.items()}
    root = {d: d for d in sorted(fps)}
    for a in sorted(fps):
        for b in sorted(fps):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    kept = {d: t for d, t in kept.items() if root[d] == d}
    got = corpus_pipeline.by_duplicates(spark, got, SF)
    assert {r.doc_id for r in got.collect()} == set(kept)

    masked = corpus_pipeline.by_privacy(spark, got, SF)
    again = {r.doc_id: r.found for r in pii.find(masked).collect()}
    assert set(again) == set(kept) and not any(x.kind == "email" for f in again.values() for x in f)

    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(kept)
    fill = {}
    for r in out:
        if r.bin_id is not None:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_words
    assert max(fill.values()) <= 2048
    words = {r.doc_id: len(r.text.encode().split()) for r in masked.collect()}
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_words
    assert total == words

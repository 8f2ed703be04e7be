"""Near copies count as one duplicate cluster in op9_packing."""

from terracover.llm import packing, simhash
from terracover.llm.queries import queries


def test_near_copies_never_share_a_sequence(spark, tmp_path):
    words = [f"word{k}" for k in range(300)]
    rows = [(i, " ".join([*words[:50], f"changed{i}" if i else words[50], *words[51:]]), "en", f"s{i}", 1) for i in range(5)]
    rows += [(9, "another text of few words", "en", "s9", 1), (None, rows[0][1], "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert max(list(group.values()).count(c) for c in group.values()) > 1
    got = queries()["op9_packing"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    pairs = [(r.bin_id, group[r.doc_id]) for r in got if r.doc_id is not None]
    assert len(pairs) == len(set(pairs)) and len({b for b, _ in pairs}) < len(pairs)


def test_clusters_by_id(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c d", "y"), (3, "e f", "z"), (4, "e f", "w")], "doc_id long, text string, source string")
    named = spark.createDataFrame([(1, 7), (2, 7), (None, 1)], "doc_id long, cluster long")
    at = {r.doc_id: r.bin_id for r in packing.packed(docs, clusters=named).collect()}
    assert at[1] != at[2] and at[3] != at[4] and len(set(at.values())) == 2

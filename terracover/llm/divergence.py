"""Source divergence audit: which sources of a language use other words, and which words.

Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A partition counts its
terms in a byte radix trie whose leaves have counters (occurrences, documents) for each (lang, source),
kept in flat arrays. A trie of `leaves` terms is walked in byte order, which is the order of UTF-8, its
leaves are handed on and a new one begins, so memory is bounded. Leaves are merged by ranges of prefixes: a range's leaves arrive
in order, equal terms are summed and merge into a trie of their own, whose walk streams the terms that a
language keeps (those in at least `least_docs` of its documents).

A second walk over the kept terms has each language's totals beside them: each partition adds up the
distances of all pairs of the language's sources and keeps each group's `top` candidates, ties in the
order of the terms; sums and candidates are merged by Spark. The pairs of a language's sources are the
result itself; nothing else grows with their square.

Shares are p = 1 + floor(10^9 * (count + 5) / (N + 5 V)), computed exactly by long division.

Defined results: null lang, source and text are ''; a text without terms still makes its group occur;
repeated rows count each time; an empty table gives an empty result; doc_id and extra columns are
ignored; a language of one source has no pairs and, as its shares are the language's, no terms.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracover.llm.common import stored

#: Bytes of terms keep themselves, A-Z in lower case; all others are blanks.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
ONE, PRIOR = 10**9, 5

Group = tuple[str, str]


class Trie:
    """Byte radix trie; node: [edge label, children by first byte or None, value of the term that ends here or None].

    The root has a child for each prefix of HEAD bytes (a shorter term is its own), so that no step is spent on the first bytes.
    """

    HEAD = 3

    def __init__(self):
        self.heads: dict[bytes, list] = {}

    def node(self, term: bytes) -> list:
        """The node of a term, made where it is not there."""
        head = term[: self.HEAD]
        node = self.heads.get(head)
        if node is None:
            node = self.heads[head] = [head, None, None]
        at, end = len(head), len(term)
        while at < end:
            first = term[at]
            child = node[1].get(first) if node[1] is not None else None
            if child is None:
                child = [term[at:], None, None]
                if node[1] is None:
                    node[1] = {first: child}
                else:
                    node[1][first] = child
                return child
            label = child[0]
            k = len(label)
            if not term.startswith(label, at):
                k = 1
                while at + k < end and term[at + k] == label[k]:
                    k += 1
                child[0] = label[k:]
                child = [label[:k], {label[k]: child}, None]
                node[1][first] = child
            node, at = child, at + k
        return node

    def add(self, term: bytes, group: Group, n: int, docs: int) -> None:
        """Counts of a group at a term's leaf, which holds (lang, source) -> [occurrences, documents]."""
        node = self.node(term)
        if node[2] is None:
            node[2] = {}
        held = node[2].setdefault(group, [0, 0])
        held[0] += n
        held[1] += docs

    def merge(self, other: Trie) -> None:
        for term, counters in other.walk():
            for group, (n, docs) in counters.items():
                self.add(term, group, n, docs)

    def walk(self) -> Iterator[tuple[bytes, object]]:
        """Terms in byte order with their values."""
        stack = [(b"", self.heads[h]) for h in sorted(self.heads, reverse=True)]
        while stack:
            prefix, (label, children, value) = stack.pop()
            term = prefix + label
            if value is not None:
                yield term, value
            if children:
                stack += [(term, children[b]) for b in sorted(children, reverse=True)]


class Counts:
    """Counts of a partition's terms: a number for each term and group, occurrences and documents for each pair of them.

    The counters lie in flat arrays (group and term in one key, sorted); `leaves` walks the trie of the terms and
    has each leaf's counters in its order.
    """

    def __init__(self):
        self.terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.groups: defaultdict[Group, int] = defaultdict(count().__next__)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.bytes = 0
        _ = self.terms[b""]

    def add(self, groups: list[Group], texts: pa.StringArray) -> None:
        """Counts a block of texts: other bytes become blanks, and the terms between them are numbered by Arrow."""
        _, offsets, data = texts.buffers()
        blanked = pa.py_buffer(data.to_pybytes().translate(TERM_BYTES)) if data else data
        split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, blanked, offset=texts.offset))
        found = split.flatten().dictionary_encode()
        terms, before = found.dictionary.cast(pa.binary()), len(self.terms)
        numbers = np.fromiter(map(self.terms.__getitem__, terms.to_pylist()), np.int64, len(terms))
        self.bytes += int(pc.binary_length(terms).to_numpy()[numbers >= before].sum())
        ids = numbers[found.indices.to_numpy()]
        sizes = pc.list_value_length(split).to_numpy()
        own = np.array([self.groups[g] for g in groups], np.int64)
        pairs, n = np.unique(((np.repeat(np.arange(len(texts)), sizes) << 32) | ids)[ids > 0], return_counts=True)  # 0: nothing, before or after a blank
        keys = (own[pairs >> 32] << 32) | (pairs & 0xFFFFFFFF)
        self._hold(np.r_[keys, own << 32], np.r_[n, np.zeros(len(own), np.int64)], np.r_[np.ones(len(n), np.int64), np.zeros(len(own), np.int64)])

    def _hold(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.rows += len(part[0])
        if self.rows > 1 << 20 and self.rows > 2 * len(self.parts[0][0]):
            self._compact()

    def _compact(self) -> None:
        keys, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.parts = [(keys[at], np.add.reduceat(n[by], at), np.add.reduceat(docs[by], at))]
        self.rows = len(at)

    def leaves(self, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._compact()
        keys, n, docs = self.parts[0]
        gc.disable()  # else the collector goes over all nodes again and again
        try:
            trie = Trie()
            for term in sorted(self.terms):  # neighbours share their path
                trie.node(term)[2] = self.terms[term]
            order = np.fromiter((number for _, number in trie.walk()), np.int64, len(self.terms))
            del trie
        finally:
            gc.enable()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, group = keys & 0xFFFFFFFF, keys >> 32
        by = np.lexsort((group, place[term]))
        terms = pa.array(self.terms, pa.binary())
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for k in range(0, len(by), size):
            part = by[k : k + size]
            own = pa.array(group[part])
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[part])), langs.take(own), sources.take(own), pa.array(n[part]), pa.array(docs[part])], names=["term", "lang", "source", "n", "docs"])


def counted(docs: DataFrame, leaves: int = 300_000, block: int = 1 << 22) -> DataFrame:
    """(term binary, lang, source, n, docs): the leaves of each partition's tries. The empty term has a leaf of zeros for each group that occurs.

    A trie ends at `leaves` terms, or where its terms have 64 bytes for each of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for b in batches:
            groups = list(zip(b["lang"].to_pylist(), b["source"].to_pylist(), strict=True))
            ends = np.cumsum(pc.binary_length(b["text"]).to_numpy()) // block  # texts of a block are counted together
            for own in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(ends)) + 1) if b.num_rows else []:
                counts.add([groups[k] for k in own], b["text"].take(pa.array(own)))
                if len(counts.terms) >= leaves or counts.bytes >= 64 * leaves or counts.rows >= 8 * leaves:
                    yield from counts.leaves()
                    counts = Counts()
        yield from counts.leaves()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, "term binary, lang string, source string, n long, docs long")


def _summed(b: pa.RecordBatch, least_docs: int) -> tuple[list, ...]:
    """Columns of the leaves of a batch in order, equal ones summed; terms that begin and end in the batch below least_docs documents go."""

    def starts(*columns: str) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        new[:1] = True
        for c in columns:
            new[1:] |= pc.not_equal(b[c][1:], b[c][:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    terms, docs = starts("term"), b["docs"].to_numpy()
    whole = np.add.reduceat(docs, terms)
    alive = whole >= least_docs
    alive[[0, -1]] = True  # these may go on in other batches; the empty term is the first of all
    at = starts("term", "lang", "source")
    sums = [np.add.reduceat(b[c].to_numpy(), at) for c in ("n", "docs")]
    keep = np.repeat(alive, np.diff(np.searchsorted(at, np.r_[terms, b.num_rows])))
    first = b.select(["term", "lang", "source"]).take(pa.array(at[keep]))
    return *(c.to_pylist() for c in first.columns), *(x[keep].tolist() for x in sums)


def kept(leaves: DataFrame, least_docs: int = 30, block: int = 1 << 17) -> DataFrame:
    """(lang, term, sources, counts): each language's kept terms with the counts of the sources that have them, by ranges of prefixes.

    The empty term has each language's occurring sources, with zeros.
    """

    def emitted(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {"lang": [], "term": [], "sources": [], "counts": []}
        for term, counters in trie.walk():
            by_lang = defaultdict(list)
            for (lang, source), (n, d) in counters.items():
                by_lang[lang].append((source, n, d))
            for lang, own in by_lang.items():
                if not term or sum(d for _, _, d in own) >= least_docs:
                    for c, v in zip(rows, (lang, term.decode(), [s for s, _, _ in own], [n for _, n, _ in own]), strict=True):
                        rows[c].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, leaves = Trie(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            for term, lang, source, n, d in zip(*_summed(b, least_docs), strict=True):
                if term != last:
                    if leaves >= block:
                        yield from emitted(trie)
                        trie, leaves = Trie(), 0
                    last = term
                trie.add(term, (lang, source), n, d)
                leaves += 1
        yield from emitted(trie)

    ranged = leaves.repartitionByRange("term").sortWithinPartitions("term", "lang", "source")
    return ranged.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>")


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / total), exact for totals below 9 * 10^15."""
    out, rest = np.divmod(count.astype(np.int64) + PRIOR, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, leaves: int = 300_000) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; see the module."""
    terms = stored(kept(stored(counted(docs, leaves), "leaves"), least_docs), "kept-terms")
    flat = terms.select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n")))).toDF("lang", "term", "source", "n")
    by_group = flat.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count(F.when(F.col("term") != "", 1)).alias("v"))
    groups = by_group.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
    totals = stored(groups.join(sizes, "lang").select("lang", "v", F.col("g.source").alias("all_sources"), F.col("g.n").alias("all_n")), "totals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, dict] = {}
        for b in batches:
            for lang, rows in pd.Series(np.arange(b.num_rows)).groupby(b["lang"].to_pandas().to_numpy(), sort=False):
                if lang not in langs:
                    first = b.slice(int(rows.iloc[0]), 1).to_pylist()[0]
                    names, n = first["all_sources"], first["all_n"]
                    langs[lang] = {"names": names, "at": {s: k for k, s in enumerate(names)}, "dens": [x + PRIOR * first["v"] for x in n], "den": sum(n) + PRIOR * first["v"], "sums": np.zeros((len(names), len(names)), np.int64), "best": [([], []) for _ in names]}
                _more(langs[lang], b.take(pa.array(rows.to_numpy())), top)
        out: dict[str, list] = {"lang": [], "source": [], "part": [], "item": [], "value": []}
        for lang, x in langs.items():
            names = x["names"]
            i, j = np.nonzero(~np.eye(len(names), dtype=bool))
            rows = [(names[a], "pair", names[b], v) for a, b, v in zip(i.tolist(), j.tolist(), x["sums"][i, j].tolist(), strict=True)]
            rows += [(names[k], "term", t, v) for k, (vs, ts) in enumerate(x["best"]) for v, t in zip(vs, ts, strict=True)]
            out["lang"] += [lang] * len(rows)
            for c, v in zip(("source", "part", "item", "value"), zip(*rows, strict=True) if rows else [()] * 4, strict=True):
                out[c] += v
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64() if c == "value" else pa.string()) for c in out]))

    found = terms.where("term <> ''").join(totals, "lang").select("lang", "term", "sources", "counts", "v", "all_sources", "all_n").mapInArrow(run, "lang string, source string, part string, item string, value long")
    found = stored(found, "divergences")
    none = totals.select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item")).where("source <> item")
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").union(none.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    both = pairs.union(found.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def _more(x: dict, b: pa.RecordBatch, top: int) -> None:
    """Adds a batch of a language's terms to its sums of distances and its candidates."""
    names, at = x["names"], x["at"]
    size = pc.list_value_length(b["sources"]).to_numpy(zero_copy_only=False)
    counts = np.zeros((b.num_rows, len(names)), np.int64)
    counts[np.repeat(np.arange(b.num_rows), size), [at[s] for s in b["sources"].flatten().to_pylist()]] = b["counts"].flatten().to_numpy()
    p = np.column_stack([share(counts[:, k], den) for k, den in enumerate(x["dens"])])
    q = share(counts.sum(axis=1), x["den"])
    for k in range(len(names) - 1):
        d = np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(axis=0)
        x["sums"][k, k + 1 :] += d
        x["sums"][k + 1 :, k] += d
    texts = b["term"].to_pylist()
    for k in range(len(names)):
        more = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q))
        if not len(more):
            continue
        f = p[more, k] - q[more]
        if len(more) > top:  # all ties of the last place stay until terms decide
            more, f = (y[f >= np.partition(f, -top)[-top]] for y in (more, f))
        vs, ts = x["best"][k]
        both = sorted([*zip(vs, ts, strict=True), *zip(f.tolist(), [texts[m] for m in more], strict=True)], key=lambda y: (-y[0], y[1].encode()))[:top]
        x["best"][k] = ([v for v, _ in both], [t for _, t in both])

"""SimHash near-duplicate groups through a segment-popcount embedding.

Fingerprints: words of the text (runs of anything but ASCII white space, A-Z lower-cased), three-word
shingles with repeats, XXH64 (seed 42) of each; a bit is 1 if it is set in over half the hashes.

Linking (Hamming distance <= 3): each 32-bit half is mapped to the bit counts of its sixteen 2-bit
segments. The Manhattan distance of two such count vectors is a lower bound of the Hamming distance,
and of two halves one is within distance 1. So the grid range-join runs per half: a fingerprint is at
home in the grid cell of its count vector and probes the cells one step up in one coordinate. Pairs
met in a cell are verified exactly. Cells larger than `block` are dealt in block x block pieces, so no
task gathers a cell; a piece sends on only the links of a spanning forest, never all pairs.

Defined results: null and empty texts (no words) have fingerprint zero and link like any other; fewer
than three words are one shingle; repeated rows each appear; null doc_ids appear, but never name a
component unless the group has no other id (then component_id is null). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.llm.common import components, fresh, stored

#: Bytes of text that are split into words at once.
CHUNK = 1 << 22
SPACE = b" \t\n\x0b\x0c\r"


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, least bit first."""
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # up to 255 fit a byte
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def _word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """Words of the text in order; no word is cut."""
    start = 0
    while start < len(data):
        end = min(len(data), start + CHUNK)
        while end < len(data) and data[end : end + 1] not in SPACE:
            nxt = [p for p in (data.find(bytes([c]), end, end + CHUNK) for c in SPACE) if p >= 0]
            end = min(nxt) if nxt else min(len(data), end + CHUNK)
        yield data[start:end].split()
        start = end


def measured(text: str | None) -> tuple[int, int]:
    """The 64-bit fingerprint of a text, unsigned, and its number of words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    counts, n, total, tail = np.zeros(64, np.int64), 0, 0, []
    for words in _word_chunks(data):
        total += len(words)
        words = tail + words
        if len(words) >= 3:
            grams = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(words) - 2)
            counts += _bit_counts(hashes)
            n += len(hashes)
        tail = words[-2:]
    if not n and tail:
        counts, n = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], np.uint64)), 1
    bits = np.packbits(2 * counts > n, bitorder="little") if n else np.zeros(8, np.uint8)
    return int(bits.view(np.uint64)[0]), total


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    return measured(text)[0]


def fingerprints(docs: DataFrame, *also: Column) -> DataFrame:
    """(doc_id, fp, words, also...): one row per document, fp the fingerprint's bits as a long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = np.array([measured(t) for t in b], np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"fp": both[:, 0], "words": both[:, 1]})

    seen = F.pandas_udf(run, "fp long, words long")(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), seen.alias("__seen"), *also).select("doc_id", "__seen.*", *(F.col(c) for c in docs.select(*also).columns))


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, home, fp): the home cell and the probed cells of each half."""
    lanes = 0x55555555
    out = None
    for half in (0, 1):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        counts = bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(lanes))  # 2-bit lanes of bit counts
        key = F.col("key")
        steps = [F.when(F.shiftrightunsigned(key, 2 * i).bitwiseAND(F.lit(3)) < 2, key + F.lit(1 << (2 * i))) for i in range(16)]
        one = fps.select("fp", (counts + F.lit(half << 32)).alias("key")).select("fp", "key", F.explode(F.filter(F.array(key, *steps), lambda x: x.isNotNull())).alias("cell"))
        one = one.select("cell", (F.col("cell") == F.col("key")).alias("home"), "fp")
        out = one if out is None else out.union(one)
    return out


def _forest(batch: pd.DataFrame, bits: int) -> tuple[list[int], list[int]]:
    """Links within distance `bits` of rows sorted by block: a spanning forest of each block.

    Rows i and i + k are compared for growing k, all blocks at once, as long as a block has that many rows.
    """
    fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
    role = batch["role"].to_numpy(np.int8)
    keys = batch[["cell", "i", "j"]].to_numpy(np.int64)
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows of the block from here on
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    us, vs = [], []
    label, live = np.arange(n), np.arange(n)
    for k in range(1, int(sizes.max(initial=1))):
        live = live[left[live] > k]
        a, b = live, live + k
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= bits) & (label[a] != label[b])
        near &= ((role[a] & 1) & (role[b] >> 1) | (role[a] >> 1) & (role[b] & 1)) > 0
        if near.any():
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                rx, ry = find(x), find(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    us.append(x)
                    vs.append(y)
            label = parent.copy()
            while (label != parent[label]).any():
                label = parent[label]
    f = fp.view(np.int64)
    return f[us], f[vs]


def links(fps: DataFrame, bits: int = 3, block: int = 2048) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all pairs within `bits` (at most 3)."""
    assert 0 <= bits <= 3, "one half is within distance 1 only up to 3 bits"
    cells = _cells(fps)
    size = cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("h")).where("n > 1 and h > 0")
    # cells has 34 rows a fingerprint, which Spark does not see when it sizes a table: unasked it would broadcast all of them
    dealt = cells.join(size.hint("merge"), "cell").select(
        "cell", "home", "fp", F.ceil(F.col("n") / block).alias("nj"), F.ceil(F.col("h") / block).alias("ni"), F.xxhash64("fp").alias("x")
    )
    # role 1: row of a block, 2: column, 3: both, in cells that are one block
    own_i, own_j = F.expr("pmod(x, ni)").cast("int"), F.expr("pmod(x, nj)").cast("int")
    single = F.col("nj") == 1
    rows = F.when(F.col("home") & ~single, F.transform(F.sequence(F.lit(0), F.col("nj").cast("int") - 1), lambda j: F.struct(own_i.alias("i"), j.alias("j"), F.lit(1).alias("role"))))
    cols = F.when(~single, F.transform(F.sequence(F.lit(0), F.col("ni").cast("int") - 1), lambda i: F.struct(i.alias("i"), own_j.alias("j"), F.lit(2).alias("role"))))
    whole = F.when(single, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("home"), 3).otherwise(2).alias("role"))))
    none = F.expr("cast(array() as array<struct<i:int,j:int,role:int>>)")
    pieces = F.concat(*(F.coalesce(x, none) for x in (rows, cols, whole)))
    blocks = dealt.select("cell", "fp", F.inline(pieces)).select("cell", "i", "j", "fp", F.col("role").cast("byte").alias("role"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            last = b[["cell", "i", "j"]].iloc[-1].to_numpy()
            cut = int((b[["cell", "i", "j"]].to_numpy() != last).any(axis=1).nonzero()[0].max(initial=-1)) + 1
            held = b.iloc[cut:]
            if cut:
                u, v = _forest(b.iloc[:cut], bits)
                yield pd.DataFrame({"u": u, "v": v})
        if held is not None and len(held):
            u, v = _forest(held, bits)
            yield pd.DataFrame({"u": u, "v": v})

    return blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp").mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = 3, block: int = 2048, also: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, fp, words, component_id, group, also...): one row per document; component_id is the least doc_id of its group,
    group (a fingerprint of it) tells groups with one least doc_id apart."""
    marked = stored(fingerprints(docs, *also), "simhash")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = stored(least, "simhash-fps")
    roots = components(links(least.select("fp"), bits, block))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = named.join(groups, "root").select("fp", "component_id", "root")
    ids = least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("group"))
    ids = stored(ids, "simhash-ids")  # so that the last join is of two exchanges, and a common fingerprint is split
    return marked.join(ids, "fp").select("doc_id", "fp", "words", "component_id", "group", *marked.columns[3:])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group: the least doc_id; of several texts with that id the one of least hash, of equal ones the least row.

    All rows with a null doc_id stay, and do not stand for a group that has other ids.
    """
    name = fresh(docs, "text_hash")
    hashed = F.xxhash64(F.col("text").cast("string"))
    groups = near_duplicates(docs, also=(hashed.alias(name),)).where("doc_id is not null")
    kept = stored(groups.groupBy("group").agg(F.min(F.struct("doc_id", name)).alias("k"), F.count("*").alias("n")).select("k.*", "n"), "simhash-kept")
    out = docs.withColumn(name, hashed).join(kept.select("doc_id", name), ["doc_id", name], "left_semi")
    again = groups.join(kept.where("n > 1").select("doc_id", name), ["doc_id", name], "left_semi").groupBy("doc_id", name).count().where("count > 1").limit(1).count()
    if again:
        out = out.groupBy("doc_id", name).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return out.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))

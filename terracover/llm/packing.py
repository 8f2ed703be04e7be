"""Best-fit packing of documents into sequences under conflicts.

Every sequence (bin) holds at most `capacity` words (`packed`) or tokens (`sequences`, which returns the packed
texts and token ids), at most one document of a source and at most one of a duplicate cluster. Documents
longer than the capacity are cut into pieces, so none is dropped. They are dealt by a hash of the id into shards of about `shard_rows` pieces (their number grows with the
input, a hot source or cluster spreads over all), and each shard is packed longest first.

Bins stand in residual order and carry a bitmap of sources and one of duplicate clusters. The successor
search starts at the least residual that fits and goes on, over bins grouped by their source bitmap,
until the tightest compatible bin is found; otherwise a bin is opened. To find the places only ids,
lengths, sources and clusters are shuffled, never texts.

Defined results: documents without a word get one row with bin_id null; a null source or cluster
conflicts with nothing; repeated rows each get their places; a null doc_id is packed like any other;
ties go by doc_id (null last), then piece; extra columns are ignored; of several clusters named for one doc_id the
least counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.llm.common import stored
from terracover.llm.sentencepiece_bpe import Codec, codec

CAPACITY, SHARD_ROWS = 2048, 20_000
SCHEMA = "doc_id long, piece int, n_words int, first_word long, bin_id long, place int"


class Bins:
    """Open bins by residual; each residual's bins grouped by source bitmap."""

    def __init__(self, capacity: int):
        self.capacity, self.present, self.count = capacity, 0, 0
        self.by: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.clusters: list[int] = []

    def _take(self, need: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        """The tightest compatible bin: (residual, source bitmap, bin), taken out of its place."""
        rest = self.present >> need
        at = need
        while rest:
            skip = (rest & -rest).bit_length() - 1  # the successor among the residuals
            at += skip
            for bitmap, bins in self.by[at].items():
                if bitmap & source:
                    continue
                k = next((k for k, b in enumerate(bins) if not self.clusters[b] & cluster), None)
                if k is not None:
                    got = bins.pop(k)
                    if not bins:
                        del self.by[at][bitmap]
                        if not self.by[at]:
                            self.present &= ~(1 << at)
                    return at, bitmap, got
            rest >>= skip + 1
            at += 1
        return None

    def place(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, words before the new piece)."""
        found = self._take(need, source, cluster)
        if found is None:
            found = self.capacity, 0, self.count
            self.clusters.append(0)
            self.count += 1
        residual, bitmap, b = found
        self.clusters[b] |= cluster
        left = residual - need
        if left:
            self.by[left].setdefault(bitmap | source, []).append(b)
            self.present |= 1 << left
        return b, self.capacity - residual


def pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """bin and place of each row of one shard (doc_id, piece, n_words, source, cluster)."""
    rows = rows.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    sources = pd.factorize(rows["source"])[0]  # -1: null
    repeated = rows["cluster"].where(rows["cluster"].duplicated(keep=False))  # others cannot conflict
    clusters = pd.factorize(repeated)[0]
    bins = Bins(capacity)
    got = [bins.place(int(n), 1 << s if s >= 0 else 0, 1 << c if c >= 0 else 0) for n, s, c in zip(rows["n_words"], sources.tolist(), clusters.tolist(), strict=True)]
    return rows.assign(bin=[x[0] for x in got], place=[x[1] for x in got])


def _clustered(rows: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """rows with the cluster that clusters names for a doc_id, if any, in place of its own."""
    if clusters is None:
        return rows
    named = clusters.where("doc_id is not null and cluster is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("cluster").alias("__named"))
    joined = stored(rows, "own").join(named, "doc_id", "left")
    return joined.select(*(F.coalesce("__named", "cluster").alias("cluster") if c == "cluster" else c for c in rows.columns))


def _placed(pieces: DataFrame, capacity: int, shard_rows: int, keep: list[str], schema: str) -> DataFrame:
    """keep, bin_id and place of pieces (doc_id, piece, n_words, source, cluster, ...), shard by shard."""
    shards = max(1, -(-pieces.count() // shard_rows))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pack(rows, capacity)
        out["bin_id"] = key[0] * (1 << 32) + out["bin"]
        return out[[*keep, "bin_id", "place"]].astype({"doc_id": "Int64"} if "doc_id" in keep else {})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, schema)


def _own(docs: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("cluster")]


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, piece, n_words, first_word (of the piece in its document), bin_id, place (in its bin).

    clusters (doc_id, cluster long) names the documents' duplicate clusters; those that it does not name, and
    all without it, are in the cluster of their exact copies.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))
    return packed_rows(stored(_clustered(docs.select(*_own(docs), words.cast("long").alias("words")), clusters), "lengths"), capacity, shard_rows)


def packed_rows(narrow: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The same for documents that are measured already: doc_id, words, source, cluster (long)."""
    size = F.lit(capacity)
    pieces = narrow.where("words > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / size))).alias("p"))
    pieces = pieces.select("doc_id", F.col("p").cast("int").alias("piece"), F.least(size, F.col("words") - F.col("p") * size).cast("int").alias("n_words"), (F.col("p") * size).alias("first_word"), "source", "cluster")
    out = _placed(pieces, capacity, shard_rows, ["doc_id", "piece", "n_words", "first_word"], SCHEMA)
    none = narrow.where("words = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_words"), F.lit(0).cast("long").alias("first_word"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("place"))
    return out.unionByName(none)


# --- packed token sequences -----------------------------------------------------------------------

_START = re.compile(r"(?:^|(?<=[ \t\n\x0b\x0c\r]))[^ \t\n\x0b\x0c\r]")


def cut(text: str, words: list[str], ids: list[list[int]], own: Codec, room: int) -> list[tuple[str, list[int]]]:
    """The text in pieces of at most `room` ids each, between the tokenizer's words where they fit, else between characters.

    The words stand for the text one to one, with one mark before it.
    """
    if sum(map(len, ids)) <= room:
        return [(text, list(chain.from_iterable(ids)))]
    out: list[tuple[str, list[int]]] = []
    held: list[int] = []
    begun, at = 0, -1  # where the piece begins, and how far the text has gone

    def close() -> None:
        nonlocal held, begun
        out.append((text[begun : max(at, 0)], held))
        held, begun = [], max(at, 0)

    for word, new in zip(words, ids, strict=True):
        if held and len(held) + len(new) > room:
            close()
        end = at + len(word)
        while len(new) > room:
            k = room
            while k > 1 and 0x80 <= own.vocabulary.byte_of.get(new[k], 0) < 0xC0:  # inside of a character
                k -= 1
            held, at = new[:k], at + len(own.vocabulary.decode_word(new[:k]))
            close()
            new = new[k:]
        held.extend(new)
        at = end
    close()
    return out


_PIECES = "doc_id string, source string, cluster long, piece int, n_words int, first_word long, n_tokens int, text string, ids array<int>"
#: Texts that are cut at once, and rows that go back to Spark at once: workers that are reused keep what they once held.
TEXTS = 256


def _pieces(docs: DataFrame, model_path: str, capacity: int) -> DataFrame:
    """The pieces of each text with their ids; the end id closes the last. Texts without a word have one empty piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for whole in batches:
            for first in range(0, len(whole), TEXTS):
                b, rows = whole.iloc[first : first + TEXTS], []
                split = [own.words(t) if t and _START.search(t) else [] for t in b["text"]]
                made = own.ids_of(split)
                for doc, source, cluster, t, ws in zip(b["doc_id"], b["source"], b["cluster"], b["text"], split, strict=True):
                    got = cut(t, ws, [made[w] for w in ws], own, capacity - 1) if ws else [("", [])]
                    starts = np.fromiter((m.start() for m in _START.finditer(t or "")), np.int64)
                    at = seen = 0
                    for k, (piece, ids) in enumerate(got):
                        at += len(piece)
                        n = int(np.searchsorted(starts, at)) - seen
                        ids = [*ids, own.vocabulary.end] if ws and k == len(got) - 1 else ids
                        rows.append((doc, source, cluster, k, n, seen, len(ids), piece, np.array(ids, np.int32)))
                        seen += n
                yield pd.DataFrame(rows, columns=["doc_id", "source", "cluster", "piece", "n_words", "first_word", "n_tokens", "text", "ids"])
        own.ids.clear()

    cols = docs.select(*_own(docs), F.col("text").cast("string").alias("text")).withColumn("doc_id", F.col("doc_id").cast("string"))
    return cols.mapInPandas(run, _PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def sequences(docs: DataFrame, model_path: str, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, piece, n_words, first_word, n_tokens, bin_id, place (in tokens), text and ids of every piece.

    Lengths are tokens of the SentencePiece model with an end id after each document; a word counts where it
    begins; a document's pieces put together are its text. clusters as in `packed`.
    """
    made = _pieces(docs, model_path, capacity)
    made = stored(_clustered(made, clusters).withColumn("key", F.monotonically_increasing_id()), "tokens")
    narrow = made.where("n_tokens > 0").select("key", "doc_id", "piece", F.col("n_tokens").alias("n_words"), "source", "cluster")
    placed = _placed(narrow, capacity, shard_rows, ["key"], "key long, bin_id long, place int")
    return made.join(placed, "key", "left").select("doc_id", "piece", "n_words", "first_word", "n_tokens", "bin_id", "place", "text", "ids")


def assembled(pieces: DataFrame) -> DataFrame:
    """bin_id, doc_ids, ids, n_tokens: one row per sequence, its pieces (at most `capacity` tokens) in their places."""
    rows = pieces.where("bin_id is not null").groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "ids"))).alias("p"))
    out = rows.select("bin_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    return out.withColumn("n_tokens", F.size("ids"))

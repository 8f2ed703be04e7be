"""Byte-level BPE encoding and decoding by higher-order functions.

The words are the matches of the tokenizer's pattern. A word is an array of bytes (as pairs of hex
digits, so that a piece is a plain key); a fold merges, round by round, the neighbours of least rank
until none has one. Ranks come from a literal: an array of small maps, a key's map chosen by its crc32,
as a map is searched entry by entry. In long arrays a round merges all of the pair's occurrences at
once, unless a vocabulary piece of lower rank begins or ends with the merged piece; then, as in short
arrays, the leftmost alone. Long words are cut first between bytes that are neighbours in no piece.

Each distinct word of the corpus is folded once, wherever it occurs; its ids are then written for every split
of the input (a file's byte range that one task reads) that has the word, and the task that reads the split
again looks its words up in that split's dictionary alone. So no occurrence is shuffled, only each split's
distinct words, and a dictionary is bounded by its split. Decoding concatenates the pieces of the ids.

The pattern's letters and numbers are those of the tokenizer's library: code points that it counts and
the JVM, whose tables may be older, does not are added as ranges.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows each appear; a
null doc_id appears; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracover.llm.common import scratch_path, stored
from terracover.llm.files import resolve

#: Maps that a literal is dealt out to, and bytes from which a word is cut and merged many at once.
BUCKETS = 1 << 14
LONG = 32


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _dealt(entries: dict[str, object]) -> str:
    """JSON of the array of maps; a key lies in the map of its crc32."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for k, v in entries.items():
        maps[zlib.crc32(k.encode()) % BUCKETS][k] = v
    return json.dumps(maps, ensure_ascii=False, separators=(",", ":"))


def _found(maps: Column, key: Column) -> Column:
    """The value of a key, null where there is none."""
    return F.get(maps, F.crc32(key.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))[key]


@cache
def rank_maps(path: str) -> str:
    """Twice the rank of each piece in hex, plus one where a piece of lower rank begins or ends with it; '+' and two bytes: neighbours in a piece."""
    own = ranks(path)
    careful = set()
    for piece, rank in own.items():
        for k in range(1, len(piece)):
            careful.update(part for part in (piece[:k], piece[k:]) if own.get(part, -1) > rank)
    out: dict[str, int] = {p.hex().upper(): 2 * r + (p in careful) for p, r in own.items()}
    out |= {"+" + p[k : k + 2].hex().upper(): 1 for p in own for k in range(len(p) - 1)}
    return _dealt(out)


@cache
def piece_table(path: str) -> pa.BinaryArray:
    """The pieces by id."""
    own = {r: p for p, r in ranks(path).items()}
    return pa.array([own.get(i) for i in range(max(own) + 1)], pa.binary())


def _ranges(points: np.ndarray) -> str:
    cuts = np.flatnonzero(np.diff(points) > 1) + 1
    return "".join(rf"\x{{{p[0]:x}}}-\x{{{p[-1]:x}}}" for p in np.split(points, cuts) if len(p))


@cache
def _members(cls: str) -> np.ndarray:
    """Code points beyond ASCII of a class, as the tokenizer's library has it: with a rank for 'a' and a byte, they join an 'a' before them."""
    own = {bytes([b]): b for b in range(256)} | {bytes([0x61, b]): 256 + b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=rf"a{cls}|[\s\S]", mergeable_ranks=own, special_tokens={})
    found = []
    for start in range(0x80, 0x110000, 1 << 14):
        points = np.array([c for c in range(start, min(start + (1 << 14), 0x110000)) if not 0xD800 <= c < 0xE000], np.int64)
        ids = np.array(probe.encode_ordinary("".join(f"a{chr(c)}" for c in points.tolist())), np.int64)
        found.append(points[ids[(ids == 0x61) | (ids >= 256)] >= 256])
    return np.concatenate(found)


@cache
def java_pattern(pattern: str) -> str:
    """The pattern for the JVM: Unicode white space, and the library's letters and numbers that the JVM does not know."""
    spark = SparkSession.active()
    more = {}
    for k in "LN":
        known = F.lit("".join(map(chr, _members(rf"\p{{{k}}}").tolist())))
        lacking = spark.range(1).select(F.array_join(F.regexp_extract_all(known, F.lit(rf"\P{{{k}}}"), F.lit(0)), "")).first()[0]
        if lacking:
            more[k] = rf"[[\x{{80}}-\x{{10ffff}}]&&[{_ranges(np.array([ord(c) for c in lacking]))}]]"
    out, inside, at = [], False, 0
    while at < len(pattern):
        k = pattern[at + 3 : at + 4]
        if k in more and pattern.startswith(rf"\p{{{k}}}", at):
            out.append(rf"\p{{{k}}}{more[k]}" if inside else rf"[\p{{{k}}}{more[k]}]")
            at += 5
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at : at + 2] if pattern[at] == "\\" else pattern[at])
        at += len(out[-1])
    return "(?U)" + "".join(out)


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def _bound(value: Column, then) -> Column:
    """then(value), value computed once."""
    return F.transform(F.array(value), then)[0]


def _round(maps: Column, p: Column) -> Column:
    """One round of merges of the pieces: struct of the pieces and whether any pair was merged."""

    def merged(m: Column) -> Column:
        def at(k: Column) -> Column:
            return F.concat(F.slice(p, 1, k), F.array(F.concat(F.get(p, k), F.get(p, k + 1))), F.slice(p, k + 3, F.size(p)))

        def everywhere(k: Column) -> Column:
            # '<a><b>' becomes '<ab>', from the left
            old = F.concat(F.lit("<"), F.get(p, k), F.lit("><"), F.get(p, k + 1), F.lit(">"))
            new = F.concat(F.lit("<"), F.get(p, k), F.get(p, k + 1), F.lit(">"))
            return F.regexp_extract_all(F.replace(F.concat(F.lit("<"), F.array_join(p, "><"), F.lit(">")), old, new), F.lit("[0-9A-F]+"), F.lit(0))

        many = (F.size(p) > LONG) & (F.shiftright(m, 32).bitwiseAND(F.lit(1)) == 0)
        place = m.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.when(m.isNull(), F.struct(p.alias("p"), F.lit(False).alias("more"))).otherwise(
            F.struct(_bound(place, lambda k: F.when(many, everywhere(k)).otherwise(at(k))).alias("p"), F.lit(True).alias("more"))
        )

    pairs = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.concat(a, b))  # the last has no right side: null
    rated = F.transform(pairs, lambda x, i: F.shiftleft(_found(maps, x).cast("long"), 32).bitwiseOR(i.cast("long")))  # rank, then place
    return _bound(F.array_min(rated), merged)


def _folded(maps: Column, hexes: Column) -> Column:
    """Pieces of a stretch of bytes in hex, merged until no pair has a rank."""

    def fold(p: Column) -> Column:
        start = F.struct(p.alias("p"), F.lit(True).alias("more"))
        rounds = F.sequence(F.lit(1), F.size(p))
        return F.aggregate(rounds, start, lambda acc, _: F.when(acc["more"], _round(maps, acc["p"])).otherwise(acc), lambda acc: acc["p"])

    return _bound(F.regexp_extract_all(hexes, F.lit(".."), F.lit(0)), fold)


def _cut(maps: Column, hexes: Column) -> Column:
    """A long word's stretches, cut between bytes that are neighbours in no piece."""

    def joined(p: Column) -> Column:
        pairs = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.struct(a.alias("a"), F.concat(F.lit("+"), a, b).alias("pair")))
        return F.split(F.array_join(F.transform(pairs, lambda x: F.when(x["pair"].isNotNull() & _found(maps, x["pair"]).isNull(), F.concat(x["a"], F.lit(","))).otherwise(x["a"])), ""), ",")

    return _bound(F.regexp_extract_all(hexes, F.lit(".."), F.lit(0)), joined)


def word_ids(word: Column, path: str) -> Column:
    """Ids of a word: its own where it is a piece, else those of its folded bytes."""

    def of(x: Column) -> Column:
        hexes, maps = x["h"], x["maps"]
        pieces = F.when(F.length(hexes) > 2 * LONG, F.flatten(F.transform(_cut(maps, hexes), lambda h: _folded(maps, h)))).otherwise(_folded(maps, hexes))
        whole = F.shiftright(_found(maps, hexes), 1)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(pieces, lambda y: F.shiftright(_found(maps, y), 1)))

    maps = F.from_json(F.lit(rank_maps(path)), "array<map<string,int>>")  # a constant: parsed once, by the optimizer
    return _bound(F.struct(F.hex(word.cast("binary")).alias("h"), maps.alias("maps")), of)


def _split() -> Column:
    """The split that a row is read from; two splits of one hash would only share their dictionaries."""
    return F.xxhash64("_metadata.file_path", "_metadata.file_block_start")


def _on_files(docs: DataFrame) -> DataFrame:
    """The documents as rows of files; others, and those planned for fewer tasks than cores, are stored first."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    try:
        docs.select("_metadata.file_path")
        enough = docs.rdd.getNumPartitions() >= n
    except AnalysisException:
        enough = False
    return docs if enough else stored(docs.repartition(n), "documents")


def _distinct(split_words: DataFrame) -> DataFrame:
    """(split, word): each split's words once. A split is read by one task, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def emitted() -> Iterator[pa.RecordBatch]:
            words = pc.unique(pa.chunked_array(held, pa.string())) if held else []
            for k in range(0, len(words), 1 << 16):
                part = words[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), last, np.int64)), part], names=["split", "word"])

        for b in batches:
            splits = b["split"].to_numpy()
            for i, j in _runs(splits):
                if splits[i] != last:
                    yield from emitted()
                    last, held = int(splits[i]), []
                held.append(pc.unique(b["words"].slice(i, j - i).flatten()))
        yield from emitted()

    return split_words.mapInArrow(run, "split long, word string")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each stretch of equal keys."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True))


def _dictionaries(split_words: DataFrame, path: str) -> str:
    """Folds each distinct word once; the folder of each split's words and ids, as dictionaries split=hash."""
    folder = scratch_path(split_words.sparkSession, "dictionaries")
    own = _distinct(split_words.select("split", "words")).repartition("word")
    folded = own.groupBy("word").agg(F.collect_set("split").alias("splits")).select("word", "splits", word_ids(F.col("word"), path).alias("ids"))
    folded.select(F.explode("splits").alias("split"), "word", "ids").repartition("split").write.partitionBy("split").option("compression", "zstd").parquet(folder)
    return folder


def _looked_up(folder: str):
    """A function from a split and its words to their ids as bytes, four each; the last split's dictionary is kept."""
    held: dict[int, tuple] = {}

    def find(split: int, words: pa.StringArray) -> pa.BinaryArray:
        if not len(words):
            return pa.array([], pa.binary())  # its split may have no dictionary
        if split not in held:
            held.clear()
            system, name = resolve(f"{folder}/split={split}")
            own = pq.read_table(name, filesystem=system, columns=["word", "ids"], partitioning=None)
            ids = own["ids"].combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            flat = ids.flatten().cast(pa.int32())
            offsets = (ids.offsets.to_numpy() - ids.offsets[0].as_py()) * 4
            held[split] = own["word"].combine_chunks(), pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.to_numpy().astype("<u4").tobytes())])
        keys, values = held[split]
        at = pc.index_in(words, value_set=keys)
        if at.null_count:
            raise RuntimeError("a split was read otherwise the second time")
        return values.take(at)

    return find


def _encoded_batches(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the ids of their rows, and where each row's begin and end."""
    find = _looked_up(folder)
    for b in batches:
        splits = b["split"].to_numpy()
        for i, j in _runs(splits):
            part = b.slice(i, j - i)
            lists = part["words"]
            found = find(int(splits[i]), lists.flatten())
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
            ids = np.frombuffer(found.buffers()[2], "<u4") if len(found) and found.buffers()[2] else np.zeros(0, np.uint32)
            yield part, ids, ends[starts] // 4


def _words(docs: DataFrame, pattern: str, *keep: Column) -> DataFrame:
    return docs.select(*keep, _split().alias("split"), words_of(F.col("text"), pattern).alias("words"))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids (array of int) of each whole text, without special tokens."""
    docs = _on_files(docs)
    folder = _dictionaries(_words(docs, pattern), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, ends in _encoded_batches(folder, batches):
            lists = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(ids[ends[0] : ends[-1]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], lists], names=["doc_id", "ids"])

    return _words(docs, pattern, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, ids array<int>")


def pieces_of(ids: np.ndarray, path: str) -> tuple[pa.Buffer, np.ndarray]:
    """The pieces of ids, concatenated, and where each begins (and the last ends)."""
    found = piece_table(path).take(pa.array(ids.astype(np.int64)))
    return found.buffers()[2] or pa.py_buffer(b""), np.frombuffer(found.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)


def decoded(frame: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded binary): the pieces of `ids`, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["ids"]
            data, begins = pieces_of(lists.flatten().to_numpy(), path)
            ends = begins[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(ends)), data])], names=["doc_id", "decoded"])

    return frame.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as four bytes each, least first), decoded_sha256."""
    docs = _on_files(docs)
    folder = _dictionaries(_words(docs, pattern), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, ends in _encoded_batches(folder, batches):
            data, begins = pieces_of(ids, path)
            text, raw, at = memoryview(data), memoryview(ids).cast("B"), begins[ends].tolist()
            ends = ends.tolist()
            sha = lambda view: hashlib.sha256(view).hexdigest()
            columns = [[b - a for a, b in pairwise(ends)], [sha(raw[4 * a : 4 * b]) for a, b in pairwise(ends)], [sha(text[a:b]) for a, b in pairwise(at)]]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _words(docs, pattern, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no merge can cross: before a run of word marks that follows another character (the
vocabulary is checked to have no piece with a mark after another character). Equal words of a block are
encoded once. All of them lie in one flat symbol array; a round looks up the rank of every neighbouring
pair, takes the least rank per word, merges its leftmost non-overlapping occurrences in all words at
once and compacts, until no pair remains. Where a merge's result has a pair of equal or better rank in
the vocabulary (runs of blanks, for one), only the word's first occurrence is merged in that round,
which keeps the order of the sequential algorithm. Symbols outside the vocabulary fall back to bytes.

The model must normalise by identity, add a leading blank and keep extra blanks, as this one does.

Defined results: null and empty texts are the end id alone and decode to the empty text; repeated rows
each appear; a null doc_id appears; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from itertools import pairwise

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of text per block, and longest chain of words that is encoded at once.
BLOCK = 1 << 20
#: Characters of words and their values that a worker remembers before it starts anew (each word counts OVERHEAD more), and of the longest word remembered.
MEMORY, OVERHEAD, LONGEST = 1 << 27, 256, 64
NO_RANK = np.int32(2**31 - 1)


class Vocabulary:
    """Symbols, pair ranks and byte ids of a model file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if sp.normalize(" a  ﬁ") != f"{MARK}{MARK}a{MARK}{MARK}ﬁ":
            raise ValueError("the model normalises by more than identity with a leading blank")
        self.end, self.size = sp.eos_id(), n
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece has a word mark after another character")
        self.text = {i: p for p, i in self.pieces.items()}
        self.bytes = np.full(256, -1, np.int64)
        self.byte_of = {}
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes[value] = i
                self.byte_of[i] = value
        self.raw = {i: p.replace(MARK, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for i, b in self.byte_of.items()}
        # symbols: the pieces' ids, then characters that occur in pieces only, then (at run time) any other
        self.symbols = dict(self.pieces)
        for p in self.pieces:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols))
        scores = np.array([sp.get_score(i) for i in range(n)], np.float32)
        order = {s: r for r, s in enumerate(sorted({float(scores[i]) for i in plain}, reverse=True))}
        keys, ranks, made = [], [], []
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    ranks.append(order[float(scores[i])])
                    made.append(i)
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[at], np.array(ranks, np.int32)[at], np.array(made, np.int64)[at]
        # pieces that take part in a pair ranked no worse than the piece itself: merged one at a time
        own = np.zeros(n + len(self.symbols) + 1, np.int64) - 1
        for p, i in self.pieces.items():
            own[i] = order[float(scores[i])]
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.careful = np.zeros(len(own), bool)
        for side in (left, right):
            self.careful[side[self.ranks <= own[side]]] = True
        self.other = len(own) - 1  # any character outside the vocabulary

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NO_RANK where the vocabulary has none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), np.where(hit, self.made[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by merge rounds over all words at once."""
        chars = "".join(words)
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, where = np.unique(codes, return_inverse=True)
        sym = np.array([self.symbols.get(chr(c), self.other) for c in kinds], np.int64)[where]
        width = np.ones(len(sym), np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        origin = np.cumsum(width) - 1  # first character of each symbol
        rank, made = self.pair(sym[:-1], sym[1:])
        rank = np.where(word[:-1] == word[1:], rank, NO_RANK)
        while len(sym) > 1:
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(np.r_[rank, NO_RANK], start)
            size = np.diff(np.r_[start, len(sym)])
            open_ = np.repeat(least < NO_RANK, size)
            if not open_.all():
                done.append((word[~open_], origin[~open_], sym[~open_]))
                keep = np.flatnonzero(open_)
                if not len(keep):
                    sym = sym[:0]
                    break
                rank, made = np.r_[rank, NO_RANK][keep][:-1], np.r_[made, -1][keep][:-1]
                sym, word, origin = sym[keep], word[keep], origin[keep]
                least, size = least[least < NO_RANK], size[least < NO_RANK]
                start = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(least, size)[:-1])
            # of a chain of neighbouring hits every second one; of careful results the word's first only
            run = np.r_[True, hit[1:] != hit[:-1] + 1]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[((np.arange(len(hit)) - begin) % 2 == 0) & (first | ~self.careful[made[hit]])]
            sym = sym.copy()
            sym[hit] = made[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            keep = np.flatnonzero(stay)
            place = np.cumsum(stay) - 1
            sym, word, origin = sym[keep], word[keep], origin[keep]
            rank, made = np.r_[rank, NO_RANK][keep][:-1], np.r_[made, -1][keep][:-1]
            new = place[hit]
            fresh = np.unique(np.r_[new[new > 0] - 1, new[new < len(sym) - 1]])
            if len(fresh):
                r, m = self.pair(sym[fresh], sym[fresh + 1])
                rank[fresh] = np.where(word[fresh] == word[fresh + 1], r, NO_RANK)
                made[fresh] = m
        if len(sym):
            done.append((word, origin, sym))
        word, origin, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(origin, kind="stable")
        word, origin, sym = word[order], origin[order], sym[order]
        return self._ids(word, origin, sym, codes, len(words))

    def _ids(self, word, origin, sym, codes, n: int) -> list[list[int]]:
        """Ids of each word out of its final symbols; a symbol outside the vocabulary is its character's bytes."""
        known = sym < self.size
        code = codes[origin].astype(np.int64)
        wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        size = np.where(known, 1, wide)
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[first[known]] = sym[known]
        for w in np.unique(wide[~known]).tolist():
            at = np.flatnonzero(~known & (wide == w))
            lead = (0, 0, 0xC0, 0xE0, 0xF0)[w]
            out[first[at]] = self.bytes[(code[at] >> 6 * (w - 1)) | lead]
            for k in range(1, w):
                out[first[at] + k] = self.bytes[((code[at] >> 6 * (w - 1 - k)) & 0x3F) | 0x80]
        cuts = np.r_[first[np.searchsorted(word, np.arange(n))], len(out)].tolist()  # every word has a symbol
        ids = out.tolist()
        return [ids[a:b] for a, b in pairwise(cuts)]

    def decode_word(self, ids: list[int]) -> str:
        """The text of a word's ids; runs of byte ids are decoded together."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids]).replace(MARK, " ")
        try:
            return b"".join([self.raw[i] for i in ids]).decode("utf-8")  # valid as a whole: so is every run of bytes
        except UnicodeDecodeError:
            pass
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held = bytearray()
            if i is not None:
                out.append(self.text[i].replace(MARK, " "))
        return "".join(out)


def _utf8(data: bytes) -> str:
    """Bytes as text, one replacement character for each byte that is no part of a character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                if n == 4:
                    out.append("�")
                    at += 1
    return "".join(out)


class Memory(dict):
    """What words of at most LONGEST characters stand for, remembered up to `most` characters of words and values."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def learn(self, words: list[str], values: list, sizes: list[int]) -> dict:
        """The values of words of a block, those of long words in it only; forgets first if there are too many."""
        short = [len(w) <= LONGEST for w in words]
        self.held += sum(OVERHEAD + len(w) + n for w, n, ok in zip(words, sizes, short, strict=True) if ok)
        self.update((w, v) for w, v, ok in zip(words, values, short, strict=True) if ok)
        return {w: v for w, v, ok in zip(words, values, short, strict=True) if not ok}

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def trimmed(self) -> None:
        if self.held > self.most:
            self.clear()


class Codec:
    """Encodes and decodes blocks of texts; equal words of a block are worked on once."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known, self.ids = Memory(MEMORY), Memory(MEMORY // 4)  # ids: beside the models of a pipeline's other stages

    def words(self, text: str | None) -> list[str]:
        """The words of the normalised text: a leading blank, blanks as marks."""
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def ids_of(self, split: list[list[str]]) -> Mapping[str, list[int]]:
        """The ids of (at least) these words."""
        self.ids.trimmed()
        fresh = [w for w in set().union(*split) if w not in self.ids]
        if not fresh:
            return self.ids
        made = self.vocabulary.encode_words(fresh)
        long = self.ids.learn(fresh, made, [8 * len(i) for i in made])
        return ChainMap(self.ids, long) if long else self.ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text with the end id."""
        split = [self.words(t) for t in texts]
        ids = self.ids_of(split)
        return [[i for w in ws for i in ids[w]] + [self.vocabulary.end] for ws in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, control ids left out, the leading blank removed."""
        return self.vocabulary.decode_word([i for i in ids if i in self.vocabulary.text or i in self.vocabulary.byte_of]).removeprefix(" ")

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text, in order."""
        split = [self.words(t) for t in texts]
        known: Mapping[str, tuple[str, int, str]] = self.known
        self.known.trimmed()
        fresh = [w for w in set().union(*split) if w not in self.known]
        if fresh:
            made = self.vocabulary.encode_words(fresh)
            values = [(f"{' '.join(map(str, i))} ", len(i), self.vocabulary.decode_word(i)) for i in made]
            if long := self.known.learn(fresh, values, [7 * len(i) for i in made]):
                known = ChainMap(self.known, long)
        end = str(self.vocabulary.end)
        for ws in split:
            parts = [known[w] for w in ws]
            line = "".join([p[0] for p in parts]) + end
            text = "".join([p[2] for p in parts]).removeprefix(" ")
            yield sum([p[1] for p in parts]) + 1, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and model file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; model_path is read where the tasks run."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for b in batches:
            rows = [x for part in blocks(list(b)) for x in own.digests(part)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), made(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of int) of the whole text with the end id."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model_path)
        for b in batches:
            yield pd.Series([x for part in blocks(list(b)) for x in own.encode(part)], dtype=object)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(run, "array<int>")(F.col("text").cast("string")).alias("ids"))

"""Media columns: texts stored as images in tar archives, read back by a custom Spark data source.

A payload (UTF-8 bytes, padded with blanks to a positive multiple of WIDTH) becomes an 8-bit grey PNG,
WIDTH samples a row, its unpadded length in a tEXt chunk. Tasks write the images into tar archives with
an offset index beside each, and the manifest of complete archives goes to the archive directory.

The data source `media_archive` plans byte-range partitions over that directory: a partition owns the
members that start in its range. It streams them in Arrow batches of about BATCH bytes and reads every
member on its own, again from its offset (up to ATTEMPTS times) when reading or validating it fails.

Defined results: null and empty texts are one row of blanks with n_bytes 0; repeated rows each appear;
a null doc_id appears; no rows give no archive and no result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terracover.llm.common import scratch_path
from terracover.llm.files import PartFile, resolve

WIDTH, LEVEL, BATCH, ATTEMPTS = 192, 1, 4 << 20, 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes and the unpadded length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b" "), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes, n_bytes: int) -> bytes:
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)  # filter 0 before each row
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(media: bytes) -> dict[bytes, bytes]:
    """The chunks of an image that to_png has made, their checksums tested; ValueError if it is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, n = 8, {}, len(media)
    while at < n:
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if at + 12 + size > n or zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        parts[kind] = data
        at += 12 + size
    return parts


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length of an image that to_png has made; ValueError if it is damaged."""
    parts = chunks(media)
    width, height = struct.unpack_from(">II", parts[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return rows[:, 1:].tobytes(), int(parts[b"tEXt"].split(b"\0")[1])


def feature(data: bytes) -> str:
    """Mean, variance, histogram of eight bins and an 8 x 8 brightness hash, from integer sums."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n, s, q = len(x), int(x.sum()), int((x * x).sum())
    hist = np.bincount(x >> 5, minlength=8)
    grid = x.reshape(-1, WIDTH)
    rows = np.linspace(0, len(grid), 9).astype(int)
    cells = [int(grid[a : max(b, a + 1), c : c + WIDTH // 8].mean() * 256) if a < len(grid) else 0 for a, b in zip(rows, rows[1:], strict=False) for c in range(0, WIDTH, WIDTH // 8)]
    bits = "".join("1" if v * 64 > sum(cells) else "0" for v in cells)
    return f"mean={s * 10000 // n};var={(q * n - s * s) * 100 // (n * n)};hist={'-'.join(map(str, hist.tolist()))};hash={int(bits, 2):016x}"


def write_archives(docs: DataFrame, folder: str) -> None:
    """Writes the texts of (doc_id, text) as images below folder, and folder/manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, index = None, []
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                part = part or PartFile(folder, ".tar")
                media = to_png(*payload(text))
                info = tarfile.TarInfo(f"{doc_id or 'none'}.png")
                info.size = len(media)
                at = part.write(info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % tarfile.BLOCKSIZE))
                index.append((at, len(media)))
        if part:
            part.write(bytes(2 * tarfile.BLOCKSIZE))
            part.close()
            system, name = resolve(part.path + ".idx")
            with system.open_output_stream(name, compression=None) as out:
                out.write(np.array(index, "<i8").tobytes())
            yield pd.DataFrame({"path": [part.path], "size": [part.size], "members": [len(index)]})

    cols = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cols.mapInPandas(run, "path string, size long, members long").write.parquet(f"{folder}/manifest")


@dataclass
class ArchiveRange(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    """Byte-range partitions over the archives that the directory's manifest lists."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("split", 8 << 20))

    def partitions(self) -> list[ArchiveRange]:
        system, name = resolve(f"{self.folder}/manifest")
        listed = pq.read_table(name, filesystem=system, columns=["path", "size"]).to_pylist()
        ranges = [ArchiveRange(x["path"], at, min(x["size"], at + self.split)) for x in sorted(listed, key=lambda x: x["path"]) for at in range(0, x["size"], self.split)]
        return ranges or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, name = resolve(partition.path)
        with system.open_input_stream(name + ".idx", compression=None) as f:
            index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
        first, last = np.searchsorted(index[:, 0], [partition.start, partition.end])
        rows, size, held = [], 0, {}
        for at, n in index[first:last].tolist():
            rows.append(self._member(system, name, at, n, held))
            size += n
            if size >= BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _member(self, system, name: str, at: int, n: int, held: dict | None = None) -> tuple:
        """doc_id, media, offset and attempts of one member, read by its offset as often as it takes.

        held keeps the archive open from member to member; it is opened anew after a failure only.
        """
        held = {} if held is None else held
        for attempt in range(1, ATTEMPTS + 1):
            try:
                if "file" not in held:
                    held["file"] = system.open_input_file(name)
                raw = held["file"].read_at(tarfile.BLOCKSIZE + n, at)
                info = tarfile.TarInfo.frombuf(raw[: tarfile.BLOCKSIZE], "utf-8", "strict")  # checks the header's sum
                media = raw[tarfile.BLOCKSIZE :]
                if info.size != n or len(media) != n:
                    raise ValueError("short member")
                chunks(media)  # by checksums; the samples are inflated where they are used
                doc = info.name.removesuffix(".png")
                return (None if doc == "none" else int(doc), media, at, attempt)
            except (OSError, ValueError, tarfile.HeaderError, struct.error) as e:
                held.pop("file", None)
                if attempt == ATTEMPTS:
                    raise RuntimeError(f"member at {at} of {name}: {e}") from e
        raise AssertionError


_FIELDS = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("offset", pa.int64()), ("attempts", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS.types, strict=True)], schema=_FIELDS)


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, media binary, offset long, attempts int"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, split: int = 8 << 20) -> DataFrame:
    """doc_id, media, offset, attempts of every member."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("split", str(split)).load(folder)


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold: lengths, digests and the feature string."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m in b:
                data, n = from_png(m)
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(data)))
            yield pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    seen = F.pandas_udf(run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return media.select("doc_id", seen("media").alias("f")).select("doc_id", "f.*")


def digest(docs: DataFrame) -> DataFrame:
    """Stores the texts in the shared folder, reads them back and computes the features."""
    folder = scratch_path(docs.sparkSession, "media")
    write_archives(docs, folder)
    return features(read_archives(docs.sparkSession, folder))

"""WARC archives: one gzip member per record, and a splittable reader.

Writer: tasks first write every page as a response into staging files, which give its digest, length and
offset. Records with an equal payload of at least LEAST_REVISIT bytes become a response (the least page_id)
and revisits of it; only digests, ids and offsets are shuffled to find them. Each staging file is then
copied to its archive, its revisits rewritten; a payload never leaves the file that it was written to.

Reader: archives are cut into byte ranges. A task scans its ranges for the gzip magic, validates a
candidate by inflating it up to a WARC header, and owns the records that start inside a range, reading
past its end to finish the last. Payloads are hashed as they are inflated, never held whole.

Defined results: a null html is an empty payload and a response; rows of a repeated page_id each get a
record, and all with the least id of their payload are responses; a null page_id is a response unless
a row with an id has its payload; null urls are empty; no rows, no archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracover.llm.common import dropped, scratch_path, stored
from terracover.llm.files import PartFile, resolve

LEAST_REVISIT = 100
MAGIC = b"\x1f\x8b\x08"
#: Bytes read at once, and of them inflated at once.
READ, STEP = 1 << 20, 1 << 14
LEVEL = 4
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Ranges that a core works off, at most as tasks of their own.
WAVES = 16


def record(page_id: str | None, url: str | None, html: str, digest: str, size: int, refers_to: str | None) -> bytes:
    """The bytes of a record, before compression; a revisit (refers_to) has no payload of its own."""
    name = page_id or "none"
    revisit = refers_to is not None
    payload = b"" if revisit else html.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {size}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def staged(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page as a response below folder; (part, at, n, page_id, digest, size) of each record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = None
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                part = part or PartFile(folder, ".warc.gz")
                html = row.html or ""
                payload = html.encode("utf-8", "surrogatepass")
                sha = hashlib.sha256(payload)
                data = member(record(row.page_id, row.url, html, sha.hexdigest(), len(payload), None))
                rows.append((part.path.rpartition("/")[2], part.write(data), len(data), row.page_id, sha.digest(), len(payload)))
            yield pd.DataFrame(rows, columns=["part", "at", "n", "page_id", "digest", "size"])
        if part:
            part.close()

    own = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(own.mapInPandas(run, "part string, at long, n long, page_id string, digest binary, size long"), "warc-records")


def revisits(records: DataFrame) -> DataFrame:
    """(part, at, n, refers_to) of the records that are revisits."""
    own = records.where(F.col("size") >= LEAST_REVISIT).select("part", "at", "n", F.col("page_id").cast("long").alias("page_id"), "digest")
    least = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1 and refers_to is not null").drop("rows")
    return own.join(least, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("part", "at", "n", "refers_to")


def _rewritten(staging, at: int, n: int, refers_to: int) -> bytes:
    """The member of a staged response as a revisit."""
    z, data = zlib.decompressobj(31), staging.read_at(n, at)
    head, pos = z.decompress(data, STEP), 0
    while (pos := head.find(b"\r\n\r\n")) < 0:
        head += z.decompress(z.unconsumed_tail, STEP)
    f = _fields(head[:pos])
    page = f["WARC-Record-ID"][len("<urn:page:") : -1]
    return member(record(page, f["WARC-Target-URI"], "", f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"]), str(refers_to)))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives below folder; the manifest (path, size) of the complete parts."""
    staging = scratch_path(pages.sparkSession, "warc-staging")
    records = staged(pages, staging)
    parts = records.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    # a part's first row stands for all its bytes, the others for its revisits in order
    work = parts.select("part", F.lit(-1).cast("long").alias("at"), F.col("end").alias("n"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits(records))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = source = None
        done = end = 0

        def copied(upto: int) -> None:
            for k in range(done, upto, READ):
                out.write(source.read_at(min(READ, upto - k), k))

        for b in batches:
            made = []
            for part, at, n, refers in zip(b["part"], b["at"], b["n"], b["refers_to"], strict=True):
                if at < 0:
                    if out:
                        copied(end)
                        out.close()
                        made.append((out.path, out.size))
                    system, name = resolve(f"{staging}/{part}")
                    out, source, done, end = PartFile(folder, ".warc.gz"), system.open_input_file(name), 0, int(n)
                else:
                    copied(int(at))
                    out.write(_rewritten(source, int(at), int(n), int(refers)))
                    done = int(at) + int(n)
            yield pd.DataFrame(made, columns=["path", "size"])
        if out:
            copied(end)
            out.close()
            yield pd.DataFrame({"path": [out.path], "size": [out.size]})

    spark = pages.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    done = stored(work.repartition(tasks, "part").sortWithinPartitions("part", "at").mapInPandas(run, "path string, size long"), "warc-manifest")
    dropped(staging)
    return done


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)


class Range:
    """The records that start in [start, end) of an archive; reads ahead in one buffer."""

    def __init__(self, path: str, start: int, end: int):
        system, name = resolve(path)
        self.file = system.open_input_file(name)
        self.size, self.start, self.end = self.file.size(), start, end
        self.held, self.held_at = b"", 0

    def __iter__(self) -> Iterator[dict]:
        at = self.start
        while (at := self._next(at)) is not None:
            got = self._member(at)
            if got is None:
                at += 1
                continue
            yield got[0]
            at += got[1]
        self.file.close()

    def _hold(self, at: int, n: int) -> int:
        """The place in the buffer of a byte of the file, n bytes after it (or all to the file's end) in the buffer."""
        if not self.held_at <= at <= at + min(n, self.size - at) <= self.held_at + len(self.held):
            self.held, self.held_at = self.file.read_at(max(n, min(READ, self.size - at)), at), at
        return at - self.held_at

    def _next(self, at: int) -> int | None:
        """The next place before the range's end that holds the gzip magic."""
        while at < min(self.end, self.size):
            k = self._hold(at, len(MAGIC))
            found = self.held.find(MAGIC, k)
            if found >= 0:
                return self.held_at + found if self.held_at + found < self.end else None
            at = max(at + 1, self.held_at + len(self.held) - len(MAGIC) + 1)
        return None

    def _member(self, at: int) -> tuple[dict, int] | None:
        """The record of the member at a place and the member's length; None if it is no WARC member."""
        z, head, pos, sha, size = zlib.decompressobj(31), b"", at, hashlib.sha256(), 0
        fields: dict[str, str] | None = None
        left = 0
        try:
            while not z.eof:
                if pos >= self.size:
                    return None
                k = self._hold(pos, STEP)
                data = self.held[k : k + STEP]
                pos += len(data)
                out = z.decompress(data, READ)
                while True:
                    if fields is None:
                        head += out
                        if head[:5] != b"WARC/"[: len(head[:5])]:
                            return None
                        cut = head.find(b"\r\n\r\n")
                        http = head.find(b"\r\n\r\n", cut + 4) if cut >= 0 else -1
                        if http >= 0:
                            fields = _fields(head[:cut])
                            left = int(fields["Content-Length"]) - (http - cut)
                            out = head[http + 4 :]
                    if fields is not None:
                        part = out[:left]
                        sha.update(part)
                        size += len(part)
                        left -= len(part)
                    if z.eof or not z.unconsumed_tail:
                        break
                    out = z.decompress(z.unconsumed_tail, READ)
        except (zlib.error, ValueError, KeyError):
            return None
        if fields is None or left:
            return None
        return {"fields": fields, "bytes": size, "sha256": sha.hexdigest()}, pos - at - len(z.unused_data)


def read(manifest: DataFrame, split: int = 8 << 20) -> DataFrame:
    """The records of the archives of a manifest (path, size), read in ranges of `split` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                out = []
                for x in Range(r.path, int(r.start), int(r.end)):
                    f = x["fields"]
                    page, refers = (f.get(k, "")[len("<urn:page:") : -1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    revisit = f["WARC-Type"] == "revisit"
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and digest != x["sha256"]:
                        raise ValueError(f"damaged payload of page {page} in {r.path}")
                    out.append((None if page == "none" else int(page), int(f["X-Payload-Length"]) if revisit else x["bytes"], digest, f["WARC-Type"], int(refers) if refers else None))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    cut = F.lit(split)
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, cut.cast("long"))
    ranges = manifest.where("size > 0").select("path", F.col("size"), F.explode(starts).alias("start")).select("path", "start", F.least("size", F.col("start") + cut).alias("end"))
    n = manifest.agg(F.sum(F.ceil(F.col("size") / cut))).first()[0] or 1
    tasks = min(int(n), WAVES * manifest.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(tasks).mapInPandas(run, SCHEMA)  # a number of its own: adaptive execution would merge rows so small


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    return read(write(pages, scratch_path(pages.sparkSession, "warc")))

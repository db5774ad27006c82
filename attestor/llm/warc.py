"""WARC archives compressed record by record with a Zstandard dictionary in a leading skippable frame.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on the archive's
own first records, then one Zstandard frame for each WARC record, so that a record can be read by its offset.
Payloads that were archived before are written as revisit records, without their payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import beside, file_system, fresh_path, kept, located, only, tidy, utf8, written

#: Fixed values of the format: magic of the dictionary's frame, and magic of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Fixed value: the WARC profile of a revisit by equal payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PREFIX = 0x5F0C1E6A2B3D4F8A << 64
LEVEL = 6


def _urn(page_id: int | None) -> str:
    """A record id that holds the page's number in its low 64 bits; a null number gets a random one."""
    return f"<urn:uuid:{uuid.UUID(int=_PREFIX | page_id & (1 << 64) - 1) if page_id is not None else uuid.uuid4()}>"


def _number(urn: str) -> int:
    low = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record, or, with ``refers_to``, a revisit record without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "" if c > " ") or "urn:none"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is None:
        lines.append("WARC-Page-Number: none")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def train(records: list[bytes], size: int = 32 << 10) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on these records, or None if they are too few or too small for one."""
    size = min(size, sum(map(len, records)) // 8)
    if len(records) < 8 or size < 256:
        return None
    try:
        return zstandard.train_dictionary(size, records, d=8, k=min(256, size // 4), level=LEVEL)
    except zstandard.ZstdError:
        return None


class Archive:
    """Writes one archive to an open stream. Records wait until the dictionary's sample is complete."""

    def __init__(self, stream, sample_bytes: int):
        self.stream, self.sample_bytes = stream, sample_bytes
        self.waiting: list[bytes] = []
        self.size = self.raw = self.records = 0
        self.compressor = None

    def add(self, record: bytes) -> None:
        self.raw += len(record)
        self.records += 1
        if self.compressor is None:
            self.waiting.append(record)
            if self.raw >= self.sample_bytes:
                self._begin()
        else:
            self._put(self.compressor.compress(record))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        dictionary = train(self.waiting)
        if dictionary is not None:
            raw = dictionary.as_bytes()
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for r in self.waiting:
            self._put(self.compressor.compress(r))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.stream.close()


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its header and block headers."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    content = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        block = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def read_archive(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record of an archive."""
    view, at, plain = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            n = struct.unpack_from("<I", data, at + 4)[0]
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(view[at + 8 : at + 8 + n])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                    raw = plain.decompress(raw)
                plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + n
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        end = frame_end(view, at)
        yield at, plain.decompress(view[at:end])
        at = end


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """page_id, url, data, digest and refers_to (the smallest page_id of equal payloads, or null).

    Only payloads of at least ``least_bytes`` are revisited. Rows that share the smallest id all count as
    the response. Null ids are never referred to. First ids come from a grouped minimum over digests; what is joined
    back to the payloads is, for each revisit, its row's place and the id it refers to, so copies of one payload never
    meet.
    """
    pages, at = located(pages)
    rows = only(pages, *at, id_col, url_col, html_col).select(*at, F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(html_col).alias("data"))
    rows = rows.withColumn("digest", F.sha2("data", 256))
    slim = rows.where(F.octet_length("data") >= least_bytes).select(*at, "page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1 and low is not null").select("digest", "low")
    refs = kept(slim.join(first, "digest").where(~F.col("low").eqNullSafe(F.col("page_id"))).select(*at, F.col("low").alias("refers_to")))
    return beside(rows, refs, at, "left").select("page_id", "url", "data", "digest", "refers_to")


def write_archives(records: DataFrame, archive_bytes: int = 16 << 20, sample_bytes: int = 1 << 20) -> DataFrame:
    """Write the rows of ``classified`` into archives in the shared folder; returns the written manifest.

    A new archive begins once ``archive_bytes`` of compressed records are in the old one. The dictionary is
    trained on the first ``sample_bytes`` of an archive. A task that runs again writes new files; only those in
    the manifest count.
    """
    base = fresh_path(records.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archive, path, made = TaskContext.get().partitionId(), None, "", 0
        for batch in batches:
            ids, urls, digests, refs = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for page_id, url, data, digest, ref in zip(ids, urls, batch.column(2), digests, refs):
                if archive is None:
                    path = f"{base}/part-{part:06d}-{made:04d}-{uuid.uuid4().hex[:8]}.warc.zst"
                    fs, at = file_system(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    archive, made = Archive(fs.open_output_stream(at, compression=None), sample_bytes), made + 1
                archive.add(warc_record(page_id, url, data.as_py(), digest, ref))
                if archive.size >= archive_bytes:
                    archive.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [archive.records], "raw_bytes": [archive.raw]})
                    archive = None
        if archive is not None:
            archive.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [archive.records], "raw_bytes": [archive.raw]})

    return written(records.mapInArrow(tidy(write), "path string, records long, raw_bytes long"), "warc-manifest")


_READ = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("archive", pa.string()), ("offset", pa.int64()))


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives. Digests of responses are made from the payload read back and
    held against the header; a revisit's digest and length come from its headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as f:
                    data, out = f.read(), []
                for offset, raw in read_archive(data):
                    r = parse_record(raw)
                    f, kind = r["fields"], r["fields"]["warc-type"]
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"{path}: payload and digest differ")
                    page = None if "warc-page-number" in f else _number(f["warc-record-id"])
                    n = len(r["payload"]) if kind == "response" else int(r["http"]["Content-Length"])
                    out.append((page, n, digest, kind, _number(f["warc-refers-to"]) if kind == "revisit" else None, f["warc-target-uri"], path, offset))
                    if len(out) >= 5000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    paths = manifest.select("path")
    return paths.repartition(max(1, int(np.clip(manifest.count(), 1, 20_000)))).mapInArrow(tidy(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, offset long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _READ)], [n for n, _ in _READ])


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Archive every page and read the archives back: rows of ``read_archives``, one for each row of ``pages``.

    Null html is an empty payload, a null url ``urn:none``, a null id stays null. An empty table gives no rows.
    """
    return read_archives(write_archives(classified(pages, id_col, url_col, html_col, least_bytes)))

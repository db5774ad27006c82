"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record: payload length (uint64), masked CRC-32C of those eight bytes (uint32), payload, masked CRC-32C of
the payload (uint32), all little-endian. A payload: document id (int64), 1 if that id is null else 0 (uint8),
bytes of an id (uint8: 2 or 4), the ids. The index file holds one fixed-size entry for each record, so that a
loader can visit records in any order: offset, payload length, document id, ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.shared import file_system, fresh_path, located, only, tidy, utf8, written
from attestor.llm.tokens import encoder

#: Fixed values of the format: reflected Castagnoli polynomial and the mask's addend.
_POLY, _MASK = 0x82F63B78, 0xA282EAD8
_HEAD = struct.Struct("<QI")
_LEAD = struct.Struct("<qBB")
INDEX = np.dtype([("offset", "<u8"), ("length", "<u4"), ("doc_id", "<i8"), ("tokens", "<u4")])
_CHUNK = 256
_BLOCK = 4 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    t = np.zeros((8, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLY), c >> 1)
    t[0] = c
    for k in range(1, 8):
        t[k] = t[0][t[k - 1] & 255] ^ (t[k - 1] >> 8)
    # what a checksum becomes after _CHUNK more zero bytes, by each of its four bytes
    s = np.stack([np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)])
    for _ in range(_CHUNK):
        s = t[0][s & 255] ^ (s >> 8)
    return t, s


_T, _S = _tables()


def _rows(words: np.ndarray) -> np.ndarray:
    """CRC-32C from state zero of each row of uint32 words (an even number of them)."""
    state = np.zeros(len(words), np.uint32)
    for j in range(0, words.shape[1], 2):
        a, b = words[:, j] ^ state, words[:, j + 1]
        state = _T[7][a & 255] ^ _T[6][(a >> 8) & 255] ^ _T[5][(a >> 16) & 255] ^ _T[4][a >> 24] ^ _T[3][b & 255] ^ _T[2][(b >> 8) & 255] ^ _T[1][(b >> 16) & 255] ^ _T[0][b >> 24]
    return state


def crc32c(items: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings at once, each of at least four bytes.

    Zeros in front don't alter a checksum that starts at zero, so strings are padded in front to whole
    chunks; the usual start value is folded into the first four bytes.
    """
    if not items:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(x) for x in items])
    chunks = -(-sizes // _CHUNK)
    ends = np.cumsum(chunks) * _CHUNK
    buf = np.zeros(int(ends[-1]), np.uint8)
    for x, e in zip(items, ends.tolist()):
        buf[e - len(x) : e] = np.frombuffer(x, np.uint8)
    first = ends - sizes
    for k in range(4):
        buf[first + k] ^= 255
    each = _rows(buf.view("<u4").reshape(-1, _CHUNK // 4))
    start, state = ends // _CHUNK - chunks, np.zeros(len(items), np.uint32)
    for step in range(int(chunks.max())):
        on = np.flatnonzero(chunks > step)
        c = state[on]
        state[on] = _S[0][c & 255] ^ _S[1][(c >> 8) & 255] ^ _S[2][(c >> 16) & 255] ^ _S[3][c >> 24] ^ each[start[on] + step]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(items: list[bytes]) -> np.ndarray:
    c = crc32c(items)
    return ((c >> 15) | (c << 17)) + np.uint32(_MASK)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of these payloads, and each record's offset in the result."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(heads).astype("<u4").tobytes(), masked(payloads).astype("<u4").tobytes()
    out = b"".join(x for k, p in enumerate(payloads) for x in (heads[k], a[4 * k : 4 * k + 4], p, b[4 * k : 4 * k + 4]))
    sizes = np.array([len(p) + 16 for p in payloads], np.int64)
    return out, np.cumsum(sizes) - sizes


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    return _LEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def parse_payload(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _LEAD.unpack_from(data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", offset=_LEAD.size).astype("<u4")


def _verified(payloads: list[bytes], heads: list[bytes], sums: list[tuple[int, int]], path: str) -> list[bytes]:
    if payloads and ((masked(heads) != np.array([s[0] for s in sums], np.uint32)).any() or (masked(payloads) != np.array([s[1] for s in sums], np.uint32)).any()):
        raise ValueError(f"{path}: a record's checksum is wrong")
    return payloads


def read_records(path: str) -> Iterator[bytes]:
    """Payloads of a record file in order; memory holds one block of them. A wrong checksum or a cut file raises."""
    fs, at = file_system(path)
    with fs.open_input_stream(at, buffer_size=1 << 20) as f:
        heads, payloads, sums, size = [], [], [], 0
        while head := f.read(12):
            if len(head) < 12:
                raise ValueError(f"{path}: cut short")
            n, crc = _HEAD.unpack(head)
            body = f.read(n + 4)
            if len(body) < n + 4:
                raise ValueError(f"{path}: cut short")
            heads.append(head[:8])
            payloads.append(body[:n])
            sums.append((crc, int.from_bytes(body[n:], "little")))
            size += n
            if size >= _BLOCK:
                yield from _verified(payloads, heads, sums, path)
                heads, payloads, sums, size = [], [], [], 0
        yield from _verified(payloads, heads, sums, path)


def read_index(path: str) -> np.ndarray:
    fs, at = file_system(path)
    with fs.open_input_stream(at) as f:
        return np.frombuffer(f.read(), INDEX)


def read_at(path: str, entries: np.ndarray) -> Iterator[bytes]:
    """Payloads of the records that these index entries name, in the order given: the shuffled read."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        for e in entries:
            f.seek(int(e["offset"]))
            raw = f.read(int(e["length"]) + 16)
            n, crc = _HEAD.unpack_from(raw)
            yield _verified([raw[12 : 12 + n]], [raw[:8]], [(crc, int.from_bytes(raw[12 + n :], "little"))], path)[0]


def write_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", rows_a_file: int = 20_000) -> DataFrame:
    """Encode whole texts and write them in ascending id order as record files with indexes.

    Returns the manifest, one row for each file: part (files ascend in id order), path, index_path, records,
    tokens. Null texts are empty; a null id sorts first and is stored as null. Rows of equal id are in the order of
    their places in the input. Equal rows are kept, each as its own record. An empty table gives no files. Range
    partitions are cut by id and place, so that one id may hold any share of the rows, and there are as many as keep a
    file at about ``rows_a_file`` records; the pass that samples their bounds reads no texts.
    """
    spark = docs.sparkSession
    base = fresh_path(spark, "records")
    docs, at = located(docs)
    n = max(2 * spark.sparkContext.defaultParallelism, -(-docs.count() // rows_a_file))
    order = [F.col("doc_id").asc_nulls_first(), *at]
    rows = only(docs, id_col, text_col, *at).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"), *at)
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "data")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        enc, out, index, pending, entries, size = None, None, None, [], [], 0
        offset = n_records = n_tokens = 0

        def flush():
            nonlocal offset, pending, entries, size
            data, at = frame(pending)
            out.write(data)
            e = np.zeros(len(pending), INDEX)
            e["offset"], e["length"] = at + offset, [len(p) for p in pending]
            e["doc_id"], e["tokens"] = [x[0] for x in entries], [x[1] for x in entries]
            index.write(e.tobytes())
            offset += len(data)
            pending, entries, size = [], [], 0

        for batch in batches:
            if out is None:
                enc = encoder(tokenizer)
                fs, at = file_system(name)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out, index = fs.open_output_stream(at + ".rec"), fs.open_output_stream(at + ".idx")
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.groups(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                p = payload(doc_id, ids)
                pending.append(p)
                entries.append((doc_id or 0, len(ids)))
                size += len(p)
                n_records, n_tokens = n_records + 1, n_tokens + len(ids)
                if size >= _BLOCK:
                    flush()
        if out is not None:
            if pending:
                flush()
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name + ".rec"], "index_path": [name + ".idx"], "records": [n_records], "tokens": [n_tokens]})

    return written(rows.mapInArrow(tidy(write), "part long, path string, index_path string, records long, tokens long"), "manifest")


def scan_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read record files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running total that files begin at is a window over the manifest, which has a row for each file.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = manifest.select("path", before.cast("long").alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[tuple] = []
                for p in read_records(path):
                    doc_id, ids = parse_payload(p)
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) >= 5000:
                        yield _columns(out)
                        out = []
                if out:
                    yield _columns(out)

    return table.repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

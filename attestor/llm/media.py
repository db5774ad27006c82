"""AVI motion-JPEG columns: write and parse RIFF files, decode intra frames, cut them into timed clips.

Text payloads are stored in AVI files whose frames are lossless JPEG images (process 14 of T.81: Huffman
coding, predictor 1, 8-bit samples), each pixel row a restart interval. Restart intervals can be decoded side
by side, so the decoder advances all rows of a file one sample at a time with array operations. Frames of
baseline sequential JPEG (as cameras write) are decoded too, block by block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import only, tidy, utf8

#: A frame of more samples is taken as damaged.
MOST_SAMPLES = 1 << 26
#: A row of pixels has this many samples; payloads are padded with spaces to a multiple of it.
UNIT = 192
#: Rows of pixels in a frame, and frames in a second.
HEIGHT, RATE = 8, 25
#: Bytes of text whose files are decoded together.
_TOGETHER = 2 << 20
#: Categories 0 to 8 of a difference of 8-bit samples, and bits of each one's Huffman code (canonical order).
_CODE_BITS = (4, 6, 6, 4, 4, 3, 2, 2, 3)
#: Fixed values of the JPEG format: order of coefficients in a block.
_ZIGZAG = np.array([x * 8 + y for s in range(15) for x, y in ((i, s - i) if s % 2 else (s - i, i) for i in range(8)) if 0 <= y < 8 and 0 <= x < 8])


def _canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, bits), for (symbol, bits) in order of bits."""
    codes, code, last = {}, 0, lengths[0][1] if lengths else 0
    for symbol, bits in lengths:
        code <<= bits - last
        codes[symbol], last = (code, bits), bits
        code += 1
    return codes


def _own_table() -> tuple[bytes, np.ndarray, np.ndarray]:
    order = sorted(enumerate(_CODE_BITS), key=lambda x: (x[1], x[0]))
    codes = _canonical(order)
    counts = bytes(sum(b == n for _, b in order) for n in range(1, 17))
    dht = counts + bytes(s for s, _ in order)
    return dht, np.array([codes[s][0] for s in range(9)], np.uint32), np.array(_CODE_BITS, np.uint32)


_DHT, _CODES, _BITS = _own_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_TABLE = _segment(0xC4, b"\x00" + _DHT)
_SCAN = _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))  # one component, table 0, predictor 1
_RESTART = _segment(0xDD, struct.pack(">H", UNIT))


def encode_rows(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each pixel row (rows x UNIT, uint8), padded with ones and byte-stuffed."""
    rows = samples.shape[0]
    values = samples.astype(np.int16)
    diff = np.diff(values, axis=1, prepend=np.int16(128))
    size = np.zeros(diff.shape, np.uint32)
    for k in range(8):
        size += np.abs(diff) >= (1 << k)
    extra = np.where(diff < 0, diff + (1 << size.astype(np.int32)) - 1, diff).astype(np.uint32)
    code, bits = (_CODES[size] << size) | extra, (_BITS[size] + size).astype(np.int64)
    ends = np.cumsum(bits, axis=1)
    width = int(ends[:, -1].max() + 7) // 8
    # every code has at most 14 bits: it touches three bytes at most
    start = ends - bits
    shifted = code.astype(np.uint64) << (24 - (start & 7) - bits).astype(np.uint64)
    at = (np.arange(rows)[:, None] * (width + 3) + (start >> 3)).ravel()
    out = np.zeros(rows * (width + 3), np.float64)
    for k in range(3):
        out += np.bincount(at + k, ((shifted >> np.uint64(16 - 8 * k)) & np.uint64(255)).ravel().astype(np.float64), len(out))
    data = out.astype(np.uint8).reshape(rows, width + 3)
    length = (ends[:, -1] + 7) // 8
    spare = (8 - (ends[:, -1] & 7)) & 7
    data[np.arange(rows), length - 1] |= ((1 << spare) - 1).astype(np.uint8)
    return [data[r, : length[r]].tobytes().replace(b"\xff", b"\xff\x00") for r in range(rows)]


def _frame(rows: list[bytes], height: int) -> bytes:
    body = b"".join(x + struct.pack(">BB", 255, 0xD0 + k % 8) for k, x in enumerate(rows[:-1])) + rows[-1]
    head = _segment(0xC3, struct.pack(">BHHB", 8, height, UNIT, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + head + _TABLE + _RESTART + _SCAN + body + b"\xff\xd9"


#: How every frame written here begins; its tables need not be parsed again.
_LIKE = b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, UNIT, 1) + bytes([1, 0x11, 0])) + _TABLE + _RESTART + _SCAN


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE, note: bytes = b"") -> bytes:
    """An AVI file of motion-JPEG frames with an ``idx1`` index; ``note`` goes to an ISFT-like ``note`` chunk."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4h", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)) + _chunk(b"note", note)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, n = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > end:
            raise ValueError("RIFF chunk runs past its parent")
        yield name, at + 8, at + 8 + n
        at += 8 + n + (n & 1)


def parse_avi(data: bytes) -> dict:
    """Header fields and the frames' byte ranges, by the index where there is one, else by walking ``movi``.

    Returns rate (frames a second), width, height, note, frames [(from, to)], indexed. Malformed files raise.
    """
    view = memoryview(data)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"rate": 0.0, "width": 0, "height": 0, "note": b"", "frames": [], "indexed": False}
    movi = index = None
    for name, a, b in _chunks(view, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, d in _chunks(view, a + 4, b):
                if inner == b"avih":
                    micro, *_ = struct.unpack_from("<I", data, c)
                    out |= {"rate": 1e6 / micro if micro else 0.0, "width": struct.unpack_from("<I", data, c + 32)[0], "height": struct.unpack_from("<I", data, c + 36)[0]}
                elif inner == b"note":
                    out["note"] = bytes(view[c:d])
        elif name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = (a, b)
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        entries = np.frombuffer(view[index[0] : index[1]], np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]))
        entries = entries[[x[2:] in (b"dc", b"db") for x in entries["id"].tolist()]]
        base = movi[0] if len(entries) and int(entries["at"][0]) < movi[0] else 0  # offsets count from movi or from the file's start
        out["frames"] = [(base + a + 8, base + a + 8 + n) for a, n in zip(entries["at"].tolist(), entries["n"].tolist())]
        out["indexed"] = True
    else:
        out["frames"] = [(a, b) for name, a, b in _chunks(view, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return out


def _header(jpeg: bytes) -> dict:
    """Tables and geometry of a JPEG image up to its scan."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, out = 2, {"quant": {}, "huffman": {}, "restart": 0}
    while True:
        if jpeg[at] != 255:
            raise ValueError("marker expected")
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker in (0xC0, 0xC1, 0xC3):
            depth, h, w, count = struct.unpack_from(">BHHB", body)
            sampling = [body[7 + 3 * k] for k in range(count)]
            if not h or not w or not sampling or any(not 1 <= f <= 4 for s in sampling for f in (s >> 4, s & 15)):
                raise ValueError("an image has no size, or components without samples")
            if h * w * count > MOST_SAMPLES:
                raise ValueError(f"an image has over {MOST_SAMPLES} samples")
            out |= {"lossless": marker == 0xC3, "depth": depth, "height": h, "width": w, "parts": [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(count)]}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("this JPEG process isn't supported")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                symbols = body[k + 17 : k + 17 + sum(counts)]
                lengths = [n + 1 for n, c in enumerate(counts) for _ in range(c)]
                out["huffman"][body[k]] = list(zip(symbols, lengths))
                k += 17 + sum(counts)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                table = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float64)
                out["quant"][body[k] & 15] = table
                k += 1 + 64 * (1 + bool(wide))
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out |= {"scan": body, "at": at}
            return out


def _lookup(lengths: list[tuple[int, int]]) -> np.ndarray:
    """By the next 16 bits: symbol * 32 + bits of its code; 0 for none."""
    table = np.zeros(1 << 16, np.int32)
    for s, (code, bits) in _canonical(lengths).items():
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = s * 32 + bits
    return table


_LOOKUPS: dict[tuple, np.ndarray] = {}


def _lookup_of(lengths: list[tuple[int, int]]) -> np.ndarray:
    key = tuple(lengths)
    if key not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[key] = _lookup(lengths)
    return _LOOKUPS[key]


def _intervals(scan: bytes) -> list[bytes]:
    """Entropy-coded restart intervals of a scan, without stuffing."""
    raw = np.frombuffer(scan, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD9))
    out, at = [], 0
    for m in marks.tolist():
        out.append(scan[at:m].replace(b"\xff\x00", b"\xff"))
        at = m + 2
        if scan[m + 1] == 0xD9:
            break
    return out


def decode_lossless(intervals: list[bytes], table: np.ndarray, width: int) -> np.ndarray:
    """Rows of samples: each interval is one row, all rows advance together."""
    rows = len(intervals)
    sizes = np.array([len(x) for x in intervals], np.int64)
    data = np.frombuffer(b"".join(intervals) + bytes(8), np.uint8).astype(np.uint32)
    # 32 bits from each byte on, so that one look-up gives a code and its extra bits
    view = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    pos = (np.cumsum(sizes) - sizes) * 8
    last = pos + sizes * 8
    diff = np.zeros((width, rows), np.int32)
    for k in range(width):
        now = view[pos >> 3] << (pos & 7).astype(np.uint32)
        hit = table[now >> np.uint32(16)]
        bits, size = hit & 31, hit >> 5
        more = ((now << bits.astype(np.uint32)) >> np.uint32(16)).astype(np.int64) >> (16 - size)
        diff[k] = np.where((size > 0) & (more < (1 << np.maximum(size - 1, 0))), more - (1 << size) + 1, more)
        pos = pos + bits + size
        if not bits.all():
            raise ValueError("no such Huffman code")
    if (pos > last).any():
        raise ValueError("an interval ends early")
    return ((np.cumsum(diff, axis=0) + 128) & 255).T.astype(np.uint8)


class _Bits:
    """Bits of a scan from the front; each look reads four bytes, however long the scan is."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def _ahead(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 4].ljust(4, b"\0"), "big")

    def peek16(self) -> int:
        return (self._ahead() >> (16 - (self.at & 7))) & 65535

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the scan ends early")
        out = (self._ahead() >> (32 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at += n
        return out


def _symbol(bits: _Bits, table: np.ndarray) -> int:
    hit = int(table[bits.peek16()])
    if not hit:
        raise ValueError("no such Huffman code")
    bits.take(hit & 31)
    return hit >> 5


def _signed(bits: _Bits, size: int) -> int:
    v = bits.take(size) if size else 0
    return v - (1 << size) + 1 if size and v < 1 << (size - 1) else v


_BASIS = np.array([[(0.5 if u else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def decode_baseline(jpeg: bytes, head: dict) -> np.ndarray:
    """Samples (height, width, components) of a baseline image; components stay in the file's colour space."""
    parts = head["parts"]
    chosen = {head["scan"][1 + 2 * k]: head["scan"][2 + 2 * k] for k in range(head["scan"][0])}
    hmax, vmax = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
    across, down = -(-head["width"] // (8 * hmax)), -(-head["height"] // (8 * vmax))
    planes = [np.zeros((down * (p[1] & 15) * 8, across * (p[1] >> 4) * 8)) for p in parts]
    intervals = iter(_intervals(jpeg[head["at"] :]))
    bits, last = None, [0] * len(parts)
    for mcu in range(across * down):
        if bits is None or head["restart"] and mcu % head["restart"] == 0:
            bits, last = _Bits(next(intervals)), [0] * len(parts)
        for c, (name, sampling, q) in enumerate(parts):
            dc, ac = _lookup_of(head["huffman"][chosen[name] >> 4]), _lookup_of(head["huffman"][16 + (chosen[name] & 15)])
            for v in range(sampling & 15):
                for h in range(sampling >> 4):
                    block = np.zeros(64)
                    last[c] += _signed(bits, _symbol(bits, dc))
                    block[0], k = last[c], 1
                    while k < 64:
                        s = _symbol(bits, ac)
                        if not s & 15 and s != 0xF0:
                            break
                        k += s >> 4
                        if s & 15:
                            if k > 63:
                                raise ValueError("a block has too many coefficients")
                            block[k] = _signed(bits, s & 15)
                        k += 1
                    grid = np.zeros(64)
                    grid[_ZIGZAG] = block * head["quant"][q]
                    y, x = ((mcu // across) * (sampling & 15) + v) * 8, ((mcu % across) * (sampling >> 4) + h) * 8
                    planes[c][y : y + 8, x : x + 8] = _BASIS.T @ grid.reshape(8, 8) @ _BASIS
    if any(hmax % (s >> 4) or vmax % (s & 15) for _, s, _ in parts):
        raise ValueError("components of fractional size aren't supported")
    full = [np.repeat(np.repeat(p, vmax // (s & 15), 0), hmax // (s >> 4), 1) for p, (_, s, _) in zip(planes, parts)]
    return np.clip(np.rint(np.stack(full, -1) + 128), 0, 255).astype(np.uint8)[: head["height"], : head["width"]]


def decode_frames(images: list[bytes]) -> list[np.ndarray]:
    """Samples of each intra frame. Lossless frames with the same table are decoded together."""
    out: list = [None] * len(images)
    groups: dict[tuple, list] = {}
    heads: dict[bytes, dict] = {}
    for k, jpeg in enumerate(images):
        known = jpeg[: len(_LIKE)]
        head = heads.get(known) or _header(jpeg)
        if known == _LIKE:
            heads[known] = head
        if not head["lossless"]:
            out[k] = decode_baseline(jpeg, head)
            continue
        if len(head["parts"]) != 1 or head["depth"] != 8 or head["scan"][3] != 1 or head["scan"][5] & 15 or head["restart"] != head["width"]:
            raise ValueError("lossless frames need one 8-bit component, predictor 1 and a restart interval a row")
        rows = _intervals(jpeg[head["at"] :])
        if len(rows) != head["height"]:
            raise ValueError("rows are missing")
        groups.setdefault((tuple(head["huffman"][head["scan"][2] >> 4]), head["width"]), []).append((k, rows))
    for (lengths, width), found in groups.items():
        samples, at = decode_lossless([r for _, rows in found for r in rows], _lookup_of(list(lengths)), width), 0
        for k, rows in found:
            out[k] = samples[at : at + len(rows)]
            at += len(rows)
    return out


def detect_shots(frames: list[np.ndarray], bins: int = 32, window: int = 8, factor: float = 3.0, floor: float = 0.15) -> tuple[list[tuple[int, int]], list[float]]:
    """Shots as frame ranges, and the difference of each frame's histogram to the one before.

    A cut stands before frame k if its histogram difference (half the L1 distance, 0 to 1) is at least
    ``floor`` and exceeds mean + factor * deviation of the differences in the ``window`` frames before it.
    """
    if not frames:
        return [], []
    hist = np.stack([np.bincount(f.ravel() >> (8 - bins.bit_length() + 1), minlength=bins)[:bins] / f.size for f in frames])
    diff = np.r_[0.0, np.abs(np.diff(hist, axis=0)).sum(1) / 2]
    cuts = [0]
    for k in range(1, len(frames)):
        past = diff[max(1, k - window) : k]
        limit = past.mean() + factor * past.std() if len(past) else 0.0
        if diff[k] >= floor and diff[k] > limit:
            cuts.append(k)
    return list(zip(cuts, [*cuts[1:], len(frames)])), diff.tolist()


def payload_frames(frames: list[np.ndarray], note: bytes | None) -> list[np.ndarray]:
    """Frames for ``detect_shots`` of a file made by ``store_text``: what fills the last one up shows no change of the text,
    so a frame's worth of samples up to the text's end (its last that isn't a space) stands for it. Frames of other files
    stay."""
    if len(frames) < 2 or note is None or len(note) != 8 or any(f.shape[:2] != (HEIGHT, UNIT) for f in frames[-2:]):
        return frames
    rows = struct.unpack("<Q", note)[0] - HEIGHT * (len(frames) - 2)
    if not HEIGHT < rows <= 2 * HEIGHT:
        return frames
    end = np.concatenate(frames[-2:])[:rows].ravel()
    said = np.flatnonzero(end != 32)
    end = end[: max(said[-1] + 1 if len(said) else 0, HEIGHT * UNIT)]
    return [*frames[:-1], end[-HEIGHT * UNIT :]]


def store_text(data: bytes) -> bytes:
    """The AVI file of a text: payload padded with spaces to rows of 192 samples, 8 rows in a frame.

    The last frame is filled up with zero rows; the number of payload rows stands in the ``note`` chunk.
    """
    payload = data + b" " * (-len(data) % UNIT or (0 if data else UNIT))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    rows, step = len(samples), 64 * HEIGHT
    if fill := -rows % HEIGHT:
        samples = np.concatenate([samples, np.zeros((fill, UNIT), np.uint8)])
    coded = [r for k in range(0, len(samples), step) for r in encode_rows(samples[k : k + step])]
    return write_avi([_frame(coded[k : k + HEIGHT], HEIGHT) for k in range(0, len(coded), HEIGHT)], UNIT, HEIGHT, RATE, struct.pack("<Q", rows))


def read_texts(files: list[bytes]) -> list[tuple[bytes, list[np.ndarray], dict]]:
    """Payload, frames and parsed header of files made by ``store_text``; all are decoded together."""
    infos = [parse_avi(f) for f in files]
    decoded, at, out = decode_frames([f[a:b] for f, i in zip(files, infos) for a, b in i["frames"]]), 0, []
    for info in infos:
        frames = decoded[at : at + len(info["frames"])]
        at += len(frames)
        out.append((np.concatenate(frames)[: struct.unpack("<Q", info["note"])[0]].tobytes(), frames, info))
    return out


def clip_rows(table: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Timed clip rows of a column of AVI files: id, clip, first_frame, frames, start_s, end_s, peak_difference.

    Null or malformed files give one row with clip null and an error text. Other columns are ignored.
    """
    rows = only(table, id_col, media_col).select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    info = parse_avi(media.as_py() or b"")
                    shots, diff = detect_shots(payload_frames(decode_frames([media.as_py()[a:b] for a, b in info["frames"]]), info["note"]))
                    rate = info["rate"] or 1.0
                    out += [(key, k, a, b - a, a / rate, b / rate, max(diff[a:b]), None) for k, (a, b) in enumerate(shots)]
                except (ArithmeticError, AttributeError, LookupError, TypeError, ValueError, struct.error, StopIteration) as e:  # whatever a damaged file may lead to
                    out.append((key, None, None, None, None, None, None, str(e) or type(e).__name__))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()))], ["id", "clip", "first_frame", "frames", "start_s", "end_s", "peak_difference", "error"])

    return rows.mapInArrow(tidy(cut), "id string, clip int, first_frame int, frames int, start_s double, end_s double, peak_difference double, error string")


_FIELDS = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_clips", pa.int64()))


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an AVI file, read the file's bytes back, and describe payload, file and clips.

    One row for each input row. Null texts count as empty; a null id is kept; equal texts give equal values.
    ``feature`` lists the clips as start-end@peak (seconds, difference in thousandths). Files live only while
    their row is worked on; memory holds one text's file and one batch of texts.
    """
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))

    def described(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        files, out = [store_text(t) for t in texts], []
        for doc_id, data, media, (payload, frames, info) in zip(ids, texts, files, read_texts(files)):
            shots, diff = detect_shots(payload_frames(frames, info["note"]))
            rate = info["rate"]
            feature = ";".join(f"{a / rate:.2f}-{b / rate:.2f}@{round(1000 * max(diff[a:b]))}" for a, b in shots)
            out.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), len(shots)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _FIELDS)], [n for n, _ in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(data.as_py())
                size += len(texts[-1])
                if size >= _TOGETHER:
                    yield described(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield described(ids, texts)

    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_clips long")

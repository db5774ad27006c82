import hashlib
import os
import random
import time
import struct
import zlib

import numpy as np
import pytest

from attestor.llm import media


@pytest.mark.parametrize("data", [b"", b"a" * 191, b"x" * 192, bytes(range(256)) * 9, b"\xff" * 3000, b"\x00\xff" * 999, os.urandom(40_000)])
def test_text_round_trip(data):
    payload, frames, info = media.read_texts([media.store_text(data)])[0]
    assert payload[: len(data)] == data and len(payload) % 192 == 0 and len(payload) >= 192 and set(payload[len(data) :]) <= {32}
    assert info["indexed"] and len(frames) == -(-len(payload) // (192 * media.HEIGHT)) and info["rate"] == media.RATE


def test_index_and_walk_agree_and_damage_raises():
    data = media.store_text(os.urandom(9000))
    cut = data[: data.rindex(b"idx1")]
    bare = b"RIFF" + struct.pack("<I", len(cut) - 8) + cut[8:]
    assert media.parse_avi(bare)["frames"] == media.parse_avi(data)["frames"] and not media.parse_avi(bare)["indexed"]
    for bad in (b"", b"RIFF", data[:300], b"x" * 500):
        with pytest.raises((ValueError, struct.error)):
            media.parse_avi(bad)


def _baseline(blocks, across, down):
    """A gray baseline JPEG of given quantised blocks (zigzag order), with plain four- and eight-bit codes."""
    dc, ac = {s: (s, 4) for s in range(12)}, {s: (k, 8) for k, s in enumerate([0, 0xF0, *(r * 16 + n for r in range(15) for n in range(1, 9))])}
    bits, last = "", 0

    def signed(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    for b in blocks:
        n, extra = signed(int(b[0]) - last)
        last = int(b[0])
        bits += format(dc[n][0], "04b") + extra
        run = 0
        for v in map(int, b[1:]):
            if not v:
                run += 1
                continue
            while run > 14:
                bits += format(ac[0xF0][0], "08b") if run > 15 else ""
                run -= 16 if run > 15 else 0
                if run == 15:
                    raise AssertionError("the test's table has no run of 15")
            n, extra = signed(v)
            bits, run = bits + format(ac[run * 16 + n][0], "08b") + extra, 0
        bits += format(ac[0][0], "08b") if run else ""
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table = lambda cls, codes, n: bytes([cls]) + bytes(len(codes) if k == n else 0 for k in range(1, 17)) + bytes(codes)
    seg = media._segment
    return b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([3] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + bytes([1, 0x11, 0])) + seg(0xC4, table(0, list(dc), 4)) + seg(0xC4, table(16, list(ac), 8)) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"


def test_baseline_frames_decode():
    rng = np.random.default_rng(3)
    blocks = np.zeros((6, 64), int)
    blocks[:, 0] = rng.integers(-40, 40, 6)
    blocks[:, 1:12] = rng.integers(-9, 9, (6, 11))
    blocks[2, 1:] = 0
    got = media.decode_frames([_baseline(blocks, 3, 2)])[0][:, :, 0]
    assert got.shape == (16, 24)
    basis = media._BASIS
    for k, b in enumerate(blocks):
        grid = np.zeros(64)
        grid[media._ZIGZAG] = b * 3
        want = np.clip(np.rint(basis.T @ grid.reshape(8, 8) @ basis + 128), 0, 255)
        assert np.abs(got[8 * (k // 3) : 8 * (k // 3) + 8, 8 * (k % 3) : 8 * (k % 3) + 8] - want).max() <= 1


def test_shots_are_cut_where_histograms_jump():
    dark, light = [np.full((8, 192), 10 + k, np.uint8) for k in range(5)], [np.full((8, 192), 200 + k % 2, np.uint8) for k in range(4)]
    assert media.detect_shots(dark + light)[0] == [(0, 5), (5, 9)]
    assert media.detect_shots([]) == ([], []) and media.detect_shots(dark[:1])[0] == [(0, 1)]


def test_stored_texts(spark, documents, odd_rows):
    rows = media.stored_texts(documents(odd_rows)).collect()
    assert sorted(str((r.doc_id, r.n_bytes)) for r in rows) == sorted(str((i, len((t or "").encode()))) for i, t in odd_rows)
    assert len({(r.payload_sha256, r.tail_crc32, r.media_sha256, r.feature) for r in rows if r.n_bytes == 11 and r.doc_id in (4, None)}) == 1
    assert media.stored_texts(documents([])).count() == 0


def plain_feature(payload):
    """Clips of a payload by the definition, without the module's arrays: 8 rows of 192 samples a frame, 25 a second."""
    size = 8 * 192
    frames = [payload[k : k + size] for k in range(0, len(payload), size)]
    if len(frames) > 1:  # the last frame's worth of the text, without the spaces at its end
        tail = (frames[-2] + frames[-1]).rstrip(b" ")
        frames[-1] = tail[-size:] if len(tail) > size else frames[-2]
    hists = []
    for f in frames:
        h = [0] * 32
        for x in f:
            h[x >> 3] += 1
        hists.append([n / size for n in h])
    diff = [0.0] + [sum(abs(a - b) for a, b in zip(x, y)) / 2 for x, y in zip(hists, hists[1:])]
    cuts = [0]
    for k in range(1, len(frames)):
        past = diff[max(1, k - 8) : k]
        mean = sum(past) / len(past) if past else 0.0
        limit = mean + 3 * (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5 if past else 0.0
        if diff[k] >= 0.15 and diff[k] > limit:
            cuts.append(k)
    return ";".join(f"{a / 25:.2f}-{b / 25:.2f}@{round(1000 * max(diff[a:b]))}" for a, b in zip(cuts, [*cuts[1:], len(frames)]))


def test_every_column_by_brute_force(spark, documents):
    rng = random.Random(8)
    texts = [None, "", "a" * 192, "b" * 193, "ü" * 1000, "".join(rng.choice("abc \n") for _ in range(4000)), "x" * 5000 + "\u7fff" * 4000 + "y" * 3000, " ".join(str(rng.random()) for _ in range(900))]
    got = {r.doc_id: r for r in media.stored_texts(documents(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (192 if not data else -len(data) % 192)
        r, stored = got[k], media.store_text(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and stored[:4] == b"RIFF" and stored[8:12] == b"AVI "
        assert r.feature == plain_feature(payload)


def test_damaged_media_give_error_rows(spark):
    frames = [media._frame(media.encode_rows(np.full((8, 192), v, np.uint8)), 8) for v in (10, 200)]
    good = media.write_avi(frames, 192, 8)
    at = good.index(b"\xff\xc3")
    bad = [good[: at + 11] + b"\x00" + good[at + 12 :], good[: at + 5] + b"\xff\xff\xff\xff" + good[at + 9 :], good[: at + 5] + b"\x00\x00" + good[at + 7 :]]
    blocks = np.zeros((1, 64), int)
    jpeg = _baseline(blocks, 1, 1)
    c0 = jpeg.index(b"\xff\xc0")
    bad.append(media.write_avi([jpeg[: c0 + 11] + b"\x00" + jpeg[c0 + 12 :]], 8, 8))
    bad.append(media.write_avi([jpeg[: c0 + 5] + b"\xff\xff\xff\xff" + jpeg[c0 + 9 :]], 8, 8))
    rng = random.Random(1)
    for _ in range(150):
        x = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        bad.append(bytes(x[: rng.randrange(len(x) // 2, len(x) + 1)]))
    out = media.clip_rows(spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(bad)], "id int, m binary"), "id", "m").collect()
    assert {int(r.id) for r in out} == set(range(len(bad))) and all(any(r.error for r in out if r.id == str(k)) for k in range(5))


def test_clip_rows(spark):
    frames = [media._frame(media.encode_rows(np.full((8, 192), v, np.uint8)), 8) for v in (10, 10, 10, 200, 200)]
    avi = media.write_avi(frames, 192, 8)
    out = media.clip_rows(spark.createDataFrame([(1, bytearray(avi)), (2, None), (3, bytearray(b"junk"))], "id int, m binary"), "id", "m").orderBy("id", "clip").collect()
    assert [(r.id, r.first_frame, r.frames) for r in out] == [("1", 0, 3), ("1", 3, 2), ("2", None, None), ("3", None, None)]
    assert out[1].start_s == pytest.approx(3 / 25) and out[2].error and out[3].error


def test_padding_is_no_shot():
    """A text that says one thing has one clip, wherever it ends."""
    line = b"the same sentence again and again, as it was said before. "
    for size in [*range(1, 6400, 61), *range(1530, 1545), 3072, 3073, 4607, 4609]:
        payload, frames, info = media.read_texts([media.store_text((line * 120)[:size])])[0]
        assert len(media.detect_shots(media.payload_frames(frames, info["note"]))[0]) == 1, size
    change = line * 60 + b"0123456789" * 60
    payload, frames, info = media.read_texts([media.store_text(change)])[0]
    assert len(media.detect_shots(media.payload_frames(frames, info["note"]))[0]) == 2
    assert media.payload_frames([], None) == [] and len(media.payload_frames(frames, None)) == len(frames)


def test_bits_of_long_scans():
    rng = random.Random(3)
    data = rng.randbytes(400_000)
    whole, bits, at = int.from_bytes(data[:64], "big"), media._Bits(data), 0
    for _ in range(40):
        n = rng.randrange(0, 13)
        assert bits.peek16() == (whole >> (512 - at - 16)) & 65535 if at <= 496 else True
        assert bits.take(n) == (whole >> (512 - at - n)) & ((1 << n) - 1)
        at += n
    began = time.time()
    while bits.at + 16 <= bits.size:
        bits.take(16)
    assert time.time() - began < 3
    with pytest.raises(ValueError, match="ends early"):
        bits.take(17)

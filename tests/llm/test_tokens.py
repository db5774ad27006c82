import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestor.llm import packing, records
from attestor.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_ids_are_the_librarys(path):
    enc, want, rng = Encoder(path, most=50), library(path), random.Random(2)
    letters = [chr(k) for k in [9, 10, 13, *range(32, 127), *range(0xA0, 0x260), 0x301, 0x4E00, 0x1F600, 0x1C, 0x85]]
    texts = ["".join(rng.choice(letters if rng.random() < 0.4 else " \n\t'a.1sS") for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    for t in texts + ["<|endoftext|> a", "a<|endoftext|>", "x <|startoftext|> y", "<|ENDOFTEXT|>", "<|endof", "|>", " a", "a ", "a  b", "a \n b", "a\n\nb", "a\nb\nc d\ne", "x.\nY z\n's", "a " + "b" * 100, "don't  stop's 12 ab12"]:
        assert enc.ids(t.encode()).tolist() == want(t), repr(t)
    assert [x.tolist() for x in Encoder(path).many([t.encode() for t in texts])] == [want(t) for t in texts] and len(enc.cache) <= 50 + 4000


def test_crc32c_and_mask():
    assert records.crc32c([b"123456789", bytes(32)]).tolist() == [0xE3069283, 0x8A9136AA]
    data = [bytes(random.Random(k).randbytes(4 + k * 37 % 3000)) for k in range(60)]
    table = records._T[0].tolist()

    def plain(x):
        c = 0xFFFFFFFF
        for b in x:
            c = table[(c ^ b) & 255] ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    assert records.crc32c(data).tolist() == [plain(x) for x in data]


def test_records_round_trip(spark, documents, odd_rows):
    manifest = records.write_documents(documents(odd_rows), BYTES, 0)
    got = records.scan_documents(spark, manifest).collect()
    want = library(BYTES)
    full = {(str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in odd_rows for x in [want(t) + [0]]}
    assert {(str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got} == full and len(got) == len(odd_rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(-1 if i is None else i for i, _ in odd_rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    f = max(manifest.collect(), key=lambda r: r.records)
    index = records.read_index(f.index_path)
    order = np.random.default_rng(1).permutation(len(index))
    for e, p in zip(index[order], records.read_at(f.path, index[order])):
        doc_id, ids = records.parse_payload(p)
        assert len(ids) == e["tokens"] and (doc_id or 0) == e["doc_id"]
    assert records.scan_documents(spark, records.write_documents(documents([]), BYTES, 0)).count() == 0


def test_damaged_records_raise(tmp_path):
    data, _ = records.frame([records.payload(1, np.arange(50, dtype=np.uint32)), records.payload(None, np.array([70000], np.uint32))])
    path = tmp_path / "a.rec"
    path.write_bytes(data)
    assert [records.parse_payload(p)[0] for p in records.read_records(f"file://{path}")] == [1, None]
    for bad in (data[:-3], data[:20] + b"\x01" + data[21:]):
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            list(records.read_records(f"file://{path}"))


def first_fit(lengths, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((k for k, r in enumerate(rooms) if r >= lengths[i]), None)
        if b is None:
            rooms.append(capacity)
            b = len(rooms) - 1
        out[i] = (b, capacity - rooms[b])
        rooms[b] -= lengths[i]
    return [out[i] for i in range(len(lengths))]


def test_tournament_is_first_fit_decreasing():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        lengths = rng.integers(1, 65, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 64)
        assert list(zip(bins.tolist(), offsets.tolist())) == first_fit(lengths.tolist(), 64)


def test_packing(spark, documents, odd_rows, small):
    d = small("documents", "/root/testdata/sf0.001")
    rows = odd_rows + list(zip((d.doc_id + 100).tolist(), d.text.tolist()))
    got = packing.pack_documents(documents(rows), WORDS, group_rows=60).toPandas()
    want = library(WORDS)
    ids = {i: np.array(want(t) + [1], "<u4") for i, t in rows if i is not None}
    assert int(got.length.sum()) == sum(len(want(t)) + 1 for _, t in rows) and got.length.between(1, 2048).all()
    for r in got[got.doc_id.notna()].itertuples():
        x = ids[int(r.doc_id)]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.9
    assert packing.pack_documents(documents([]), WORDS).count() == 0

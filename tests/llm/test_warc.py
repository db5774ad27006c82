import hashlib
import struct

import zstandard

from attestor.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, k int, low string, path string"


def rows(spark, items):
    return spark.createDataFrame([(i, u, h, "d", 1, "l", "p") for i, u, h in items], SCHEMA)


def test_archives_match_brute_force(spark):
    big = "<p>" + "z" * 200 + "é</p>"
    items = [(5, "http://a/b c", big), (2, "http://a", big), (2, "http://a", big), (9, None, None), (None, "u", big), (7, "u", "short"), (8, "u", "short"), (10, "u", ""), (-4, "v", "y" * 100), (11, "v", "y" * 100)]
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(rows(spark, items)).collect())
    want = []
    for i, _, h in items:
        data = (h or "").encode()
        same = [j for j, _, g in items if (g or "").encode() == data and j is not None]
        first = min(same) if len(data) >= 100 and same else i
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(want)
    assert warc.archive_pages(rows(spark, [])).count() == 0


def test_archive_layout_and_rolling(spark):
    pages = rows(spark, [(k, f"http://h/{k}", f"<html><body class='page number'>{k * 7919 % 1000} text and more text {'word ' * (k % 50)}</body></html>") for k in range(1500)]).coalesce(1)
    manifest = warc.write_archives(warc.classified(pages).coalesce(1), archive_bytes=30_000, sample_bytes=200_000)
    files = manifest.collect()
    assert len(files) > 1 and sum(f.records for f in files) == 1500
    for f in sorted(files, key=lambda f: -f.records)[:1]:
        data = open(f.path.removeprefix("file://"), "rb").read()
        magic, n = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC and len(data) > 8 + n
        found = list(warc.read_archive(data))
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + n])
        at, raw = found[3]
        assert zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[at:]).startswith(raw[:50])
    assert warc.read_archives(manifest).count() == 1500


def test_record_parses_back():
    raw = warc.warc_record(-12, "http://x/ y", b"a\r\n\r\nb", "ff", None)
    r = warc.parse_record(raw)
    assert r["payload"] == b"a\r\n\r\nb" and warc._number(r["fields"]["warc-record-id"]) == -12
    assert b" y" not in raw and warc.parse_record(warc.warc_record(3, None, b"abc", "ff", 2))["payload"] == b""

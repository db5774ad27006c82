import hashlib
import re

import pytest

from attestor.llm import decontaminate as dc


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, width=10):
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            if not v or item is None:
                continue
            for k in range(max(1, len(v) - width + 1)):
                win = v[k : k + width]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(item))
        ids = sorted(found)
        out.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [(2, "One two three four five six seven eight nine ten eleven twelve"), (10, "short item here"), (3, None), (None, "no id at all"), (4, "..."), (5, "e é ü e é ü e é ü e é ü"), (10, "short item here")]
TEXT = "zero ONE two, three four five six seven eight nine ten eleven! twelve thirteen"


@pytest.mark.parametrize("block_words,shard_tokens", [(100_000, 1 << 20), (8, 10)])
def test_matches_brute_force(spark, documents, odd_rows, block_words, shard_tokens):
    rows = odd_rows + [(20, TEXT), (21, TEXT + " " + TEXT), (22, "short item"), (23, "here"), (24, "a short item here short item here b"), (25, "e é ü " * 6), (26, "two three four five six seven eight nine ten"), (20, TEXT)]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, n_words int")
    out = dc.contamination(documents(rows), items, block_words=block_words, shard_tokens=shard_tokens).collect()
    got = sorted((str(r.doc_id), r.n_words, sum(s.b - s.a for s in r.spans), len(r["items"]), dc.digest(r["items"]), bool(r.spans)) for r in out)
    assert got == brute(rows, ITEMS)
    spans = next(r for r in out if r.doc_id == 21).spans
    assert [(s.a, s.b) for s in spans] == [(1, 13), (15, 27)]


def test_report_and_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    (r,) = dc.contamination_report(documents([(1, "a b")]), none).collect()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False) and r.items_sha256 == hashlib.sha256(b"").hexdigest()
    assert dc.contamination_report(documents([]), none).count() == 0


def test_proximity(spark, documents):
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = [(1, "blue x red y green"), (2, "red green q q q q q q blue"), (3, "red blue")]
    near = {r.doc_id: len(r.spans) for r in dc.contamination(documents(rows), items, slop=4).collect()}
    assert near == {1: 1, 2: 0, 3: 0}


def test_index_holds_every_term(spark, documents):
    index = dc.build_index(documents([(1, "b a b"), (2, "a c"), (3, None)]), ["doc_id"], shard_tokens=3)
    shards = {}
    for r in index.collect():
        ((terms, ends, steps),) = dc._shards([r.path], [r.batch], 0, 1, 2)
        number = {t: k for k, t in enumerate(terms.to_pylist())}
        postings = dc._Postings(number, dc.np.arange(len(number)), ends.to_numpy(), steps.to_numpy())
        shards.update({(i, t): (postings.get(t) - s).tolist() for (i, s) in zip(r.ids[0], r.starts) for t in number if len(r.starts) == 1})
    assert shards.get((1, b"b"), [0, 2]) == [0, 2] and dc.frequencies(index, [b"a", b"b", b"z"]) == {b"a": 2, b"b": 2}
    assert sorted(r.n_words for r in dc._documents(index, ["doc_id"]).collect()) == [0, 2, 3]


def test_clean_documents(spark, documents, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents([(1, TEXT), (2, "clean text"), (None, TEXT), (None, None)], tmp_path / "d")
    assert sorted(str(r.doc_id) for r in dc.clean_documents(docs, items).collect()) == ["2", "None"]

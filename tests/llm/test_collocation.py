import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from attestor.llm import collocation


def brute(rows, longest=3, least=10, covered=50, top=2000):
    out, rows = [], [("und" if lang is None else lang, text) for lang, text in rows]
    for lang in {r[0] for r in rows}:
        f, n = Counter(), 0
        for _, text in [r for r in rows if r[0] == lang]:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        good, mine = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def check(spark, rows, schema="doc_id long, lang string, text string, n int, phrase string, share int", **options):
    df = spark.createDataFrame([(k, lang, text, 1, "p", 2) for k, (lang, text) in enumerate(rows)], schema)
    got = collocation.collocations(df, **options).collect()
    assert sorted(map(tuple, got)) == brute(rows, **{k: v for k, v in options.items() if k != "bits"})
    return got


def texts(count, words, seed=1):
    rng = random.Random(seed)
    vocabulary = ["Ab", "cd", "Éf", "ab", "x\x00y", "漢字", "i j", "k-l", "\U0001f600", "m"][:words]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", "  "]) for _ in range(rng.randrange(60)))) for _ in range(count)]


@pytest.mark.parametrize("bits", [4, 9, 25])
def test_equal_to_brute_force_whatever_the_bitmaps_size(spark, bits):
    assert check(spark, texts(120, 10), least=4, bits=bits)


def test_longer_phrases_and_few_ranks(spark):
    assert {len(r.phrase.split()) for r in check(spark, texts(200, 4, 3), longest=5, least=3, covered=90, bits=12)} == {2, 3, 4, 5}
    check(spark, texts(150, 8, 5), longest=2, least=3, top=5, bits=12)


def test_odd_rows(spark, odd_rows):
    rows = [("en", t) for _, t in odd_rows] + [(None, "a b c d") for _ in range(12)] + [("", "a b c d. " * 5)] * 2
    check(spark, rows, bits=12)
    assert check(spark, [], bits=12) == [] == check(spark, [("en", None), (None, " \t.,")], bits=12)


def test_parts_and_held_counts_lose_nothing(monkeypatch):
    rows = texts(200, 10, 7)
    monkeypatch.setattr(collocation, "_CHUNK", 50)
    monkeypatch.setattr(collocation, "_HELD", 10)
    batch = pa.record_batch({"lang": ["und" if x is None else x for x, _ in rows], "text": pa.array([t.encode() for _, t in rows])})
    got = Counter()
    for out in collocation._pass(2, 2, 1, 10, None)(iter([batch, batch])):
        for lang, phrase, n in zip(*(out.column(k).to_pylist() for k in range(3))):
            got[lang, phrase] += n
    want = {(r[0], r[2]): r[3] for r in brute(rows * 2, longest=2, least=1)}
    assert got == want
    assert list(collocation._parts(b"ab " * 20 + b"cd.ef"))[1] == b"ef"


def test_counts_of_every_language_travel_exactly(spark):
    big = [("en", "p q r")] * 3_000 + [("de", "p q r")] * 9
    got = check(spark, big, bits=10)
    assert [(r.lang, r.phrase, r.a, r.score) for r in got] == [("en", "p q r", 3000, 1000000)]

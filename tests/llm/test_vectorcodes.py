import math
import random

import numpy as np

from attestor.llm import vectorcodes
from attestor.llm.vectorcodes import nearest


def brute(rows, parts, entries, rounds):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts
    cut = lambda v, p: tuple(math.floor(256 * x) for x in v[p * width : (p + 1) * width])
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]
    best = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in rows:
                groups.setdefault(best(cut(r[1], p), p)[1], []).append(cut(r[1], p))
            books[p] = [tuple(sum(x) // len(groups[k]) for x in zip(*groups[k])) if k in groups else c for k, c in enumerate(books[p])]
    found = [[best(cut(r[1], p), p) for p in range(parts)] for r in rows]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for r, e in zip(rows, errors):
        total[r[2]] = total.get(r[2], 0) + e
    digest = vectorcodes.Codebooks(np.array(books, np.int64)).digest()
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in f), e, total[r[2]], digest) for r, f, e in zip(rows, found, errors))


def check(spark, rows, parts=4, entries=8, rounds=2):
    df = spark.createDataFrame([(i, v, label, "x", 1, "c") for i, v, label in rows], "vec_id long, embedding array<float>, label int, id string, error int, code string")
    got = vectorcodes.encode(df, vectorcodes.fit(df, parts=parts, entries=entries, rounds=rounds)).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], parts, entries, rounds)


def vectors(n, width, seed=3, spread=1.0):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, spread) for _ in range(width)], rng.choice([0, 1, None])) for k in range(n)]


def test_equal_to_brute_force(spark):
    check(spark, vectors(300, 16))
    check(spark, vectors(40, 12, spread=0.01), entries=40)  # many ties and unused entries
    check(spark, vectors(5, 8), entries=64)


def test_odd_rows(spark):
    rows = vectors(30, 8) + [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, None), (7, [0.5] * 8, 1), (7, [0.5] * 8, 1), (None, [-0.001] * 8, None)]
    check(spark, rows)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectorcodes.encode(df, vectorcodes.fit(df)).count() == 0
    ragged = spark.createDataFrame([(0, [1.0] * 16, 1), (1, [1.0] * 32, 1), (2, [], 1), (3, [1.0] * 17, 1), (4, [1e30] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in vectorcodes.encode(ragged, vectorcodes.fit(ragged)).collect()] == [0]


def test_partial_distances_find_the_nearest_and_the_lowest_of_ties():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 16):
        for high in (2, 6, 2**25):
            rows, entries = rng.integers(-high, high, (500, width)), rng.integers(-high, high, (70, width))
            every = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
            at, best = nearest(rows, entries)
            assert (at == every.argmin(1)).all() and (best == every.min(1)).all()

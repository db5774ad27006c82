import random
import re

import numpy as np
import pytest
import xxhash

from attestor.llm import simhash, softkeys
from attestor.llm.shared import components


def brute_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def expected(rows, words=4):
    fps = [brute_fingerprint(t, words) for _, t in rows]
    roots = brute_components(fps, 4)
    low = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted((str(i), f"{f:016x}", low.get(r)) for (i, _), f, r in zip(rows, fps, roots))


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    assert (np.bitwise_count(simhash._ERRORS[simhash.syndrome(words)]) <= 3).all()
    code = words[simhash.syndrome(words) == 0]
    assert len(code) == 4096 and np.array_equal(simhash.decode(code), code >> 11)


def test_fingerprints_in_reach_share_a_key():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base]
    keys = []
    for fps in (base, near):
        rows, k = simhash.golay_keys(np.array(fps, np.uint64))
        keys.append([set(k[rows == i].tolist()) for i in range(len(fps))])
    assert all(a & b for a, b in zip(*keys))
    assert max(map(len, keys[0])) < 400 and not any(keys[0][i] & keys[0][i + 1] for i in range(0, 40))


@pytest.mark.parametrize("dense", [256, 3])
def test_links_match_brute_force(spark, dense):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for b in fps[:6]:
        fps += [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for _ in range(25)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = dict(simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, dense).collect())
    roots = brute_components(fps, 4)
    low = {r: min(s for s, x in zip(signed, roots) if x == r) for r in set(roots)}
    assert [got.get(s, s) for s in signed] == [low[r] for r in roots]


def test_near_duplicates_on_documents(spark, documents, odd_rows, small):
    d = small("documents", "/root/testdata/sf0.001")
    rows = odd_rows + list(zip((d.doc_id + 100).tolist(), d.text.tolist()))
    got = simhash.near_duplicates(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected(rows)
    assert simhash.near_duplicates(documents([])).count() == 0


def test_one_of_each(spark, documents, tmp_path):
    text = " ".join(f"w{k}" for k in range(3000))
    rows = [(9, text), (3, text), (3, text), (4, text.replace("w200 ", "other ")), (5, "alone here"), (None, "x y"), (None, "x y"), (6, None), (7, "")]
    got = simhash.one_of_each(documents(rows, tmp_path / "d")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "5", "6", "None"] and len(got[0]) == 26 and all(r.file_key_ == 'f' and r.node == 'v' for r in got)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(500, 600)] + [(1, 1), (2, 3), (3, 2)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in range(101, 161)} == {100} and 100 not in got and {got[k] for k in range(500, 600)} == {7} and got[3] == 2 and 1 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_at_the_limit(spark, documents, tmp_path):
    """Near copies on both sides of similarity 0.8 against brute force, in groups of two and one of hundreds."""
    rng = random.Random(5)

    def text(n):
        return [f"t{rng.randrange(5000)}" for _ in range(n)]

    def changed(words, most):
        out = list(words)
        for k in rng.sample(range(len(out)), most):
            out[k] = f"x{rng.randrange(10**6)}"
        return out

    texts = []
    for n in (80, 150, 300, 900):
        for share in (0.004, 0.01, 0.015, 0.03, 0.06):
            for _ in range(4):
                texts += [base := text(n), changed(base, max(1, int(share * n)))]
    base = text(200)
    texts += [changed(base, 1) for _ in range(300)] + [text(100) for _ in range(100)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    holders: dict[tuple, list[int]] = {}
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    checked, linked = set(), 0
    for k, s in enumerate(sets):
        for other in {o for x in s for o in holders.get(x, ())} - {k}:
            shared = len(s & sets[other])
            if shared >= 0.8 * (len(s) + len(sets[other]) - shared):
                a, b = sorted((root(k), root(other)))
                parent[b] = a
                linked += 1
        for x in s:
            holders.setdefault(x, []).append(k)
    want = {root(k) for k in range(len(texts))}
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id for r in simhash.one_of_each(documents(rows, tmp_path / "d")).collect()}
    assert want <= got, "a document left although none of its like stays"
    assert len(got - want) <= 2 and linked > 1000 and len(want) < len(texts) - 300


def test_soft_keys_meet_near_the_limit():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(100):
        one, two, both = (np.unique(rng.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64) for n in (30, 30, 240))
        x, y = (np.frombuffer(softkeys.sketch(np.sort(np.r_[both, s])), np.int8)[None] for s in (one, two))
        met += bool(set(softkeys.soft_keys(x)[0].tolist()) & set(softkeys.soft_keys(y)[0].tolist()))
        assert abs(softkeys.estimates([softkeys.signature(np.sort(np.r_[both, one]))], [softkeys.signature(np.sort(np.r_[both, two]))])[0] - 0.8) < 0.08
    assert met >= 92


@pytest.mark.parametrize("block", [8192, 60])
def test_pairs_inside_a_crowded_group_are_found(spark, documents, tmp_path, monkeypatch, block):
    """A hub of edits that are above the limit to their original alone, and below it to one another."""
    monkeypatch.setattr(simhash, "_BLOCK", block)
    rng = random.Random(11)
    base = [f"t{k}" for k in range(400)]
    texts = []
    for _ in range(500):
        edit = list(base)
        for k in range(rng.randrange(5, 50), 395, 56):
            edit[k + rng.randrange(5)] = f"x{rng.randrange(10**9)}"
        texts.append(edit)
    texts.append(base)
    sets = [{tuple(t[k : k + 5]) for k in range(396)} for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert min(alike(i, 500) for i in range(500)) > 0.82
    assert sum(alike(i, j) < 0.8 for i in range(0, 500, 9) for j in range(i)) > 0.95 * sum(range(0, 500, 9))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id for r in simhash.one_of_each(documents(rows, tmp_path / "d")).collect()}
    assert got == {0}


def test_every_near_pair_of_a_key_is_given():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 9, 300))
    sign = rng.integers(-(2**62), 2**62, 6)[rng.integers(0, 6, 300)] ^ (1 << rng.integers(0, 60, 300))
    root, side = rng.integers(0, 4, 300), rng.integers(0, 2, 300)
    near = np.bitwise_count((sign[:, None] ^ sign).view(np.uint64)) <= softkeys.MOST_SIGNS
    pairs = {(i, j) for i in range(300) for j in range(i + 1, 300) if near[i, j]}
    assert set(zip(*softkeys.close_pairs(key, sign))) == {(i, j) for i, j in pairs if key[i] == key[j]}
    for s in (side, side * 0):
        got = {p for x, y in softkeys.apart(sign, root, s, 64) for p in zip(x, y)}
        assert got == {(i, j) for i, j in pairs if root[i] != root[j] and (s[i] != s[j] or not s.any())}


@pytest.mark.parametrize("block", [8192, 7])
def test_all_pairs_between_components_of_a_key_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "_BLOCK", block)
    rng = random.Random(6)
    bulk = {k: rng.choice([0, 0, 0, 1, 2, 3, None]) for k in range(90)}  # the component of node 0 holds the most
    crowded = spark.createDataFrame([(k % 2 and 1 or 0, k, rng.choice([0, -1])) for k in bulk] + [(5, 200, 0), (5, 201, 0)], "key long, node long, sign long")
    roots = spark.createDataFrame([(k, 1000 + r) for k, r in bulk.items() if r is not None] + [(200, 7), (201, 7)], "node long, root long")
    signatures = spark.createDataFrame([(k, bytearray([1] * softkeys.BINS)) for k in [*bulk, 200, 201]], "node long, signature binary")
    got = sorted((r.a, r.b) for r in simhash._left_apart(crowded, roots, signatures, 0.8).collect())
    sign = {r.node: r.sign for r in crowded.collect()}
    own = lambda k: k if bulk[k] is None else 1000 + bulk[k]
    assert got == [(a, b) for a in range(90) for b in range(a + 1, 90) if a % 2 == b % 2 and sign[a] == sign[b] and own(a) != own(b)]

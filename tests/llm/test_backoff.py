import math
from collections import Counter

import numpy as np
import pytest

from attestor.llm import backoff
from attestor.llm.decontaminate import words


def brute(rows, order, alpha, least, held_out):
    docs = [[w.decode() for w in words((t or "").encode())] for _, t in rows]
    grams = lambda d: Counter(tuple(d[k - n + 1 : k + 1]) for n in range(1, order + 1) for k in range(n - 1, len(d)))
    every, out = Counter(), []
    for d in docs:
        every.update(grams(d))
    for (i, _), d in zip(rows, docs):
        own = grams(d) if held_out else Counter()
        total = max(1, sum(map(len, docs)) - (len(d) if held_out else 0))
        c = lambda g: every[g] - own[g]  # noqa: B023, E731

        def s(gram):
            if len(gram) == 1:
                return math.log(max(c(gram), 1) / total)  # noqa: B023
            if c(gram) >= least:  # noqa: B023
                return math.log(c(gram) / c(gram[:-1]))  # noqa: B023
            return math.log(alpha) + s(gram[1:])

        out.append((str(i), len(d), round(sum(s(tuple(d[max(0, k - order + 1) : k + 1])) for k in range(len(d))), 5)))
    return sorted(out)


@pytest.mark.parametrize("order,least,block,held_out", [(3, 2, 1 << 20, False), (3, 1, 40, False), (2, 3, 200, True), (1, 2, 64, False), (4, 2, 100, False), (3, 1, 60, True), (3, 1, 1 << 20, True), (4, 2, 50, True)])
def test_matches_brute_force(spark, documents, odd_rows, order, least, block, held_out):
    long = " ".join(f"w{k % 89} v{k % 7}" for k in range(2500))
    rows = odd_rows[:6] + odd_rows[7:] + [(40 + k, "the cat sat on the mat. " * (k % 3) + f"The cat {k % 4} sat") for k in range(30)] + [(90, long), (91, long)]
    got = backoff.backoff_scores(documents(rows), order, 0.4, least, held_out, block_bytes=block, range_keys=5000).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.log_score, 5)) for r in got) == brute(rows, order, 0.4, least, held_out)


def test_empty(spark, documents):
    assert backoff.backoff_scores(documents([])).count() == 0
    (r,) = backoff.backoff_scores(documents([(1, None)])).collect()
    assert (r.n_tokens, r.log_score, r.mean_log) == (0, 0.0, None)


def test_packing_round_trip():
    for v in ([], [0], [5, 2**56 - 1, 0]):
        assert backoff.unpack(backoff.pack(np.array(v, np.int64))).tolist() == v

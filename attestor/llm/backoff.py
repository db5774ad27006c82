"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

The relations are those of a plain query - count tables of n-grams, partitioned by hash and joined to the
n-grams of the documents, then summed per document - but their rows travel in packed blocks. A block of
documents (a file in the shared folder) sends each hash range the sorted, delta-coded hashes of its distinct
n-grams with their counts; the range sums them, and answers each block with the totals of those of its n-grams that
occur in other blocks too, named by their places in what the block had sent; of all others the block's own count is
the total. Blocks and answers meet by block, where every token is scored. Work grows with the n-grams: a block sends
nothing to ranges in which it has none.

A document can be held out of the counts it is scored with, so that its own words don't speak for it: then c(.) below
are the corpus's counts less the document's, and what it shares with other documents scores high.

S(w | u v) = c(u v w) / c(u v) if c(u v w) >= least; else alpha * S(w | v); S(w | v) likewise with c(v w) / c(v);
S(w) = c(w) / N, a word that is nowhere else counting as one. A document's first tokens start at the order that their
context allows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.decontaminate import words
from attestor.llm.shared import file_system, fresh_path, only, tidy, utf8, written

#: Bits of an n-gram's hash.
BITS = 56
_BLOCK_BYTES = 8 << 20
_RANGE_KEYS = 4_000_000


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: planes of small values vanish."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(np.int64) if len(raw) else np.zeros(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(tokens: np.ndarray, depth: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: positions of the last tokens of n-grams (inside documents) and their hashes.

    ``tokens`` are word hashes (uint64); ``depth`` is each token's number in its document.
    """
    out, h = [], tokens
    for n in range(1, order + 1):
        if n > 1:  # h[i] becomes the hash of the n-gram that ends at i; what runs over a document's start is left out below
            h = _mix(np.r_[h[:1], h[:-1]] * np.uint64(0x9E3779B97F4A7C15) + tokens)
        at = np.flatnonzero(depth >= n - 1)
        out.append((at, (_mix(h[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)))
    return out


_BLOCK = "block string, path string, tokens long"


def token_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """Write documents as blocks of word numbers, a file each, and return the written list of blocks.

    A document larger than a block gets one of its own. Only files in the list count; a task that runs again
    writes new ones.
    """
    base = fresh_path(docs.sparkSession, "token-blocks")
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, counts, numbers, size = [], [], [], 0
        known: dict[bytes, int] = {}

        def block() -> pa.RecordBatch:
            nonlocal ids, counts, numbers, size, known, made
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            n = np.bincount(flat, minlength=len(known))
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            names = list(known)
            hashes = np.array([xxhash.xxh64_intdigest(names[k]) for k in order.tolist()], np.uint64)
            stored = pa.table({"doc_ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "ids": pa.array([pack(rank[flat])], pa.binary()), "hashes": pa.array([hashes.astype("<u8").tobytes()], pa.binary())})
            path = f"{base}/{part:06d}-{made:06d}-{uuid.uuid4().hex[:8]}.arrow"
            fs, at = file_system(path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as f, pa.ipc.new_stream(f, stored.schema) as w:
                w.write_table(stored)
            out = pa.RecordBatch.from_pydict({"block": [f"{part}-{made}"], "path": [path], "tokens": [len(flat)]})
            ids, counts, numbers, size, known, made = [], [], [], 0, {}, made + 1
            return out

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = x.as_py()
                if size and size + len(data) > block_bytes:
                    yield block()
                w = words(data)
                numbers.append(np.fromiter((known.setdefault(v, len(known)) for v in w), np.int64, len(w)))
                ids.append(doc_id)
                counts.append(len(w))
                size += len(data) + 1
        if ids:
            yield block()

    return written(rows.mapInArrow(tidy(run), _BLOCK), "blocks")


def _stored(path: str) -> tuple[list, list[int], bytes, bytes]:
    """doc_ids, counts, ids and hashes of a block."""
    fs, at = file_system(path)
    with fs.open_input_stream(at) as f:
        t = pa.ipc.open_stream(f).read_all()
    return tuple(t.column(k)[0].as_py() for k in range(4))


def _grams(counts: list[int], ids: bytes, hashes: bytes, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    n = np.array(counts, np.int64)
    depth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return depth, gram_hashes(np.frombuffer(hashes, "<u8")[unpack(ids)], depth, order)


def _ranges(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Which hash ranges sorted keys lie in, and where each of these begins."""
    own = keys // -(-(1 << BITS) // ranges)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return own[first], first


def count_answers(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """Rows (block, n, range, places, totals): each block's n-grams that occur in other blocks too, by their places among
    the sorted distinct hashes that the block has in the range, with their counts in the corpus.

    N-gram hashes are dealt to ``ranges`` equal ranges; a range holds a bounded number of keys, as a hot
    n-gram is one key of each block.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, (_, counts, ids, hashes) = batch.column(0)[k].as_py(), _stored(batch.column(1)[k].as_py())
                for n, (_, keys) in enumerate(_grams(counts, ids, hashes, order)[1], 1):
                    keys, times = np.unique(keys, return_counts=True)
                    own, first = _ranges(keys, ranges)
                    out = [(r, name, n, pack(np.diff(keys[a:b], prepend=np.int64(0))), pack(times[a:b])) for r, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["range", "block", "n", "keys", "times"])

    def answer(asked: pa.Table) -> pa.Table:
        names, out, here = asked.column("block").to_pylist(), [], asked.column("range")[0].as_py()
        orders = asked.column("n").to_numpy()
        for n in np.unique(orders).tolist():
            rows = np.flatnonzero(orders == n).tolist()
            keys = [np.cumsum(unpack(asked.column("keys")[r].as_py())) for r in rows]
            times = np.concatenate([unpack(asked.column("times")[r].as_py()) for r in rows])
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals, at = np.bincount(inverse, times, len(distinct)).astype(np.int64)[inverse], 0
            for r, k in zip(rows, keys):
                mine, own = totals[at : at + len(k)], times[at : at + len(k)]
                at += len(k)
                good = np.flatnonzero(mine > own)
                if len(good):
                    out.append((names[r], n, here, pack(np.diff(good, prepend=0)), pack(mine[good])))
        return pa.Table.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "n", "range", "places", "totals"])

    n = blocks.count()
    asked = blocks.repartition(min(max(1, n), 20_000)).mapInArrow(tidy(ask), "range int, block string, n int, keys binary, times binary")
    return asked.groupBy("range").applyInArrow(answer, "block string, n int, range int, places binary, totals binary")


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, least: int = 1, held_out: bool = False, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = _BLOCK_BYTES, range_keys: int = _RANGE_KEYS) -> DataFrame:
    """doc_id, n_tokens, log_score (sum of natural logs over tokens), mean_log (null without tokens).

    Words are runs of ASCII letters (folded), digits and non-ASCII characters. Counts come from all rows,
    repeated rows included; with ``held_out``, a row is scored with the counts of all others. N-grams that occur less
    than ``least`` times back off. Null and empty texts have no tokens and log_score 0. Null ids are kept. An empty
    table gives no rows.
    """
    if least < 1 or order < 1:
        raise ValueError("order and least begin at 1")
    blocks = token_blocks(docs, id_col, text_col, block_bytes)
    total = blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    ranges = max(1, -(-total * order // range_keys))
    answers = count_answers(blocks, order, ranges)

    def score(found: pa.Table) -> pa.Table:
        ids, counts, numbers, hashes = _stored(next(p for p in found.column("path").to_pylist() if p))
        depth, grams = _grams(counts, numbers, hashes, order)
        n, size = found.column("n").to_numpy(), len(depth)
        owner = np.repeat(np.arange(len(counts)), counts)
        log_c = np.full((order + 1, size), -np.inf)  # log count of the n-gram that ends at a token; -inf below the floor
        log_c[0] = np.log(np.maximum(total - np.array(counts, np.int64)[owner], 1) if held_out else max(total, 1))
        for k, (at, keys) in enumerate(grams, 1):
            distinct, inverse, totals = np.unique(keys, return_inverse=True, return_counts=True)
            totals, begin = totals.astype(np.int64), dict(zip(*(x.tolist() for x in _ranges(distinct, ranges))))
            for r in np.flatnonzero(n == k).tolist():
                places = np.cumsum(unpack(found.column("places")[r].as_py()))
                totals[begin[found.column("range")[r].as_py()] + places] = unpack(found.column("totals")[r].as_py())
            c = totals[inverse]
            if held_out:
                _, same, own = np.unique(owner[at] * len(distinct) + inverse, return_inverse=True, return_counts=True)
                c = c - own[same]
            log_c[k, at] = np.where((c >= least) | (k == 1), np.log(np.maximum(c, 1)), -np.inf)
        value = np.full(size, np.nan)
        for k in range(order, 0, -1):
            steps = np.minimum(depth + 1, order) - k  # backed off so often when order k answers
            context = np.r_[0.0, log_c[k - 1, :-1]] if k > 1 else log_c[0]
            use = np.isnan(value) & (depth >= k - 1) & np.isfinite(log_c[k])
            value[use] = log_c[k, use] - context[use] + steps[use] * np.log(alpha)
        sums = np.bincount(owner, value, len(counts))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    out = answers.unionByName(blocks.select("block", "path"), allowMissingColumns=True).groupBy("block").applyInArrow(score, "doc_id long, n_tokens long, log_score double")
    return out.withColumn("mean_log", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), tokens AS (
  SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM words, unnest(range(1, len(w) + 1)) AS t(i)
), d1 AS (SELECT doc_id, c AS x, count(*) AS n FROM tokens GROUP BY 1, 2),
d2 AS (SELECT doc_id, b, c, count(*) AS n FROM tokens WHERE b IS NOT NULL GROUP BY 1, 2, 3),
d3 AS (SELECT doc_id, a, b, c, count(*) AS n FROM tokens WHERE a IS NOT NULL GROUP BY 1, 2, 3, 4),
o1 AS (SELECT doc_id, x, sum(n) OVER (PARTITION BY x) - n AS n FROM d1),
o2 AS (SELECT doc_id, b, c, sum(n) OVER (PARTITION BY b, c) - n AS n FROM d2),
o3 AS (SELECT doc_id, a, b, c, sum(n) OVER (PARTITION BY a, b, c) - n AS n FROM d3),
others AS (SELECT doc_id, greatest((SELECT sum(len(w)) FROM words) - len(w), 1) AS n FROM words),
scored AS (
  SELECT t.doc_id,
    CASE WHEN o3.n >= 1 THEN ln(o3.n) - ln(ab.n)
         WHEN bc.n >= 1 THEN ln(bc.n) - ln(ob.n) + CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END
         ELSE ln(greatest(oc.n, 1)) - ln(others.n) + CASE WHEN t.b IS NULL THEN 0 WHEN t.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS s
  FROM tokens t JOIN others USING (doc_id) JOIN o1 oc ON oc.doc_id = t.doc_id AND oc.x = t.c
  LEFT JOIN o3 ON o3.doc_id = t.doc_id AND o3.a = t.a AND o3.b = t.b AND o3.c = t.c
  LEFT JOIN o2 ab ON ab.doc_id = t.doc_id AND ab.b = t.a AND ab.c = t.b
  LEFT JOIN o2 bc ON bc.doc_id = t.doc_id AND bc.b = t.b AND bc.c = t.c
  LEFT JOIN o1 ob ON ob.doc_id = t.doc_id AND ob.x = t.b
)
SELECT d.doc_id, count(s)::BIGINT AS n_tokens, round(coalesce(sum(s), 0), 3) AS log_score, round(avg(s), 6) AS mean_log
FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id
"""

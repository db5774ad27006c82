"""Benchmark decontamination with a distributed positional inverted index.

The index is written once: a file for each task, with a record batch for each shard, and a table that lists them. A shard
is some documents, up to a number of tokens: the documents' token counts and, for every term of theirs, the sorted
positions of its tokens (counted through the shard, with a gap between documents so that no phrase runs from one into
the next). Test items are matched in blocks, one at a time; each block is broadcast. A shard looks up which of the
block's rarest terms it has, which leads to the phrases that may be there, and answers these by itself: from the phrase's
rarest term on, in order of corpus frequency, position lists are shifted by the term's offset and intersected, so nothing
is shuffled. Only documents with matches are returned from a block.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import HEAVY_ROWS_A_FILE, beside, file_system, fresh_path, kept, located, only, tidy, utf8, written

#: ASCII letters become lower case; letters, digits and bytes above 127 make words; all else parts them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Item words handled at once; each block of items is broadcast and matched by itself, so a broadcast stays this small.
BLOCK_WORDS = 100_000
SHARD_TOKENS = 1 << 18


def words(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in blocks of about ``block_words``; rows without an id or words are left out."""
    block, size = [], 0
    rows = only(benchmark, id_col, text_col).select(F.col(id_col).cast("string").alias("i"), utf8(text_col).alias("t")).where("i is not null")
    for r in rows.toLocalIterator():
        w = words(bytes(r["t"]))
        if w:
            block.append((r["i"], w))
            size += len(w)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def phrases(block: list[tuple[str, list[bytes]]], width: int) -> dict[tuple[bytes, ...], set[str]]:
    """Distinct windows of ``width`` words (a shorter item is one window) and the items that have them."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, w in block:
        for k in range(max(1, len(w) - width + 1)):
            out.setdefault(tuple(w[k : k + width]), set()).add(item)
    return out


_INDEX = "shard string, path string, batch int, ids array<array<long>>, n_words array<long>, starts array<long>"
_SHARD = pa.schema([("terms", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("steps", pa.list_(pa.uint32()))])


def build_index(docs: DataFrame, ids: list[str], text_col: str = "text", gap: int = 64, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the index of whole texts with all their terms, and return the written list of its shards. Null texts have no
    words.

    ``ids`` are columns of ``docs`` (cast to long) that name a document. Postings are the steps from one position of a
    term to its next, term after term in the order of ``terms``; ``ends`` says where each one's end. A document longer
    than a shard gets one of its own. Only files in the list count; a task that runs again writes a new one.
    """
    base = fresh_path(docs.sparkSession, "positions")
    rows = only(docs, *ids, text_col).select(*[F.col(c).cast("long").alias(f"id{k}") for k, c in enumerate(ids)], utf8(text_col).alias("data"))

    def shard(counts: list[int], tokens: list[np.ndarray], seen: dict[bytes, int]) -> tuple[np.ndarray, pa.RecordBatch]:
        sizes = np.array(counts, np.int64)
        starts = np.cumsum(sizes + gap) - (sizes + gap)
        term = np.concatenate(tokens)
        at = np.arange(len(term)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        at = at[np.argsort(term, kind="stable")]
        ends = np.cumsum(np.bincount(term, minlength=len(seen)))
        steps = np.diff(at, prepend=0)
        first = np.r_[0, ends[:-1]].astype(np.int64)[: len(seen)]
        steps[first] = at[first]
        columns = [pa.array(list(seen), pa.binary()), pa.array(ends, pa.int64()), pa.array(steps.astype(np.uint32))]
        return starts, pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(c)], c) for c in columns], schema=_SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, total = TaskContext.get().partitionId(), [], 0
        path, out = f"{base}/{part:06d}-{uuid.uuid4().hex[:8]}.arrow", None
        keys, counts, tokens = [[] for _ in ids], [], []
        seen: dict[bytes, int] = {}

        def flush() -> None:
            nonlocal out, file, keys, counts, tokens, seen, total
            if out is None:
                fs, at = file_system(path)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                file = fs.open_output_stream(at)
                out = pa.ipc.new_file(file, _SHARD, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            starts, batch = shard(counts, tokens, seen)
            out.write_batch(batch)
            made.append((f"{part}-{len(made)}", path, len(made), keys, counts, starts.tolist()))
            keys, counts, tokens, seen, total = [[] for _ in ids], [], [], {}, 0

        file = None
        for batch in batches:
            for *key, data in zip(*[batch.column(k).to_pylist() for k in range(len(ids))], batch.column(len(ids))):
                w = words(data.as_py())
                if counts and total + len(w) > shard_tokens:
                    flush()
                tokens.append(np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int32, len(w)))
                for k, v in zip(keys, key):
                    k.append(v)
                counts.append(len(w))
                total += len(w)
        if counts:
            flush()
        if out is not None:
            out.close()
            file.close()
        many, nested = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))
        for row in made:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.int32(), nested, many, many))], ["shard", "path", "batch", "ids", "n_words", "starts"])

    n = docs.count()
    tasks = rows.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-n // HEAVY_ROWS_A_FILE)))
    return written(tasks.mapInArrow(tidy(run), _INDEX), "shards")


def _shards(paths: list[str], numbers: list[int], *columns: int) -> Iterator[list[pa.Array]]:
    """These columns' values of the shards of index files, one shard at a time."""
    opened, reader = None, None
    for path, number in zip(paths, numbers):
        if path != opened:
            fs, at = file_system(path)
            opened, reader = path, pa.ipc.open_file(fs.open_input_file(at), options=pa.ipc.IpcReadOptions(included_fields=list(columns)))
        batch = reader.get_batch(number)
        yield [batch.column(k).values for k in range(len(columns))]


def _spread(index: DataFrame) -> DataFrame:
    """The list of shards dealt out over all cores, the shards of a file together."""
    return index.repartition(max(1, 4 * index.sparkSession.sparkContext.defaultParallelism), "path").sortWithinPartitions("path", "batch")


def frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Tokens in the corpus of each of these terms (of a block of items, hence bounded)."""
    shared = index.sparkSession.sparkContext.broadcast(pa.array(terms, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, ends in _shards(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 1):
                at = pc.index_in(shared.value, own)
                n = np.diff(ends.to_numpy(), prepend=0)
                total[at.is_valid().to_numpy(zero_copy_only=False)] += n[at.drop_null().to_numpy()]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["term", "n"])

    found = _spread(index.select("path", "batch")).mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {terms[r["term"]]: r["n"] for r in found.toLocalIterator()}


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of sorted ``a`` that are in sorted ``b``; the shorter one is looked up in the longer."""
    if not len(a) or not len(b):
        return a[:0]
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] == a]


class _Postings:
    """Positions of a shard's terms, worked out when they are asked for. ``place`` says where the block's terms (numbered
    by ``number``) are among the shard's, -1 for those that aren't."""

    def __init__(self, number: dict[bytes, int], place: np.ndarray, ends: np.ndarray, steps: np.ndarray):
        self.number, self.place, self.ends, self.steps, self.known = number, place, ends, steps, {}

    def get(self, term: bytes) -> np.ndarray | None:
        if term not in self.known:
            k = int(self.place[self.number[term]])
            self.known[term] = None if k < 0 else np.cumsum(self.steps[self.ends[k - 1] if k else 0 : self.ends[k]], dtype=np.int64)
        return self.known[term]


def phrase_starts(postings: _Postings, phrase: tuple[bytes, ...], order: list[int]) -> np.ndarray:
    """Positions where the words of ``phrase`` stand one after another; ``order``: its offsets, rarest first."""
    starts = None
    for k in order:
        p = postings.get(phrase[k])
        if p is None:
            return np.zeros(0, np.int64)
        shifted = p - k
        starts = shifted if starts is None else _common(starts, shifted)
        if not len(starts):
            break
    return starts[starts >= 0]


def near_spans(postings: _Postings, phrase: tuple[bytes, ...], order: list[int], slop: int) -> np.ndarray:
    """Positions of the rarest word from which every other word is at most ``slop`` tokens away, in any order."""
    anchors = postings.get(phrase[order[0]])
    if anchors is None:
        return np.zeros(0, np.int64)
    for k in order[1:]:
        p = postings.get(phrase[k])
        if p is None or not len(anchors):
            return np.zeros(0, np.int64)
        at = np.searchsorted(p, anchors)
        left, right = p[np.maximum(at - 1, 0)], p[np.minimum(at, len(p) - 1)]
        anchors = anchors[np.minimum(np.abs(anchors - left), np.abs(right - anchors)) <= slop]
    return anchors


_MATCH = "shard string, doc int, spans array<struct<a:long,b:long>>, items array<string>"


def match(index: DataFrame, block: list[tuple[str, list[bytes]]], width: int = 10, slop: int | None = None) -> DataFrame:
    """One row for each document with matches: spans of token numbers [a, b) that windows of the block's items cover,
    merged, and the items with windows there. With ``slop``, proximity matches instead of exact phrases."""
    found = phrases(block, width)
    terms = sorted({t for p in found for t in p})
    freq = frequencies(index, terms)
    rarest: dict[bytes, list] = {}
    for p, items in found.items():
        if all(t in freq for t in p):
            order = sorted(range(len(p)), key=lambda k: (freq[p[k]], k))
            rarest.setdefault(p[order[0]], []).append((p, order, sorted(items)))
    shared = index.sparkSession.sparkContext.broadcast((terms, rarest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rarest = shared.value
        wanted, number = pa.array(terms, pa.binary()), {t: k for k, t in enumerate(terms)}
        first = np.array([number[t] for t in rarest], np.int64)
        for batch in batches:
            names, starts_of = batch.column(2).to_pylist(), batch.column(3)
            for row, (own, ends, steps) in enumerate(_shards(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 1, 2)):
                place = pc.index_in(wanted, own).fill_null(-1).to_numpy()
                here = first[place[first] >= 0]
                if not len(here):
                    continue
                starts = starts_of[row].values.to_numpy()
                postings = _Postings(number, place, ends.to_numpy(), steps.to_numpy())
                spans, items = {}, {}
                for phrase, order, owners in (x for k in here.tolist() for x in rarest[terms[k]]):
                    hits = phrase_starts(postings, phrase, order) if slop is None else near_spans(postings, phrase, order, slop)
                    if not len(hits):
                        continue
                    for d, h in zip((np.searchsorted(starts, hits, "right") - 1).tolist(), hits.tolist()):
                        a = h - int(starts[d])
                        spans.setdefault(d, []).append((a, a + len(phrase)) if slop is None else (a, a + 1))
                        items.setdefault(d, set()).update(owners)
                if spans:
                    docs = sorted(spans)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([names[row]] * len(docs)), pa.array(docs, pa.int32()),
                            pa.array([[{"a": a, "b": b} for a, b in merged(spans[d])] for d in docs], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                            pa.array([sorted(items[d]) for d in docs], pa.list_(pa.string())),
                        ],
                        ["shard", "doc", "spans", "items"],
                    )

    return _spread(index.select("path", "batch", "shard", "starts")).mapInArrow(tidy(run), _MATCH)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_JOINED = "aggregate(array_sort(spans), named_struct('o', cast(array() as array<struct<a:bigint,b:bigint>>), 'c', cast(null as struct<a:bigint,b:bigint>)), (s, x) -> if(s.c is not null and x.a <= s.c.b, named_struct('o', s.o, 'c', named_struct('a', s.c.a, 'b', greatest(s.c.b, x.b))), named_struct('o', if(s.c is null, s.o, concat(s.o, array(s.c))), 'c', x)), s -> if(s.c is null, s.o, concat(s.o, array(s.c))))"


def hits(index: DataFrame, benchmark: DataFrame, width: int, item_id_col: str = "item_id", item_text_col: str = "text", slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (shard, doc, spans, items) of documents of the index with matches, over all blocks of the benchmark.

    The driver holds a block at a time. Each block is a pass over the index, and gives only the documents it hits.
    """
    outs = [kept(match(index, block, width, slop)) for block in item_blocks(benchmark, item_id_col, item_text_col, block_words)]
    if not outs:
        return index.sparkSession.createDataFrame([], _MATCH)
    out = functools.reduce(DataFrame.union, outs)
    if len(outs) > 1:
        out = out.groupBy("shard", "doc").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = out.withColumn("spans", F.expr(_JOINED))
    return out


def _documents(index: DataFrame, names: list[str]) -> DataFrame:
    """Rows (shard, doc, id columns, n_words) of all documents of an index."""
    each = F.posexplode(F.arrays_zip(F.col("n_words").alias("n_words"), *[F.col("ids")[k].alias(n) for k, n in enumerate(names)]))
    return index.select("shard", each.alias("doc", "x")).select("shard", "doc", *[f"x.{n}" for n in names], "x.n_words")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", slop: int | None = None, block_words: int = BLOCK_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans, items (sorted ids as text).

    Null texts have no words; null ids are kept; equal rows give a row each. Benchmark rows without an id or
    words count for nothing, and equal ids are one item. An empty benchmark gives no spans. Extra columns of either
    table are ignored.
    """
    index = build_index(docs, [id_col], text_col, max(64, 2 * width + 2 * (slop or 0)), shard_tokens)
    found = kept(hits(index, benchmark, width, item_id_col, item_text_col, slop, block_words))
    out = beside(_documents(index, ["doc_id"]), found, ["shard", "doc"], "left")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType))
    return out.select("doc_id", "n_words", none("spans").alias("spans"), none("items").alias("items"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Digest of ``contamination``: n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    out = contamination(docs, benchmark, width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of a benchmark item occurs, with all their columns, whatever their names.

    Null and empty texts stay; an empty benchmark or table removes nothing.
    """
    rows, at = located(docs)
    index = build_index(rows, at, text_col, max(64, 2 * width))
    hit = kept(hits(index, benchmark, width).select("shard", "doc"))
    gone = kept(beside(_documents(index, at), hit, ["shard", "doc"], "left_semi").select(*at))
    return beside(rows, gone, at, "left_anti").select(*[rows[c] for c in docs.columns])


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + 9], ' ') AS win
  FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(k) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM wins
), places AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)
), hits AS (
  SELECT p.doc_id, p.k, p.n, w.item_id FROM places p JOIN wins w ON p.win = w.win AND p.n = w.n
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

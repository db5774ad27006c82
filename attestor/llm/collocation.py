"""Phrases that hold together, mined in passes over the corpus with hashed bucket counts and Apriori pruning.

Pass k counts phrases of k words exactly and, in the same scan, phrases of k + 1 words by hash bucket. From a pass two
bitmaps of fixed size are broadcast to the next: buckets that hold enough, and hashes of the phrases that were frequent.
A phrase is counted exactly only if its bucket holds enough and both phrases inside it that are one word shorter were
frequent; the next pass's buckets leave out what can't be frequent in the same way. Bitmaps only ever let too much pass,
so the counts of frequent phrases are exact whatever the size of the bitmaps.

Bucket counts stop at the least count asked for: sums of such parts reach it exactly if the whole count does, and a
bucket takes one byte. They travel in slices, so summing them up is spread over as many tasks as there are slices.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.shared import drop_written, only, tidy, written

_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t")] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_PIECE_END = re.compile(rb"[.,;:!?\n-\r]")
#: Bytes of text that are looked at together; a piece is never parted.
_CHUNK = 2_000_000
#: Buckets of a slice, as a power of two.
_SLICE = 16
#: Different phrases that a task holds before it hands their counts on.
_HELD = 300_000
_PASS = "lang string, phrase string, n long, slice int, packed binary"


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        cut = _PIECE_END.search(data, at + _CHUNK)
        end = cut.end() if cut else len(data)
        yield data[at:end]
        at = end


class _Words:
    """The words of some text of one language: ids into a dictionary, and hashes of phrases by their first word's place."""

    def __init__(self, data: bytes, lang: str) -> None:
        raw = np.frombuffer(data, np.uint8)
        kinds = _KINDS[raw]
        inside = kinds == 0
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kinds == 2), starts)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        kind, width = (pa.binary(), np.int32) if offsets[-1] < 2**31 else (pa.large_binary(), np.int64)
        words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(raw[inside])]).dictionary_encode()
        self.ids, self.words = words.indices.to_numpy(), words.dictionary
        seed = zlib.crc32(lang.encode())
        known = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words))
        self._hashes = [known[self.ids]]

    def together(self, k: int) -> np.ndarray:
        """Whether k words from a place on lie in one piece."""
        return self.piece[k - 1 :] == self.piece[: len(self.piece) - k + 1] if k <= len(self.piece) else np.zeros(0, bool)

    def hashes(self, k: int) -> np.ndarray:
        """Hashes of the k words from each place on, whether or not they lie in one piece."""
        while len(self._hashes) < k:
            last, n = self._hashes[-1], len(self._hashes)
            self._hashes.append((last[:-1] ^ (last[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self._hashes[0][n:])
        return self._hashes[k - 1]

    def counted(self, k: int, places: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Phrases of k words at these places, each once, with their counts."""
        key = self.ids[places].astype(np.int64)
        for j in range(1, k):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.words) + self.ids[places + j]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        text = [self.words.take(pa.array(self.ids[places[first] + j])).cast(pa.utf8()) for j in range(k)]
        return pc.binary_join_element_wise(*text, " "), counts


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _in(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = _slot(hashes, bits)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


class _Buckets:
    """Counts by bucket that stop at ``least``."""

    def __init__(self, bits: int, least: int) -> None:
        self.bits, self.least = bits, min(least, 127)
        self.counts = np.zeros(1 << bits, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        slots, n = np.unique(_slot(hashes, self.bits), return_counts=True)
        self.counts[slots] = np.minimum(self.counts[slots] + np.minimum(n, self.least), self.least)

    def slices(self) -> Iterator[tuple[int, bytes]]:
        size = 1 << min(_SLICE, self.bits)
        pack = zstandard.ZstdCompressor(level=1)
        for k in range(len(self.counts) // size):
            part = self.counts[k * size : (k + 1) * size]
            if part.any():
                yield k, pack.compress(part.tobytes())


def _rows(counts: pa.Table | None = None, slices: list | None = None) -> Iterator[pa.RecordBatch]:
    if counts is not None:
        n = len(counts)
        whole = pa.table({"lang": counts["lang"], "phrase": counts["phrase"], "n": counts["n"].cast(pa.int64()), "slice": pa.nulls(n, pa.int32()), "packed": pa.nulls(n, pa.binary())})
        yield from whole.to_batches(20_000)
    for k, packed in slices or ():
        yield pa.record_batch({"lang": pa.nulls(1, pa.utf8()), "phrase": pa.nulls(1, pa.utf8()), "n": pa.nulls(1, pa.int64()), "slice": pa.array([k], pa.int32()), "packed": pa.array([packed], pa.binary())})


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).combine_chunks().group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return out.rename_columns(["lang", "phrase", "n"] if out.column_names[0] == "lang" else ["n", "lang", "phrase"])


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        out.setdefault(lang, []).append(text)
    return out


def _pass(k: int, longest: int, least: int, bits: int, maps: object) -> object:
    """A task of pass k. ``maps``: the broadcast bitmaps of frequent shorter phrases and of likely buckets, if any."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits, least) if k < longest else None
        frequent, likely = maps.value if maps is not None else (None, None)
        tables, held = [], 0
        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                for data in _parts(b"\n".join(texts).lower()):
                    words = _Words(data, lang)
                    alive = words.together(k)
                    if maps is not None and len(alive):
                        shorter = _in(frequent, words.hashes(k - 1), bits)
                        alive = alive & shorter[:-1] & shorter[1:]
                        alive[alive] = _in(likely, words.hashes(k)[alive], bits)
                    if not alive.any():
                        continue
                    phrases, counts = words.counted(k, np.flatnonzero(alive))
                    tables.append(pa.table({"lang": pa.repeat(lang, len(counts)), "phrase": phrases, "n": pa.array(counts, pa.int64())}))
                    held += len(counts)
                    if buckets is not None:
                        buckets.add(words.hashes(k + 1)[words.together(k + 1) & alive[:-1] & alive[1:]])
            if held > 2 * _HELD:
                tables = [_summed(tables)]
                held = len(tables[0])
                if held > _HELD:
                    yield from _rows(tables[0])
                    tables, held = [], 0
        if tables:
            yield from _rows(_summed(tables))
        if buckets is not None:
            yield from _rows(slices=buckets.slices())

    return run


def _marks(k: int, least: int, bits: int) -> object:
    """Bucket counts that hold ``least`` for each phrase of k words given."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits, least)
        for batch in batches:
            for lang, phrases in _by_lang(batch).items():
                words = _Words(b"\n".join(phrases), lang)
                buckets.counts[_slot(words.hashes(k)[words.together(k)], bits)] = buckets.least
        yield from _rows(slices=buckets.slices())

    return run


def _bitmap(slices: DataFrame, least: int, bits: int) -> np.ndarray:
    """Which buckets hold ``least``: 2**bits bits, from the slices of all tasks, which are summed up by slice as they
    come in. The driver gets the bitmap alone."""
    size = 1 << min(_SLICE, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(unpack.decompress(packed), np.uint8)
                sums[k] = np.minimum(sums[k] + part, min(least, 127)) if k in sums else part
        for k, counts in sums.items():
            yield pa.record_batch({"slice": pa.array([k], pa.int32()), "packed": pa.array([np.packbits(counts >= min(least, 127), bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row in slices.select("slice", "packed").repartition("slice").mapInArrow(run, "slice int, packed binary").collect():
        part = np.frombuffer(row["packed"], np.uint8)
        at = row["slice"] * size // 8
        out[at : at + len(part)] = part
    return out


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, bits: int = 25) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words that occur at least ``least`` times in a language, as a written table (lang,
    phrase, f), and the words of each language, (lang, n). ``bits``: bitmaps have 2**bits bits (4 MB as it is); fewer
    prune less and change no result."""
    spark = docs.sparkSession
    texts = only(docs, lang_col, text_col).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    maps, found, totals = None, [], None
    for k in range(1, longest + 1):
        run = written(texts.mapInArrow(_pass(k, longest, least, bits, maps), _PASS), "phrase-counts")
        counts = run.where("phrase is not null")
        if k == 1:
            totals = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        found.append(written(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrases"))
        if maps is not None:
            maps.destroy()
        if k < longest:
            marks = found[-1].select("lang", F.col("phrase").cast("binary")).mapInArrow(_marks(k, least, bits), _PASS)
            maps = spark.sparkContext.broadcast((_bitmap(marks, least, bits), _bitmap(run.where("slice is not null"), least, bits)))
        drop_written(run)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out, totals


def _phrase(first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.col("w"), first, size), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000, bits: int = 25) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Letters A to Z are lower-cased; texts part at ``.,;:!?`` and line ends (LF, VT, FF, CR), pieces at spaces and tabs
    into words. a is a phrase's count within pieces, overlaps included, l and r those of its first words and of the rest
    at the cut with the least score floor(1000000 a a / (l r)), the earliest such cut; n is the number of words of the
    language. A phrase goes if a longer frequent one has it inside and ``covered`` in a hundred of its count. Ranks
    are by score, count, then phrase in the order of UTF-8 bytes.

    A null text is empty, a null language is ``und``; a repeated row counts again, extra columns play no part. Texts without
    words and an empty table give no rows. Long texts are read in parts that end with a piece; one piece has to fit in
    a worker's memory.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, longest, least, bits)
    several = phrases.withColumn("w", F.split("phrase", " ")).where("size(w) > 1")
    cuts = several.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _phrase(F.lit(1), F.col("k")).alias("left"), _phrase(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.expr("cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 as decimal(38,0))")).withColumn("score", F.call_function("div", F.col("score"), wide("l") * wide("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    if longest > 2:
        sizes = F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size")
        inner = several.where("size(w) > 2").select("lang", "f", "w", sizes).select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
        inner = inner.select("lang", "f", _phrase(F.col("at"), F.col("size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        scored = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)).drop("longer")
    # ranks in two steps: the best of each share of a language's phrases, then of all shares
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = Window.partitionBy("lang", "share").orderBy(*order)
    best = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    best = written(best.select("lang", "rank", "phrase", "a", "l", "r", "score"), "collocations")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]'), lambda x: x <> '') AS w FROM pieces
), ones AS (
  SELECT lang, unnest(w) AS phrase FROM words
), twos AS (
  SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM words WHERE len(w) > 1
), threes AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM words WHERE len(w) > 2
), f AS (
  SELECT lang, phrase, count(*) AS f, len(string_split(phrase, ' ')) AS size FROM (SELECT * FROM ones UNION ALL SELECT * FROM twos UNION ALL SELECT * FROM threes) GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, phrase, a, w, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM candidates c, (VALUES (1), (2)) t(k) WHERE k < len(w)
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = p JOIN f y ON y.lang = c.lang AND y.phrase = q
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE len(w) = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE len(w) = 3
  ) GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""

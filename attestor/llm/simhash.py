"""Near duplicates: SimHash fingerprints linked through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits, each read as a word of the perfect binary
Golay code (23 bits, 12 information bits, covering radius 3). Two fingerprints at distance four or less have a
midpoint at distance two or less from both, and by the pigeonhole principle its two errors fall on the
segments as (2,0,0), (1,1,0), (1,0,0) or (0,0,0) in some order. A segment with up to r flipped bits decodes to
one of a few codewords, found by table; the triples of codeword indices over all such patterns are the keys of
a fingerprint. So linked fingerprints always share a key, and a key has 36 bits. Keys are joined by
sorting; all pairs in a small bucket are verified. Fingerprints that meet in a bucket of more than ``dense``
members are linked without pairs: each is expanded to its exact midpoints, and all that share one are linked to the
first of them, which is exact and linear in their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import softkeys
from attestor.llm.golay import remainder
from attestor.llm.shared import beside, components, kept, located, only, tidy, utf8, written

#: Fixed value: the seed of the shingle hash.
SEED = 42
WIDTHS = (21, 21, 22)
SHIFTS = (43, 22, 0)
#: What a task remembers to send links once: so many numbers at most.
_MOST_KNOWN = 200_000
#: Fingerprints whose keys one task makes.
_KEYED_ROWS = 20_000
#: A soft key of more rows is crowded: its rows first meet their leaders alone, so that a group of copies has about as
#: many pairs as members.
_CROWD = 2
#: Rows of a crowded key that a task holds at a time, and rows of a block of those that are compared with one another.
_HELD, _BLOCK = 1 << 16, 8192


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of words modulo the generator, by the low 12 and the high 11 bits."""
    return np.array([remainder(x) for x in range(1 << 12)]), np.array([remainder(x << 12) for x in range(1 << 11)])


_LOW, _HIGH = _syndromes()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _LOW[words & 4095] ^ _HIGH[words >> 12]


def _flips(width: int, most: int) -> list[int]:
    """Bit patterns of ``width`` bits with at most ``most`` (up to 3) ones, fewest first."""
    one = [1 << k for k in range(width)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    return [0, *one, *two, *three][: 1 + sum((width, width * (width - 1) // 2, len(three))[:most])]


def _nearest() -> np.ndarray:
    """The error pattern of each syndrome: exactly one of weight three or less."""
    patterns = np.array(_flips(23, 3))
    out = np.zeros(1 << 11, np.int64)
    out[syndrome(patterns)] = patterns
    return out


_ERRORS = _nearest()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[syndrome(words)]) >> 11


def _fuzzy(width: int) -> list[np.ndarray]:
    """By number of flips r and syndrome: index offsets of the codewords that r flips, but no fewer, lead to; -1 fills."""
    found: list[list[list[int]]] = [[[] for _ in range(1 << 11)] for _ in range(3)]
    seen: list[set[int]] = [set() for _ in range(1 << 11)]
    every = np.arange(1 << 11)
    for f in _flips(width, 2):
        r = f.bit_count()
        offset = ((f ^ _ERRORS[every ^ syndrome(np.array([f]))[0]]) >> 11).tolist()
        for s, o in enumerate(offset):
            if o not in seen[s]:
                seen[s].add(o)
                found[r][s].append(o)
    out = []
    for lists in found:
        m = np.full((1 << 11, max(map(len, lists))), -1, np.int64)
        for s, x in enumerate(lists):
            m[s, : len(x)] = x
        out.append(m)
    return out


_TABLES: dict[int, list[np.ndarray]] = {}


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64) as two arrays: row of the fingerprint, key."""
    for w in WIDTHS:
        if w not in _TABLES:
            _TABLES[w] = _fuzzy(w)
    near = []
    for w, s in zip(WIDTHS, SHIFTS):
        part = ((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64)
        syn, top = syndrome(part), part >> 11
        near.append([np.where(t[syn] >= 0, top[:, None] ^ t[syn], -1) for t in _TABLES[w]])
    rows, keys = [], []
    for r in ((a, b, c) for a in range(3) for b in range(3 - a) for c in range(3 - a - b)):
        x, y, z = (near[k][r[k]] for k in range(3))
        all_of = (x[:, :, None, None] << 24) | (y[:, None, :, None] << 12) | z[:, None, None, :]
        good = (x >= 0)[:, :, None, None] & (y >= 0)[:, None, :, None] & (z >= 0)[:, None, None, :]
        at = np.nonzero(good)
        rows.append(at[0])
        keys.append(all_of[at])
    return np.concatenate(rows), np.concatenate(keys)


def midpoint_masks(most: int) -> list[int]:
    """All 64-bit patterns of at most ``most`` (up to 2) ones, fewest first, as signed values."""
    return [x - (1 << 64) if x >> 63 else x for x in _flips(64, most)]


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """Hashes (uint64) of the word shingles of a text in UTF-8, repeats included."""
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[: len(tokens) - words] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def simhash(data: bytes, words: int = 4) -> int:
    """Fingerprint of a text in UTF-8: bits set in over half the hashes of its word shingles."""
    hashes = shingle_hashes(data, words)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", words: int = 4) -> DataFrame:
    """Columns ``carry`` (each cast to long) and ``fp`` (the 64 bits as a signed long) for every row.

    ASCII letters are folded to lower case and words are parted by ASCII white space. Fewer words than a
    shingle make one shingle of them all; no words, or null, give fingerprint zero.
    """
    rows = only(docs, *carry, text_col).select(*[F.col(c).cast("long").alias(c) for c in carry], utf8(text_col).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x.as_py(), words) for x in batch.column(len(carry))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(fps, pa.int64())], [*carry, "fp"])

    return rows.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in (*carry, "fp")))


class _Forest:
    """Union-find over what a task has met; keeps only edges that join two trees. Cleared when large."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def new_edges(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        if len(self.parent) > _MOST_KNOWN:
            self.parent.clear()
        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.parent[p] = q
                out.append((x, y))
        return out


def _close_pairs(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal key (rows sorted by key) whose fingerprints differ in at most ``distance`` bits."""
    a, b, active, lag = [], [], np.arange(len(keys)), 1
    while len(active := active[active + lag < len(keys)]) and len(active := active[keys[active] == keys[active + lag]]):
        close = active[np.bitwise_count((fps[active] ^ fps[active + lag]).view(np.uint64)) <= distance]
        a.append(fps[close])
        b.append(fps[close + lag])
        lag += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Whole groups of sorted (key, fp) rows at a time; of groups larger than ``most``, parts marked True."""
    key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if over is not None and len(k):
            n = int(np.searchsorted(k, over, "right"))
            if n:
                yield k[:n], f[:n], True
                k, f = k[n:], f[n:]
            if not len(k):
                continue
            over = None
        key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield key[:last], fp[:last], False
            key, fp = key[last:], fp[last:]
        if len(key) > most:
            over = key[-1]
            yield key, fp, True
            key, fp = key[:0], fp[:0]
    if len(key):
        yield key, fp, False


def link(fps: DataFrame, distance: int = 4, dense: int = 256) -> DataFrame:
    """Components of distinct fingerprints (column ``fp``) linked at ``distance`` (at most 4) differing bits.

    Rows (fp, root), root the smallest fp of the component; fingerprints without a link don't appear.
    """
    if not 0 <= distance <= 4:
        raise ValueError("keys meet for distances up to 4")
    spark = fps.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for k in range(0, len(values), 2048):
                part = values[k : k + 2048]
                rows, keys = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, marked = _Forest(), set()
        for key, fp, over in _runs(batches, dense):
            hot: set[int] = set()
            if over:
                hot.update(fp.tolist())
            else:
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                large = np.repeat(n > dense, n)
                hot.update(fp[large].tolist())
                key, fp = key[~large], fp[~large]
            if len(marked) > _MOST_KNOWN:
                marked.clear()
            hot -= marked
            marked |= hot
            edges = [] if over else forest.new_edges(*_close_pairs(key, fp, distance))
            out = edges + [(x, None) for x in hot]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by midpoint and side, link all of a midpoint to the first, if that is on the inner side."""
        forest, head = _Forest(), None
        for batch in batches:
            z, outer, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(z):
                continue
            if head is not None:
                z, outer, fp = (np.r_[h, c] for h, c in zip(head, (z, outer, fp)))
            first = np.flatnonzero(np.r_[True, z[1:] != z[:-1]])
            lead = np.repeat(first, np.diff(np.r_[first, len(z)]))
            head = [c[lead[-1] : lead[-1] + 1] for c in (z, outer, fp)]
            good = ~outer[lead].astype(bool) & (fp != fp[lead])
            if out := forest.new_edges(fp[lead][good], fp[good]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    distinct = kept(only(fps, "fp").distinct())
    tasks = max(1, -(-distinct.count() // _KEYED_ROWS))
    keys = distinct.repartition(tasks).mapInArrow(tidy(keyed), "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    met = kept(keys.mapInArrow(tidy(verified), "a long, b long"))
    edges = met.where("b is not null")
    hot = met.where("b is null").select("a").distinct()
    if distance and not met.where("b is null").isEmpty():
        # two fingerprints share a point that is half the distance from one (rounded down) and from the other (up);
        # whoever stands on a point's inner side is near enough to all others there
        inner = len(midpoint_masks(distance // 2))
        masks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k >= inner).alias("outer")) for k, m in enumerate(midpoint_masks(-(-distance // 2)))])
        points = hot.repartition(max(1, -(-hot.count() // 1000))).select("a", F.inline(masks)).select(F.col("a").bitwiseXOR(F.col("m")).alias("z"), "outer", F.col("a").alias("fp"))
        edges = edges.union(points.repartition("z").sortWithinPartitions("z", "outer", "fp").mapInArrow(tidy(starred), "a long, b long"))
    return components(edges, "simhash-cc").select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, dense: int = 256) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (the smallest id reachable over links) of every row.

    Null and empty texts have fingerprint zero and are linked like any other. Equal rows are all returned. A
    null id is never the smallest; a component of null ids alone has component_id null. An empty table gives
    no rows. Extra columns are ignored. Copies meet in one fingerprint before anything is joined.
    """
    rows = written(fingerprints(docs.withColumn("doc_id", F.col(id_col)), ["doc_id"], text_col, words), "fingerprints", docs.count(), heavy=True)
    low = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = link(rows, distance, dense)
    named = low.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return beside(rows, kept(named), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that what is made from one stays small."""
    for batch in batches:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def _sketched(rows: DataFrame, words: int) -> DataFrame:
    """(file, row, id, data) to file, row, id, set_ (stands for the shingle set), sketch and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cols: list[list[bytes]] = [[], [], []]
            for x in batch.column(3):
                hashes = np.unique(shingle_hashes(x.as_py(), words))
                for c, f in zip(cols, (softkeys.digest, softkeys.sketch, softkeys.signature)):
                    c.append(f(hashes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, pa.binary()) for c in cols]], ["file", "row", "id", "set_", "sketch", "signature"])

    return rows.mapInArrow(tidy(run), "file long, row long, id long, set_ binary, sketch binary, signature binary")


def _keyed(sketches: DataFrame) -> DataFrame:
    """Rows (key, node, sign) of all soft keys of nodes (node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int8).reshape(-1, softkeys.DIRECTIONS)
            live = x.any(1)
            x, node = x[live], part.column(0).to_numpy()[live]
            if not len(x):
                continue
            keys = np.concatenate([softkeys.soft_keys(x[k : k + 32]) for k in range(0, len(x), 32)])
            node, sign = (np.repeat(c, keys.shape[1]) for c in (node, softkeys.signs(x)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.ravel(), node, sign)], ["key", "node", "sign"])

    return sketches.mapInArrow(tidy(run), "key long, node long, sign long")


def _meetings(sketches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of nodes (node, sketch): pairs (a, b), a < b, that share a soft key and have near signs; further pairs that share
    a key; and rows (node, sign) of crowded keys.

    All near pairs of a key of up to ``_CROWD`` rows are there. Of a crowded key only pairs with leaders are; with the
    further ones they connect all its rows, which ``_left_apart`` compares.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["kind", "a", "b"], set()

        def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

        def out(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, node, sign, fresh = part
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            crowded = np.repeat((n > _CROWD) | ~np.logical_and.reduceat(fresh, at), n)
            few, many = node[~crowded], node[crowded]
            a, b = (few[k] for k in softkeys.close_pairs(key[~crowded], sign[~crowded]))
            c, d, e, f = (many[k] for k in softkeys.stars(key[crowded], sign[crowded]))
            for kind, x, y in ((0, np.r_[a, c], np.r_[b, d]), (1, e, f)):
                pairs = {(kind, *p) for p in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist())} - seen
                if len(seen) > _MOST_KNOWN:
                    seen.clear()
                seen.update(pairs)
                if pairs:
                    _, x, y = zip(*pairs)
                    yield rows(kind, np.array(x, np.int64), np.array(y, np.int64))
            if len(many):
                own, first = np.unique(many, return_index=True)
                yield rows(2, own, sign[crowded][first])

        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        for batch in _slices(batches, 10_000):
            new = [*[c.to_numpy() for c in batch.columns], np.ones(batch.num_rows, bool)]
            held = [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            # the last key may go on in the next batch
            whole = held[0] != held[0][-1]
            if whole.any():
                order = softkeys.in_order(held[0][whole], held[1][whole])
                yield from out([x[whole][order] for x in held])
                held = [x[~whole] for x in held]
            if len(held[0]) > _HELD:
                # a part of it is crowded in any case; its leader stays to meet the other parts
                order = softkeys.in_order(*held[:2])
                held = [x[order] for x in held]
                yield from out(held)
                held = [*[x[:1] for x in held[:3]], np.zeros(1, bool)]
        if len(held[0]):
            order = softkeys.in_order(*held[:2])
            yield from out([x[order] for x in held])

    keys = _keyed(sketches).repartition("key").sortWithinPartitions("key")
    found = kept(keys.mapInArrow(tidy(meet), "kind int, a long, b long"))
    met = written(found.where("kind = 0").select("a", "b").distinct(), "met", found.count())
    return met, found.where("kind = 1").select("a", "b"), found.where("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("sign")).distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole groups of sorted rows as columns; the first three name the group, binary ones are signatures."""
    held: list[np.ndarray] | None = None
    for batch in _slices(batches):
        if not batch.num_rows:
            continue
        new = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, softkeys.BINS) if c.type == pa.binary() else c.to_numpy() for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in held[:3]])) + 1
        at = [0, *cuts.tolist()]
        for lo, hi in zip(at, at[1:]):
            yield [c[lo:hi] for c in held]
        held = [c[at[-1] :] for c in held]
    if held is not None:
        yield held


def _left_apart(crowded: DataFrame, roots: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, near) of rows of one crowded key (key, node, sign) with near signs that are in different
    components (node, root) and whose estimated similarity may reach the limit.

    All such pairs are compared. Rows of a key's largest component needn't meet one another: they are dealt into blocks,
    and so are the others; every block of the ones meets every block of the others, and every two blocks of the others
    meet, each in a task. So where a component holds the bulk of a key, its rows travel about once. Signatures (node,
    signature) go only to rows with such a partner.
    """
    group = ["key", "lo", "hi"]

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches):
            good = np.zeros(len(cols[0]), bool)
            for x, y in softkeys.apart(cols[5], cols[6], cols[3]):
                good[x] = good[y] = True
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in cols], [*group, "side", "node", "sign", "root"])

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, side, node, sign, root, signature in _groups(batches):
            for x, y in softkeys.apart(sign, root, side):
                for k in range(0, len(x), 4096):
                    a, b = x[k : k + 4096], y[k : k + 4096]
                    near = softkeys.likeness(signature[a], signature[b])
                    good = near >= similarity - softkeys.DOUBT
                    a, b = node[a[good]], node[b[good]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), near[good])], ["a", "b", "near"])

    rows = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    still = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    many = lambda n: F.greatest(F.ceil(n / _BLOCK), F.lit(1)).cast("long")
    still = still.select("key", F.col("top.root").alias("top"), many(F.col("top.n")).alias("bulk"), many(F.col("n") - F.col("top.n")).alias("blocks"))
    rows = rows.join(still, "key").withColumn("is_top", F.col("root") == F.col("top"))
    rows = rows.withColumn("side", F.when(F.col("is_top"), -1 - F.pmod(F.xxhash64("node"), "bulk")).otherwise(F.pmod(F.xxhash64("node"), "blocks")))
    # blocks of the bulk are numbered below zero
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    others = F.when(F.col("is_top"), upto(F.col("blocks"))).otherwise(F.concat(F.transform(upto(F.col("bulk")), lambda k: -1 - k), upto(F.col("blocks"))))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "sign", "root")
    names = "key long, lo long, hi long, side long, node long, sign long, root long"
    rows = kept(rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(partnered), names))
    signatures = kept(beside(signatures, kept(rows.select("node").distinct()), "node", "left_semi"))
    rows = rows.join(signatures, "node").select(*group, "side", "node", "sign", "root", "signature")
    rows = rows.repartition(*group).sortWithinPartitions(*group)
    return written(rows.mapInArrow(tidy(estimated), "a long, b long, near double").distinct(), "estimates")


def _beside(df: DataFrame, payload: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) with what a payload (node, name) holds of either."""
    x, y = (payload.select(F.col("node").alias(n), F.col(name).alias(name + n)) for n in "ab")
    return df.select("a", "b").join(x, "a").join(y, "b").select("a", "b", name + "a", name + "b")


def _verified(pairs: DataFrame, signatures: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this similarity.

    Signatures (node, signature) decide where their estimate is four deviations or more away from the limit;
    for pairs nearer to it the sets are built from the texts and compared: ``texts`` gives (node, data) of nodes.
    """

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if batch.num_rows:
                near = softkeys.estimates(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                rows = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near)], ["a", "b", "near"])
                yield rows.filter(pa.array(near >= similarity - softkeys.DOUBT))

    return _decided(written(_beside(pairs, signatures, "signature").mapInArrow(tidy(estimated), "a long, b long, near double"), "estimates", pairs.count()), texts, words, similarity)


def _decided(near: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of estimated ones (a, b, near) that hold, those near the limit by their shingle sets."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (np.unique(shingle_hashes(t.as_py(), words)) for t in (x, y))
                shared = len(np.intersect1d(one, two, assume_unique=True))
                good.append(shared >= similarity * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(good, pa.bool_()))

    sure = near.where(F.col("near") >= similarity + softkeys.DOUBT).select("a", "b")
    doubtful = near.where(F.col("near") < similarity + softkeys.DOUBT)
    if doubtful.isEmpty():
        return sure
    ids = doubtful.select(F.col("a").alias("node")).union(doubtful.select("b")).distinct()
    exact = _beside(doubtful, texts(ids), "data").mapInArrow(tidy(compared), "a long, b long")
    return written(sure.union(exact), "links", near.count())


def _similar(sketches: DataFrame, signatures: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """Components (node, root) of nodes whose verified similarity links them.

    Each node is first verified against the least node it met; pairs that this leaves in different
    components are verified after that. So a group of n copies needs about n comparisons, not all pairs. Last,
    rows that crowded keys connect and that are still in different components are compared, each with each; only
    pairs that may be similar leave the task.
    """
    met, further, crowded = _meetings(sketches)
    ids = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    every, signatures = signatures, kept(beside(signatures, kept(ids), "node", "left_semi"))
    first = met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(first, signatures, texts, words, similarity)
    roots = components(links, "similar-cc")
    others = met.join(first, ["a", "b"], "left_anti")
    for end in "ab":
        others = others.join(roots.select(F.col("node").alias(end), F.col("root").alias("r" + end)), end, "left").withColumn("r" + end, F.coalesce("r" + end, end))
    rest = _verified(kept(others.where("ra <> rb").select("a", "b")), signatures, texts, words, similarity)
    if not rest.isEmpty():
        links = links.union(rest)
        roots = components(links, "similar-cc")
    if crowded.isEmpty():
        return roots
    rest = _decided(_left_apart(_clustered(crowded, met.select("a", "b").union(further)), roots, every, similarity), texts, words, similarity)
    return roots if rest.isEmpty() else components(links.union(rest), "similar-cc")


def _clustered(crowded: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (key, node, sign) of crowded rows (node, sign), so that all that share a crowded key share a key here: what the
    edges connect is one key."""
    clusters = components(edges, "clusters").select(F.col("node"), F.col("root").alias("key"))
    return kept(crowded.join(clusters, "node", "left").select(F.coalesce("key", "node").alias("key"), "node", "sign"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when one document, that of the smallest id, is kept of each group of near copies.

    Near copies are linked if they share a soft key (see ``softkeys``) and the Jaccard similarity of their sets
    of word shingles is ``similarity`` or more; groups are what links reach. Words are folded and parted as
    in ``fingerprints``; rows of equal shingle sets, those without words among them, are one. Of rows with the same
    smallest id, the first of those sketched stays; a null id comes last. An empty table gives no rows; extra columns
    stay, whatever their names.
    """
    rows, at = located(docs)
    place = [F.col(c).alias(n) for c, n in zip(at, ("file", "row"))]
    slim = _sketched(rows.select(*place, F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("data")), words)
    slim = written(slim.withColumn("node", F.monotonically_increasing_id()), "sketches", docs.count(), heavy=True)
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("best")
    sets = kept(slim.groupBy("set_").agg(F.min("node").alias("node"), best).select("node", "best"))
    nodes = slim.select("node", "sketch").join(sets, "node", "left_semi")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = kept(slim.select("node", "file", "row").join(ids, "node", "left_semi"))
        return kept(beside(rows.select(*place, utf8(text_col).alias("data")), wanted, ["file", "row"]).select("node", "data"))

    roots = _similar(nodes, slim.select("node", "signature"), texts, words, similarity)
    stay = sets.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best.node")
    gone = kept(slim.select("node", *[F.col(n).alias(c) for c, n in zip(at, ("file", "row"))]).join(stay, "node", "left_anti").drop("node"))
    return beside(rows, gone, at, "left_anti").select(*[rows[c] for c in docs.columns])

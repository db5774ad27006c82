"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import only, tidy, utf8, written
from attestor.llm.tokens import CACHED, encoder

PIECE_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key")


class Tournament:
    """Remaining capacities of numbered bins; finds the first bin that has room in log time.

    Leaves are bins; an inner node holds the larger capacity below it, so the leftmost winner is found by
    one walk down.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Place an item in the first bin with room: (bin, room it had)."""
        best, node = self.best, 1
        if best[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        room, found = best[node], node - self.leaves
        best[node] = room - size
        node >>= 1
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left >= right else right
            node >>= 1
        return found, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Whole-capacity items get bins of their own without touching the tree."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    tree = Tournament(max(1, len(rest)), capacity)
    for i, n in zip(rest.tolist(), lengths[rest].tolist()):
        b, room = tree.put(n)
        bins[i], offsets[i] = full + b, capacity - room
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """Encode whole texts, append ``end_id`` and cut into pieces of at most ``capacity`` ids.

    A null text counts as empty, so every row gives at least the end id. A null id is kept. ``row_key`` is
    unique to a row of the input, so that equal rows and equal ids are told apart.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n = encoder(tokenizer, cached), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.groups(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                raw = memoryview(ids.tobytes())
                for s in range(0, len(ids), capacity):
                    e = min(len(ids), s + capacity)
                    out.append((doc_id, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), len(ids), (part << 33) + n))
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], list(PIECE_COLUMNS))

    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))
    return rows.mapInArrow(tidy(cut), ", ".join(f"{c} long" for c in PIECE_COLUMNS))


def pack(pieces: DataFrame, capacity: int, group_rows: int = 4000, seed: int = 17) -> DataFrame:
    """Assign pieces to sequences of at most ``capacity``: adds sequence_id and offset (gapless from 0).

    ``pieces`` must be a written table (its rows are read twice). Documents are dealt by a seeded hash of
    ``row_key`` into groups of about ``group_rows`` pieces, a number that doesn't grow with the input; each
    group is packed by itself, so no task holds more than its group and a lost one is simply packed again.
    Ties in length go by row_key and start. An empty table gives no rows.
    """
    groups = max(1, -(-pieces.count() // group_rows))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row_key", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        seq = table.column("g").to_numpy() * (1 << 32) + bins
        return table.drop_columns(["row_key", "g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """Encode, cut and pack whole documents; rows as ``pack`` gives them. ``cached`` bounds the pieces that a worker's token
    cache holds: fewer take less memory and more time."""
    return pack(written(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, cached), "pieces", docs.count(), heavy=True), capacity, group_rows)

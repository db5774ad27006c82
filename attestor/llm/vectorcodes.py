"""Vectors as short codes: integer codebooks for each part of a vector, and nearest entries by partial-distance search.

Codebooks are small (parts times entries) and travel with the tasks; the vectors stay where they are. A round is one
scan whose tasks give sums by part, entry and dimension, which are added up before and after a shuffle of as many rows
as the codebooks have numbers. All arithmetic is in integers, so results don't depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import beside, only, tidy, written

#: Components are scaled by this and rounded down.
SCALE = 256
#: Largest scaled component: squared distances of 2**10 dimensions fit in 64 bits.
LIMIT = 2**25
#: Vectors that are searched together, and entries that are tried before the best distance is looked at again.
_ROWS, _STEP = 8192, 16


@dataclass
class Codebooks:
    """``entries[part, entry, place within the part]``, integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the lowest index of several.

    Dimensions are taken in descending variance of the entries. The entry nearest in the first dimension gives the first
    complete distance; entries then come in steps, and one is dropped as soon as its distance so far strictly
    exceeds the row's best complete one.
    """
    order = np.argsort(-entries.var(axis=0), kind="stable")
    x, c = rows[:, order], entries[:, order]
    guess = np.abs(x[:, :1] - c[None, :, 0]).argmin(axis=1)
    best, at = ((x - c[guess]) ** 2).sum(axis=1), guess.copy()
    for low in range(0, len(c), _STEP):
        part = c[low : low + _STEP]
        so_far = (x[:, :1] - part[None, :, 0]) ** 2
        r, e = np.nonzero(so_far <= best[:, None])
        d = so_far[r, e]
        for k in range(1, x.shape[1]):
            d += (x[r, k] - part[e, k]) ** 2
            live = d <= best[r]
            r, e, d = r[live], e[live], d[live]
        if not len(r):
            continue
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        low_d, who = np.minimum.reduceat(d, starts), r[starts]
        first = np.flatnonzero(d == np.repeat(low_d, np.diff(np.append(starts, len(r)))))
        first = first[np.diff(r[first], prepend=-1) > 0]  # entries ascend within a row
        found = e[first] + low
        better = (low_d < best[who]) | ((low_d == best[who]) & (found < at[who]))
        best[who[better]], at[who[better]] = low_d[better], found[better]
    return at, best


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some thousand rows together: the other columns, and the scaled vectors, which are in the last."""
    held: list[pa.RecordBatch] = []

    def made() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = table.column(table.num_columns - 1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return table, np.floor(flat * SCALE).astype(np.int64).reshape(len(table), -1)

    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= _ROWS:
            yield made()
            held = []
    if held:
        yield made()


def sound(vectors: DataFrame, id_col: str, vector_col: str, parts: int) -> DataFrame:
    """Rows whose vector can be coded, as (id, vector of doubles). Null vectors and those with null, non-finite or (in
    absolute value, scaled) components over ``LIMIT`` are left out, and those whose length isn't that of the first, or
    not a positive multiple of ``parts``."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LIMIT / SCALE))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(~bad & (F.size(v) > 0) & (F.size(v) % parts == 0), F.lit(False)))
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    return rows.where(F.size("v") == (len(first[0]["v"]) if first else 0))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks that start as the parts of the first ``entries`` vectors by id (then vector, nulls last) and are moved
    ``rounds`` times to the floor of the mean of what is nearest to each; unused entries stay. All vectors count."""
    rows = sound(only(vectors, id_col, vector_col), id_col, vector_col, parts)
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    scaled = np.floor(np.array(first, np.float64) * SCALE).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(scaled.reshape(len(first), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_summing(books), "part int, entry int, place int, total long, n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            books.entries[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def _summing(books: Codebooks) -> object:
    entries = books.entries.copy()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many, width = entries.shape
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros((parts, many), np.int64)
        for _, x in _vectors(batches):
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                at, _ = nearest(mine, entries[p])
                np.add.at(sums[p], at, mine)
                counts[p] += np.bincount(at, minlength=many)
        part, entry, place = np.nonzero(np.repeat(counts[:, :, None] > 0, width, axis=2))
        yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "place": pa.array(place, pa.int32()), "total": pa.array(sums[part, entry, place]), "n": pa.array(counts[part, entry])})

    return run


def _coding(books: Codebooks) -> object:
    entries = books.entries.copy()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = entries.shape
        for table, x in _vectors(batches):
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], d = nearest(x[:, p * width : (p + 1) * width], entries[p])
                error += d
            done = table.drop_columns([table.column_names[-1]]).append_column("code", pa.array([r.tobytes().hex() for r in codes])).append_column("error", pa.array(error))
            yield from done.to_batches(_ROWS)

    return run


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all sound vectors: ``id_col``, code (two hex digits a part), error (squared distance), label_error (of all
    rows with the label, nulls together), codebooks_sha256.

    Repeated rows and ids stay, each with its code. Rows that ``sound`` leaves out have none; extra columns play no part,
    and an empty table gives no rows. There are 256 entries at most.
    """
    parts, many, width = books.entries.shape
    if many > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    rows = only(vectors, id_col, label_col, vector_col)
    kind, label_kind = rows.schema[id_col].dataType.simpleString(), rows.schema[label_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LIMIT / SCALE))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.coalesce(~bad & (F.size("v") == parts * width) & F.lit(many > 0), F.lit(False)))
    coded = written(rows.mapInArrow(_coding(books), f"id {kind}, label {label_kind}, code string, error long"), "vector-codes")
    coded = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = written(coded.groupBy("key").agg(F.sum("error").alias("label_error")), "label-errors")
    return beside(coded, sums, "key").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, list_transform(embedding[p * w + 1:p * w + w], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM (SELECT *, len(embedding) // 16 AS w FROM kept), range(16) t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
)""" + "".join(
    f""", near{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM (
    SELECT vec_id, v.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts v JOIN book{k} b ON b.p = v.p
  ) GROUP BY vec_id, p
)"""
    + (
        f""", means{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT n.p, n.e, i, floor_div AS m FROM (
      SELECT p, e, i, (s - ((s % n) + n) % n) // n AS floor_div FROM (
        SELECT n.p, n.e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k} n JOIN parts v ON v.vec_id = n.vec_id AND v.p = n.p, range(1, 1000) t(i) WHERE i <= len(x) GROUP BY ALL
      )
    ) n
  ) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e
)"""
        if k < 2
        else ""
    )
    for k in range(3)
) + """, digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2
), coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id
)
SELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id, digest
"""

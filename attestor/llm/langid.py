"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel counts the distinct byte n-grams (n = 1, 2, 3: a blended spectrum) that two texts share, over the
square root of the product of how many each has. A text is mapped to its kernel values with landmark texts,
whitened by the landmarks' own kernel matrix; one ridge regression for each language against the rest is fitted
there in closed form. Texts are scored in batches by two matrix products. N-grams are taken from lower-cased
letters, with one space for all else; the kernel is restricted to the n-grams most frequent in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.shared import only, short_batches, tidy, utf8

_TABLE = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_BATCH = 256


def normal(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" "


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def gram_codes(data: bytes) -> np.ndarray:
    """Codes of all n-grams: their bytes as a number, plus 2**24 times n - 1."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    two = (a[:-1] << 8) | a[1:]
    return np.concatenate([a, two + (1 << 24), ((two[:-1] << 8) | a[2:]) + (2 << 24)])


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # codes in the kernel, sorted
    landmarks: np.ndarray  # presence / sqrt(number), landmarks x grams
    readout: np.ndarray  # landmarks x languages, whitening folded in
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """By n: column of each n-gram in a presence row; the last column collects n-grams out of the kernel."""
        if not hasattr(self, "_tables"):
            out = []
            for n, size in enumerate((1 << 8, 1 << 16, 1 << 24)):
                t = np.full(size, len(self.grams), np.int32 if len(self.grams) > 65_000 else np.uint16)
                own = (self.grams >> 24) == n
                t[self.grams[own] & ((1 << 24) - 1)] = np.flatnonzero(own)
                out.append(t)
            self._tables = out
        return self._tables

    def presence(self, texts: list[bytes]) -> np.ndarray:
        one, two, three = self.tables()
        x = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        for row, data in zip(x, texts):
            a = np.frombuffer(data, np.uint8)
            b = (a[:-1].astype(np.int32) << 8) | a[1:]
            row[one[a]] = 1
            row[two[b]] = 1
            row[three[(b[:-1] << 8) | a[2:]]] = 1
        return x[:, :-1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages; near 1 for the language, near 0 for others."""
        x = self.presence(texts)
        k = (x @ self.landmarks.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return k @ self.readout + self.offset


def train(texts: list[str], langs: list[str], most_grams: int = 4096, landmarks: int = 192, ridge: float = 1e-2, least_documents: int = 2) -> Model:
    """Fit on a bounded sample on the driver; ties in frequency go by code, landmarks are dealt by language in turn."""
    languages = sorted(set(langs))
    data = [normal(t) for t in texts]
    seen: dict[int, int] = {}
    for d in data:
        for g in np.unique(gram_codes(d)).tolist():
            seen[g] = seen.get(g, 0) + 1
    top = sorted((g for g, n in seen.items() if n >= min(least_documents, len(data))), key=lambda g: (-seen[g], g))[:most_grams]
    model = Model(languages, np.array(sorted(top), np.int64), np.zeros((0, len(top)), np.float32), np.zeros((0, 0)), np.zeros(len(languages)))
    if not data:
        return model
    x = np.concatenate([model.presence(data[k : k + _BATCH]) for k in range(0, len(data), _BATCH)])
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y = np.array([languages.index(v) for v in langs])
    queues = [np.flatnonzero(y == c).tolist() for c in range(len(languages))]
    turns = [q[k] for k in range(max(map(len, queues))) for q in queues if k < len(q)][:landmarks]
    model.landmarks = np.ascontiguousarray(x[turns])
    values, vectors = np.linalg.eigh((model.landmarks @ model.landmarks.T).astype(float))
    good = values > 1e-6 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ model.landmarks.T).astype(float) @ white
    target = (y[:, None] == np.arange(len(languages))).astype(float)
    mean, middle = phi.mean(0), target.mean(0)
    w = np.linalg.solve((phi - mean).T @ (phi - mean) + ridge * len(phi) * np.eye(phi.shape[1]) / 100, (phi - mean).T @ (target - middle))
    model.readout, model.offset = (white @ w).astype(np.float32), middle - mean @ w
    return model


def quotas(counts: dict[str, int], most_per_language: int, most_rows: int) -> dict[str, int]:
    """Rows to draw of each language: ``most_rows`` shared out evenly, what small ones leave dealt on; 1 at least."""
    out, left = {}, most_rows
    for k, (y, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        out[y] = max(1, min(n, most_per_language, left // (len(counts) - k)))
        left -= out[y]
    return out


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most_per_language: int = 1000, most_rows: int = 6000, most_chars: int = 20_000) -> Model:
    """Fit on at most ``most_per_language`` rows of each language and ``most_rows`` in all, drawn by a hash of their
    ids; rows without text or language and texts over ``most_chars`` characters aren't drawn, so the driver gets
    ``most_rows`` times ``most_chars`` characters at most. Every language with other rows is learned, so more languages
    than ``most_rows`` give a row each."""
    rows = only(docs, id_col, text_col, lang_col).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("y"))
    rows = rows.where(F.col("y").isNotNull() & F.col("t").isNotNull() & (F.length("t") <= most_chars))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [])
    quota = quotas(counts, most_per_language, most_rows)
    # a few more are let through than wanted, so that the least hashes of each language are among them
    drawn = docs.sparkSession.createDataFrame([(y, q, min(1.0, (q + 8 * q**0.5 + 24) / counts[y])) for y, q in quota.items()], "y string, quota long, rate double")
    h = F.pmod(F.xxhash64(F.lit(11), "i"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(drawn), "y").withColumn("h", h).where((F.col("h") < F.col("rate")) | (F.col("rate") == 1))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h", "i", "t"))
    sample = sample.withColumn("place", place).where(F.col("place") <= F.col("quota")).orderBy("h", "i", "t").select("t", "y").collect()
    return train([r["t"] for r in sample], [r["y"] for r in sample])


def _predicted(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    known = [k for k, t in enumerate(texts) if t and model.languages and has_letter(t)]
    langs, best = ["und"] * len(texts), np.zeros(len(texts))
    if known:
        s = model.scores([normal(texts[k]) for k in known])
        for k, c, v in zip(known, s.argmax(1).tolist(), s.max(1).tolist()):
            langs[k], best[k] = model.languages[c], min(1.0, max(0.0, v))
    return langs, best


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row; ``und`` with score 0 for null texts and texts without a
    letter, and for any text where no language was learned. Null ids are kept."""
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                langs, best = _predicted(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(best, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a recognised language: not ``und``, and a score of ``least_score`` or more.

    One pass without a shuffle: whole rows go through Arrow and those that aren't recognised are left out. All columns
    stay, whatever their names; null and empty texts go, and an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _BATCH):
                part = batch.slice(k, _BATCH)
                langs, best = _predicted(shared.value, part.column(at).to_pylist())
                yield part.filter(pa.array([y != "und" and v >= least_score for y, v in zip(langs, best)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)

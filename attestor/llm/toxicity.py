"""Toxicity by multiple-instance learning: sentences are scored, documents are their noisy-or.

A document has label 1 if at least one of its sentences is toxic, and only documents are labelled. A sentence's
probability is a logistic function of the words in it; a document's is 1 - prod(1 - p). The weights are trained
on document labels through that product, and sentence probabilities then point at the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import only, tidy, utf8

#: Letters fold to lower case, sentence ends become newlines, other ASCII becomes spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 or b == 39 else 10 if b in b".!?\n" else 32 for b in range(256))


def sentences(data: bytes) -> list[list[bytes]]:
    """Words of each sentence that has any."""
    return [w for w in map(bytes.split, data.translate(_TABLE).split(b"\n")) if w]


#: Bytes of the word beginnings that count as features beside whole words; words that merely begin alike share them.
PREFIXES = (5, 6, 7)


def features(sentence: list[bytes]) -> set[bytes]:
    """Distinct words of a sentence and, marked by a star, their beginnings."""
    out = set(sentence)
    for n in PREFIXES:
        out |= {w[:n] + b"*" for w in out if len(w) >= n and w[-1:] != b"*"}
    return out


def sentence_spans(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences that ``sentences`` gives."""
    out, at = [], 0
    for part in data.translate(_TABLE).split(b"\n"):
        if part.split():
            out.append((at, at + len(part)))
        at += len(part) + 1
    return out


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]

    def logits(self, sents: list[list[bytes]]) -> np.ndarray:
        w, known = self.weights, self.weights.keys()
        z = np.full(len(sents), self.bias)
        for k, s in enumerate(sents):
            if found := known & features(s):
                z[k] += sum(sorted(w[x] for x in found))
        return z

    def document(self, data: bytes) -> tuple[float, int | None, float]:
        """Noisy-or probability, the most toxic sentence's number, and that sentence's probability."""
        sents = sentences(data)
        if not sents:
            return 0.0, None, 0.0
        z = self.logits(sents)
        top = int(np.argmax(z))
        return float(-np.expm1(-np.logaddexp(0, z).sum())), top, float(1 / (1 + np.exp(-z[top])))


def train(texts: list[bytes], labels: list[int], vocabulary: int = 500, steps: int = 300, penalty: float = 1e-4, least_documents: int = 8) -> Model:
    """Fit on a bounded sample on the driver.

    Candidate words are those whose presence is most associated with the label (chi-square); Adam on the mean
    log-loss of the noisy-or, classes weighted equally in sum where one is rarer than a tenth.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        p = (y.mean() if len(y) else 0.0) * 0.98 + 0.01
        return Model(float(np.log(p / (1 - p))), {})
    presence: dict[bytes, int] = {}  # documents with label 0, and those with label 1 in the upper half
    for t, label in zip(texts, y.astype(int).tolist()):
        for w in set().union(*map(features, sentences(t))):
            presence[w] = presence.get(w, 0) + (1 << 32 * label)
    n1, n0 = y.sum(), (1 - y).sum()
    least = min(least_documents, max(1, n1))
    found = sorted((w, c & 0xFFFFFFFF, c >> 32) for w, c in presence.items() if (c & 0xFFFFFFFF) + (c >> 32) >= least)
    del presence
    names, c0, c1 = [f[0] for f in found], np.array([f[1] for f in found], float), np.array([f[2] for f in found], float)
    spread = (c0 + c1) * (n0 + n1 - c0 - c1) + 1e-9
    chi = (c1 * (n0 - c0) - c0 * (n1 - c1)) ** 2 * (n0 + n1) / (n0 * n1 * spread)
    chosen = [names[k] for k in np.lexsort((np.arange(len(names)), -chi))[:vocabulary]]
    number = {w: k for k, w in enumerate(chosen)}
    rows, cols, owner = [], [], []
    for d, t in enumerate(texts):
        for s in sentences(t):
            k = len(owner)
            owner.append(d)
            found = sorted(number[w] for w in number.keys() & features(s))
            rows += [k] * len(found)
            cols += found
    rows, cols, owner = np.array(rows, np.int64), np.array(cols, np.int64), np.array(owner, np.int64)
    weight = np.where(y == 1, max(1.0, 0.1 * len(y) / n1), 1.0)
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(rows, theta[cols], len(owner))
        nll = np.bincount(owner, np.logaddexp(0, z), len(y))  # minus log of "no sentence is toxic"
        p = -np.expm1(-nll)
        # d loss / d nll: 1 for label 0; -(1 - p) / p for label 1
        g_doc = weight * np.where(y == 1, -(1 - p) / np.maximum(p, 1e-9), 1.0) / len(y)
        g_sent = g_doc[owner] / (1 + np.exp(-z))
        grad = np.r_[np.bincount(cols, g_sent[rows], len(chosen)), g_sent.sum()]
        grad[:-1] += penalty * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    keep = np.flatnonzero(np.abs(theta[:-1]) > 1e-3)
    return Model(float(theta[-1]), {chosen[k]: float(theta[k]) for k in keep})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = 2000, most_negative: int = 6000, most_chars: int = 20_000) -> Model:
    """Fit on at most ``most_positive`` + ``most_negative`` labelled documents, the first in order of a hash of
    their ids (texts over ``most_chars`` characters aren't drawn, so the driver gets so many characters of each at
    most). Null ids, labels and texts are left out; a document with several labels counts as 1 if any is, and of
    several rows with one id the least text is drawn."""
    own = only(labels, id_col, label_col).where(f"`{id_col}` is not null and `{label_col}` is not null").groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    order = F.xxhash64(F.lit(5), "i")
    drawn = [own.where(F.col("y") == y).orderBy(order, "i").limit(n) for y, n in ((1, most_positive), (0, most_negative))]
    ids = [(r["i"], r["y"]) for d in drawn for r in d.collect()]
    if not ids:
        return train([], [])
    table = docs.sparkSession.createDataFrame(ids, "i long, y int")
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= most_chars))
    sample = rows.join(F.broadcast(table), "i").groupBy("i", "y").agg(F.min(F.col("t").cast("binary")).alias("t")).collect()
    sample.sort(key=lambda r: r["i"])
    return train([bytes(r["t"]) for r in sample], [r["y"] for r in sample])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, worst_sentence (number from 0, null without sentences), worst_score, worst_text.

    Null and empty texts have no sentences and score 0. Every row gives one row, null ids included.
    """
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, numbers, tops, texts = [], [], [], []
            for x in batch.column(1):
                data = x.as_py()
                p, top, worst = model.document(data)
                scores.append(p)
                numbers.append(top)
                tops.append(worst)
                a, b = sentence_spans(data)[top] if top is not None and p >= 0.5 else (0, 0)
                texts.append(data[a:b].decode("utf-8", "replace").strip() or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64()), pa.array(tops, pa.float64()), pa.array(texts, pa.string())], ["doc_id", "score", "worst_sentence", "worst_score", "worst_text"])

    return rows.mapInArrow(tidy(run), "doc_id long, score double, worst_sentence long, worst_score double, worst_text string")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sentence with probability ``least`` or more: doc_id, sentence, score, text."""
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = x.as_py()
                p = 1 / (1 + np.exp(-shared.value.logits(sentences(data))))
                spans = sentence_spans(data)
                out += [(doc_id, k, float(p[k]), data[slice(*spans[k])].decode("utf-8", "replace").strip()) for k in np.flatnonzero(p >= least).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.string()))], ["doc_id", "sentence", "score", "text"])

    return rows.mapInArrow(tidy(run), "doc_id long, sentence long, score double, text string")

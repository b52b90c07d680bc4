"""Quality scores by a naive Bayes support vector machine.

A text is the set of its n-grams: of bytes, and of the outline that is left when runs of letters, digits or marks of one
kind are written as one sign. Each n-gram's indicator is scaled by the logarithm of how much more often it occurs in one
class than in the other (naive Bayes), the vector is brought to length one, and a linear machine with squared hinge loss is fitted
by dual coordinate descent. Its weights are drawn towards their mean size, and a logistic function makes scores of margins.

N-grams are hashed to BINS places, so a text of any length is 8 KB of bits at most; that, for a bounded number of labelled
texts, is all that the driver sees of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import arrow_map

#: Places of n-grams, their lengths in bytes and in signs of the outline, and the bytes of a text that are treated at once.
BINS, BYTE_GRAMS, OUTLINE_GRAMS, BLOCK = 1 << 16, (1, 2, 3), (3, 5, 8), 1 << 18
#: Training rows of each class at most in expectation, chosen by a hash of the id.
TEXTS_PER_CLASS = 2000
ALPHA, COST, BETA, EPOCHS, FOLDS, SEED = 1.0, 1.0, 0.25, 10, 3, 11
THRESHOLD = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _signs() -> np.ndarray:
    """Of each byte: a sign of its kind. Capitals, other letters (all bytes past ASCII are), digits, blanks and line ends are a kind each; marks stand for themselves."""
    kind = np.arange(256, dtype=np.uint8)
    for k in range(256):
        c = chr(k)
        kind[k] = ord("A") if "A" <= c <= "Z" else ord("a") if "a" <= c <= "z" or k > 127 else ord("0") if c.isdigit() else ord(" ") if c in " \t\r" else k
    return kind


SIGNS = _signs()


def _grams(codes: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Places of all runs of n codes."""
    if len(codes) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(codes) - n + 1, kind * 64 + n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return (h % np.uint64(BINS)).astype(np.int64)


def indicators(text: bytes) -> np.ndarray:
    """Bits of the places that the text's n-grams take. Long texts go block by block; each block but the first begins with what the n-grams over the bound need."""
    on = np.zeros(BINS, bool)
    tail, outline_tail = np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    for at in range(0, len(text), BLOCK):
        fresh = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
        codes = np.r_[tail, fresh]
        signs = SIGNS[fresh]
        first = not len(outline_tail) or signs[0] != outline_tail[-1]
        outline = np.r_[outline_tail, signs[np.r_[first, signs[1:] != signs[:-1]]]]
        for n in BYTE_GRAMS:
            on[_grams(codes, n, 1)] = True
        for n in OUTLINE_GRAMS:
            on[_grams(outline, n, 2)] = True
        tail, outline_tail = codes[-(max(BYTE_GRAMS) - 1) :], outline[-(max(OUTLINE_GRAMS) - 1) :]
    return on


def ratios(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each place: the logarithm of its smoothed share of class 1's indicators over its share of class 0's. rows: packed bits."""
    share = []
    for label in (1, 0):
        total = np.full(BINS, ALPHA)
        for r in rows[y == label]:
            total += np.unpackbits(r)
        share.append(total / total.sum())
    return np.log(share[0] / share[1])


def descend(rows: np.ndarray, y: np.ndarray, r: np.ndarray, epochs: int = EPOCHS, cost: float = COST, tolerance: float = 1e-3) -> np.ndarray:
    """Weights w (the last is the bias) of least |w|^2 / 2 + sum of c_i max(0, 1 - s_i w.x_i)^2: dual coordinate descent, one dual variable at a time in a drawn order, until no projected gradient of a round is past the tolerance. Each class weighs the same in all."""
    rng = np.random.default_rng(SEED)
    sign = np.where(y == 1, 1.0, -1.0)
    c = cost * len(y) / 2 / np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum()))
    w, bias, dual, square = np.zeros(BINS), 0.0, np.zeros(len(y)), r * r
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at = np.flatnonzero(np.unpackbits(rows[i]))
            size = np.sqrt(max(square[at].sum(), 1e-12))
            x = r[at] / size
            g = sign[i] * (x @ w[at] + bias) - 1 + dual[i] / (2 * c[i])
            pg = min(g, 0.0) if dual[i] == 0 else g
            worst = max(worst, abs(pg))
            if pg:
                new = max(0.0, dual[i] - g / ((x @ x) + 1 + 1 / (2 * c[i])))
                step = (new - dual[i]) * sign[i]
                w[at] += step * x
                bias += step
                dual[i] = new
        if worst < tolerance:
            break
    return np.r_[w, bias]


@dataclass
class QualityModel:
    """weights: of each place, ratio and machine in one; square: of the ratio, for the length."""

    weights: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, on: np.ndarray) -> float:
        at = np.flatnonzero(on)
        return float(self.weights[at].sum() / np.sqrt(max(self.square[at].sum(), 1e-12)) + self.bias)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.shift, -40, 40))))


def machine(rows: np.ndarray, y: np.ndarray) -> QualityModel:
    r = ratios(rows, y)
    w = descend(rows, y, r)
    drawn = (1 - BETA) * np.abs(w[:-1]).mean() + BETA * w[:-1]
    return QualityModel((drawn * r).astype(np.float32), (r * r).astype(np.float32), BETA * float(w[-1]), 1.0, 0.0)


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic function, targets drawn in from 0 and 1; Newton steps, halved while they do not help."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.c_[margin, np.ones(len(margin))]
    loss = lambda p: float((weight * (np.logaddexp(0, x @ p) - t * (x @ p))).sum() + 1e-6 * (p @ p))
    p = np.zeros(2)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 2e-6 * np.eye(2), x.T @ (weight * (q - t)) + 2e-6 * p)
        size = 1.0
        while size > 1e-6 and loss(p - size * step) > loss(p):
            size /= 2
        p = p - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def train(rows: np.ndarray, y: np.ndarray, folds: np.ndarray, counts: dict[int, int]) -> QualityModel:
    """From packed indicators and labels 0 and 1. Margins for the logistic function come from machines that have not seen the row; counts of all labelled rows give each class its weight there. A class without rows: every text gets the other's share."""
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not (y == 1).any() or not (y == 0).any():
        flat = np.zeros(BINS, np.float32)
        return QualityModel(flat, flat, 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    unseen = np.full(len(y), np.nan)
    for k in range(FOLDS):
        here = folds == k
        if here.any() and all(((y == label) & ~here).any() for label in (0, 1)):
            part = machine(rows[~here], y[~here])
            unseen[here] = [part.margin(np.unpackbits(r)) for r in rows[here]]
    model = machine(rows, y)
    left = np.flatnonzero(np.isnan(unseen))
    unseen[left] = [model.margin(np.unpackbits(rows[i])) for i in left]
    weight = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum())
    model.slope, model.shift = logistic(unseen, y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """From documents (doc_id, text) that labels (doc_id, quality) name with 0 or 1. Training reads TEXTS_PER_CLASS documents of each class at most in expectation. A document labelled twice counts as 0 if one says so; rows equal in id and indicators count once; of rows that share an id those are read that a hash of id and text picks. Null ids and other labels teach nothing."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(F.min("quality").cast("int").alias("l_quality"))
    counts = {r["l_quality"]: r["n"] for r in rows.groupBy("l_quality").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("l_quality") == 1, min(1.0, TEXTS_PER_CLASS / max(1, counts.get(1, 0)))).otherwise(min(1.0, TEXTS_PER_CLASS / max(1, counts.get(0, 0))))
    draw = lambda *of: F.pmod(F.xxhash64(*of, F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the ids of twice TEXTS_PER_CLASS rows in expectation go to every executor; texts stay there
    own = texts.join(F.broadcast(rows.where(draw("l_doc") < rate)), F.col("doc_id") == F.col("l_doc")).select("l_doc", "l_quality", F.coalesce("text", F.lit("")).alias("text"))
    several = own.groupBy("l_doc").agg(F.approx_count_distinct(F.xxhash64("text")).alias("k"))
    picked = own.join(several, "l_doc").where((F.col("k") <= 2) | (draw("l_doc", "text") < 1 / F.col("k"))).select("l_doc", "l_quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(indicators(t or b"")).tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["l_doc", "l_quality", "bits"])

    found = sorted({(r["l_doc"], r["l_quality"], bytes(r["bits"])) for r in arrow_map(picked, run, "l_doc long, l_quality int, bits binary").collect()})
    bits = np.array([np.frombuffer(b, np.uint8) for *_, b in found]).reshape(-1, BINS // 8)
    # a fold by a hash of the indicators, so that copies never stand on both sides
    folds = np.array([int.from_bytes(b[:4096:97], "little") % 1_000_003 % FOLDS for *_, b in found], np.int64)
    return train(bits, np.array([q for _, q, _ in found], np.int64), folds, counts)


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row, from its whole text; null texts score as empty ones. Rows with the same or a null id stay rows of their own; extra columns are ignored. No rows: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes a bin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            scores = [own.score(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")

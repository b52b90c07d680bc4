"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a fixed-length window, each is max-pooled, and a softmax
layer gives the languages. It is trained in numpy on windows of a bounded number of labelled texts. A text is
applied window by window, over its whole length; its score for a language is the mean over its windows,
weighted by the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import arrow_map

#: Training reads that many texts of each language at most in expectation (all, where there are fewer), WINDOWS cuts of each.
TEXTS_PER_LANGUAGE, WINDOWS = 1000, 3
LENGTH, EMBED, WIDTHS, FILTERS = 256, 4, (2, 3, 4), 16
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 7
WIDEST, PAD, CHUNK = max(WIDTHS), 256, 64
#: Windows of a text that are held at once.
BLOCK = 256
UNDETERMINED = "und"


@dataclass
class ByteCnn:
    """Filters of every width are one filter of the widest with zeros behind. Bytes past a text's end embed as zero."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> ByteCnn:
        n = len(WIDTHS) * FILTERS
        embedding = rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        embedding[PAD] = 0
        filters = rng.normal(0, 0.4, (WIDEST * EMBED, n)).astype(np.float32) * cls.mask()
        return cls(languages, embedding, filters, np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    @staticmethod
    def mask() -> np.ndarray:
        return np.concatenate([np.repeat(np.arange(WIDEST) < w, EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """windows (n, LENGTH + WIDEST - 1) of byte ids: the embedded bytes under each place of a filter, (n, LENGTH, WIDEST * EMBED)."""
        e = self.embedding[windows]
        n, step = len(windows), e.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (n, LENGTH, WIDEST * EMBED), (step[0], step[1], step[2])))

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cols = self.columns(windows)
        return cols, (cols.reshape(-1, WIDEST * EMBED) @ self.filters).reshape(len(windows), LENGTH, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), CHUNK):
            _, conv = self.pooled(windows[at : at + CHUNK])
            hidden = np.maximum(conv.max(axis=1) + self.bias, 0)
            out.append(softmax(hidden @ self.dense + self.dense_bias))
        return np.concatenate([np.zeros((0, len(self.languages)), np.float32), *out])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the cross entropy of windows x with labels y, summed with that weight each."""
        cols, conv = self.pooled(x)
        place = conv.argmax(axis=1)
        rows, n = np.arange(len(x))[:, None], conv.shape[2]
        raw = conv[rows, place, np.arange(n)[None, :]] + self.bias
        hidden = np.maximum(raw, 0)
        p = softmax(hidden @ self.dense + self.dense_bias)
        p[np.arange(len(x)), y] -= 1
        p *= weight[:, None]
        back = (p @ self.dense.T) * (raw > 0)
        under = cols[rows, place]  # (batch, filters, widest * embed)
        grads = {"dense": hidden.T @ p, "dense_bias": p.sum(axis=0), "bias": back.sum(axis=0), "filters": np.einsum("bf,bfk->kf", back, under) * self.mask()}
        at_bytes = x[rows[:, :, None], place[:, :, None] + np.arange(WIDEST)[None, None, :]]
        to_bytes = (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        grads["embedding"] = np.zeros_like(self.embedding)
        np.add.at(grads["embedding"], at_bytes.reshape(-1), to_bytes)
        grads["embedding"][PAD] = 0
        return grads


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> ByteCnn:
    """Adam on the cross entropy, each language weighing the same. A quarter of the windows is cut short, as short texts are."""
    rng = np.random.default_rng(SEED)
    net = ByteCnn.new(languages, rng)
    names = ("embedding", "filters", "bias", "dense", "dense_bias")
    first, second, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    count = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / np.maximum(count, 1) / max(1, (count > 0).sum())).astype(np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y = windows[pick].copy(), labels[pick]
            short = rng.random(len(x)) < 0.25
            ends = np.where(short, rng.integers(6, LENGTH, len(x)), x.shape[1])
            x[np.arange(x.shape[1])[None, :] >= ends[:, None]] = PAD
            grads = net.gradients(x, y, weight[y] / len(x))
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-3
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                step = rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


def cut_windows(texts: list[bytes], most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover every text, of its first most bytes if given: (windows, the text each is of, its bytes). A filter at a window's end sees the bytes that follow."""
    flat = np.frombuffer(b"".join(texts) + b"\0" * (LENGTH + WIDEST), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    begin = end - size
    covered = size if most is None else np.minimum(size, most)
    number = -(-covered // LENGTH)
    of = np.repeat(np.arange(len(texts)), number)
    starts = begin[of] + LENGTH * (np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number))
    at = starts[:, None] + np.arange(LENGTH + WIDEST - 1)[None, :]
    windows = np.where(at < end[of][:, None], flat[np.minimum(at, len(flat) - 1)].astype(np.int16), PAD)
    return windows, of, np.minimum(LENGTH, (begin + covered)[of] - starts)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(net: ByteCnn | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Without a letter (or a net): undetermined, 0. Long texts are cut in blocks, so that memory is bounded; a block brings the bytes that its last filters see, so blocks give what the whole text gives."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if net is None:
        return names, scores
    use = [k for k, t in enumerate(texts) if has_letter(t)]
    total = np.zeros((len(use), len(net.languages)))
    block = BLOCK * LENGTH
    pieces = [(j, texts[k][s : s + block + WIDEST - 1]) for j, k in enumerate(use) for s in range(0, len(texts[k]), block)]
    at = 0
    while at < len(pieces):
        end, held = at, 0
        while end < len(pieces) and (end == at or held + len(pieces[end][1]) <= block):
            held += len(pieces[end][1])
            end += 1
        windows, of, n = cut_windows([p for _, p in pieces[at:end]], block)
        owner = np.array([j for j, _ in pieces[at:end]])[of]
        np.add.at(total, owner, net.probabilities(windows) * n[:, None])
        at = end
    best = total.argmax(axis=1) if len(use) else []
    for j, k in enumerate(use):
        names[k] = net.languages[best[j]]
        scores[k] = float(min(1.0, total[j, best[j]] / total[j].sum()))
    return names, scores


def fit(labelled: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE) -> ByteCnn | None:
    """From (doc_id, text, lang). Rows with a null language or an empty text teach nothing; none at all give no net. The driver gets short cuts of a bounded number of texts, chosen by a hash of id and text; rows equal in id and cuts count once."""
    rows = labelled.where("lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, texts_per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.length("text") - LENGTH, F.lit(1))
    cuts = [F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1).cast("int"), F.lit(LENGTH + WIDEST)) for k in range(WINDOWS)]
    picked = rows.where(chance < rate[F.col("lang")]).select("doc_id", "lang", *[c.alias(f"c{k}") for k, c in enumerate(cuts)]).distinct().orderBy("lang", *[f"c{k}" for k in range(WINDOWS)]).collect()
    languages = sorted(counts)
    windows, labels = [], []
    for r in picked:
        for k in range(WINDOWS):
            b = r[f"c{k}"].encode()[: LENGTH + WIDEST - 1]
            if b:
                windows.append(np.r_[np.frombuffer(b, np.uint8).astype(np.int16), np.full(LENGTH + WIDEST - 1 - len(b), PAD, np.int16)])
                labels.append(languages.index(r["lang"]))
    return train(np.array(windows), np.array(labels), languages) if windows else None


def identify(docs: DataFrame, net: ByteCnn | None, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score added after all columns, of which those so named go; without the text unless it is kept. Null and letterless texts: undetermined, 0. No rows: no rows."""
    from pyspark.sql import types as T

    net = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the network's size
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns
    at = columns.index("text")
    kept = [k for k in range(len(columns)) if keep_text or k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = predict(net.value, [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(columns[k] for k in kept), "lang_pred", "score"])

    out = T.StructType([*(docs.schema.fields[k] for k in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs, run, out)


def predicted(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs, learnt from labelled. Null and letterless texts: undetermined, 0. Rows with the same or a null id stay rows of their own; extra columns are ignored. No rows: no rows."""
    return identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(labelled), keep_text=False)


def stage(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs without those whose language is undetermined: null, empty and letterless texts. All columns stay. No rows: no rows."""
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    found = identify(whole, fit(labelled)).where(F.col("lang_pred") != UNDETERMINED)
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

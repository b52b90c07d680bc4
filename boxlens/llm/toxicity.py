"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two words is the sum, over the 4-letter subsequences they share (a word's start counts as a letter), of
DECAY to the power of the letters each skips, up to SPAN letters from first to last, divided by a norm of each word's
length. A gap in an insult, or a character put into it, leaves most of its subsequences.

Labels are of whole texts. The words that tell are found by greedy cover: few words, far more common in toxic texts
than in clean ones, that explain the toxic texts. They and clean words, with characters inserted in copies, train the
machine; landmarks are a part of them. A linear function of kernel values with landmarks is a linear function of
subsequences, so the trained machine is one weight for each subsequence, and a text is scored in a pass over its
letters. Its three worst words, the number of bad ones and of all go through a logistic function fitted on the
training texts.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map, slices

#: Labelled texts that training reads, in expectation (all, where there are fewer).
TOXIC_TEXTS, CLEAN_TEXTS = 1500, 3000
ORDER, SPAN, DECAY = 4, 7, 0.75
#: A telling word is so many times as common in toxic texts. They are chosen until one explains fewer new toxic texts than
#: LEAST_GAIN, or there are MOST_TELLING; a text is explained by DEPTH of them.
ODDS, LEAST_GAIN, DEPTH, MOST_TELLING, CLEAN_WORDS, LANDMARKS = 15, 3, 3, 300, 4000, 400
WINDOW, STEP, ROUNDS, SEED, THRESHOLD = 14, 4, 5, 11, 0.7
SLICE_CHARS = 1 << 17
#: The code that every word begins with.
START = 31
#: Digits and signs that are written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SPACE, DROP, TABLE = 0, 255, 0x3000


# --- words ----------------------------------------------------------------------------------------------


@lru_cache(1)
def _codes() -> np.ndarray:
    """Of each code point: 1 to 26 for the letters that are a to z without case and marks, 27 to 30 for others, 0 for white space, 255 for what is dropped."""
    table = np.full(TABLE, DROP, np.uint8)
    for cp in range(TABLE):
        c = LOOKALIKES.get(chr(cp), chr(cp))
        base = unicodedata.normalize("NFD", c.lower())[:1]
        if "a" <= base <= "z":
            table[cp] = ord(base) - 96
        elif c.isspace():
            table[cp] = SPACE
        elif c.isalpha():
            table[cp] = 27 + cp % 4
    return table


def letter_codes(text: str) -> np.ndarray:
    """A code for each character that is not dropped."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    high = points >= TABLE
    codes = _codes()[np.where(high, 0, points)]
    if high.any():
        codes = np.where(high, 27 + points % 4, codes).astype(np.uint8)
    return codes[codes != DROP]


def split_words(codes: np.ndarray, headless: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """The words' codes, START first in each (but in the first if it is headless), the length of each, and where the last word begins. A run of one-letter words is one word."""
    letter = codes != SPACE
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    size = edge[1::2] - edge[::2]
    if not len(size):
        return codes[:0], size, len(codes)
    alone = size == 1
    fresh = np.ones(len(size), bool)
    fresh[1:] = ~(alone[1:] & alone[:-1])
    first = np.flatnonzero(fresh)
    size = np.add.reduceat(size, first)
    words, size = np.insert(codes[letter], np.cumsum(size) - size, START), size + 1
    if headless:
        words, size = words[1:], np.r_[size[0] - 1, size[1:]]
    return words, size, int(edge[::2][first[-1]])


def in_windows(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than WINDOW codes as windows of that many, STEP apart, the last at the word's end: what an insult is worth does not depend on how long a word it stands in."""
    if not len(size) or size.max() <= WINDOW:
        return codes, size
    number = np.where(size > WINDOW, -(-(size - WINDOW) // STEP) + 1, 1)
    of = np.repeat(np.arange(len(size)), number)
    begin = (np.cumsum(size) - size)[of] + np.minimum(STEP * (np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)), np.maximum(size - WINDOW, 0)[of])
    length = np.minimum(size, WINDOW)[of]
    return codes[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())], length


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words' codes and the length of each. Signs inside a word are dropped."""
    return in_windows(*split_words(letter_codes(text))[:2])


def encoded_parts(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """encode() in parts that give the words of the whole text. The last word of a part, which may go on, is taken over into the next; of a long one only what its windows to come need, headless then."""
    carried, headless = np.zeros(0, np.uint8), False
    for at in range(0, len(text), SLICE_CHARS):
        codes = np.concatenate([carried, letter_codes(text[at : at + SLICE_CHARS])])
        words, size, last = split_words(codes, headless)
        if at + SLICE_CHARS >= len(text):
            yield in_windows(words, size)
            return
        raw = codes[last:]
        carried = raw[(raw != SPACE) | (np.r_[False, raw[:-1] != SPACE])]  # one space says as much as many
        if not len(size):
            carried, headless = carried[:0], False
            continue
        headless, own, begin = headless and len(size) == 1, int(size[-1]), int(size[:-1].sum())
        # windows that end more than STEP before what is known, of which the last letter can turn out to begin another word
        done = max(0, (own - 1 - WINDOW - STEP) // STEP + 1)
        if done:
            ready = words[begin + (STEP * np.arange(done)[:, None] + np.arange(WINDOW)).ravel()]
            letters = np.flatnonzero(carried != SPACE)
            carried, headless = carried[letters[STEP * done - (not headless)] :], True
        else:
            ready = words[:0]
        head, length = in_windows(words[:begin], size[:-1])
        yield np.concatenate([head, ready]), np.r_[length, np.full(done, WINDOW)].astype(np.int64)


def word_norms(size: np.ndarray) -> np.ndarray:
    """The kernel's norm of a word of that length with no subsequence twice."""
    square = sum(np.maximum(size - d, 0) * len(list(combinations(range(d - 1), ORDER - 2))) * DECAY ** (2 * (d + 1 - ORDER)) for d in range(ORDER - 1, SPAN))
    return np.sqrt(np.maximum(square, 1))


def subsequences(codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, subsequence, value) of all words, in parts by where its letters lie."""
    c = codes.astype(np.int32)
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c)) - 1
    for last in range(ORDER - 1, SPAN):
        at = np.flatnonzero(left >= last)
        if not at.size:
            return
        ends = c[at] << 15 | c[at + last]
        letters = [c[at + d] for d in range(1, last)]
        for x, y in combinations(range(last - 1), ORDER - 2):
            yield owner[at], ends | letters[x] << 10 | letters[y] << 5, DECAY ** (last + 1 - ORDER)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, subsequences and values of the words' normed feature vectors."""
    codes, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    parts = [(r, s, np.full(len(r), v)) for r, s, v in subsequences(codes, size)]
    none = np.zeros(0, np.int64)
    rows, seqs, values = (np.concatenate([none, *(p[i] for p in parts)]) for i in range(3))
    return rows.astype(np.int64), seqs.astype(np.int64), values / word_norms(size)[rows.astype(np.int64)]


# --- training -------------------------------------------------------------------------------------------


@dataclass
class StringKernelSvm:
    weights: np.ndarray
    bias: float
    slope: np.ndarray
    shift: float
    mean: np.ndarray | float = 0.0
    spread: np.ndarray | float = 1.0

    def values(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each word; words too short for a subsequence have the bias."""
        total = np.zeros(len(size))
        for owner, seqs, value in subsequences(codes, size):
            total += np.bincount(owner, self.weights[seqs], len(size)) * value
        return total / word_norms(size) + self.bias

    def evidence(self, text: str) -> np.ndarray:
        """Of the whole text; long texts go in parts."""
        return summed_up(np.concatenate([np.zeros(0), *(self.values(*part) for part in encoded_parts(text))]), self.bias)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((evidence - self.mean) / self.spread) @ self.slope + self.shift, -40, 40)))


def summed_up(values: np.ndarray, bias: float) -> np.ndarray:
    """Worst, second and third worst word, number of bad ones and of all."""
    top = np.sort(np.partition(values, -3)[-3:] if len(values) > 3 else values)[::-1]
    top = np.r_[top, np.full(3 - len(top), bias)]
    return np.r_[np.clip(top, -2, 1), np.log1p((values > 0).sum()), np.log1p(len(values))]


def text_words(text: str) -> set[bytes]:
    found: set[bytes] = set()
    for codes, size in encoded_parts(text):
        raw, ends = codes.tobytes(), np.cumsum(size)
        found |= {raw[e - n : e] for n, e in zip(size.tolist(), ends.tolist(), strict=True) if n >= ORDER}
    return found


def telling_words(toxic: list[set[bytes]], clean: list[set[bytes]]) -> list[tuple[bytes, int]]:
    """Greedy cover by words that are ODDS times as common in toxic texts: each with the number of toxic texts that hold it."""
    seen = Counter(w for words in clean for w in words)
    holders: dict[bytes, list[int]] = {}
    for k, words in enumerate(toxic):
        for w in words:
            holders.setdefault(w, []).append(k)
    share = lambda n, of: (n + 0.5) / (of + 1)
    holders = {w: ks for w, ks in holders.items() if len(ks) >= LEAST_GAIN and share(len(ks), len(toxic)) >= ODDS * share(seen[w], len(clean))}
    chosen, open_ = [], dict.fromkeys(range(len(toxic)), DEPTH)
    while len(chosen) < MOST_TELLING and holders:
        gain = {w: sum(open_[k] > 0 for k in ks) for w, ks in holders.items()}
        best = max(gain, key=lambda w: (gain[w], len(holders[w]), w))  # ties: more texts in all, then the word itself
        if gain[best] < LEAST_GAIN:
            break
        chosen.append((best, len(holders[best])))
        for k in holders.pop(best):
            open_[k] -= 1
        holders = {w: ks for w, ks in holders.items() if gain[w] >= LEAST_GAIN}
    return chosen


def _disturbed(words: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """With a letter put in somewhere, as insults are disguised."""
    out = []
    for w in words:
        at = int(rng.integers(2, len(w)))
        out.append(w[:at] + bytes([int(rng.integers(1, 27))]) + w[at:])
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, turns: int = 30) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps over the rows inside the margin."""
    x = np.c_[z, np.ones(len(z))]
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    eye[-1, -1] = 1e-8
    inside = np.ones(len(x), bool)
    for _ in range(turns):
        a, b = x[inside], weight[inside, None]
        w = np.linalg.solve((a * b).T @ a + eye, (a * b).T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Platt's: targets drawn in from 0 and 1. Newton steps, halved while they do not help."""
    positive, negative = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.c_[x, np.ones(len(x))]
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - t * z) + (keep * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - t) + keep * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(in_toxic: list[set[bytes]], in_clean: list[set[bytes]], evidence: Callable[[StringKernelSvm], tuple[np.ndarray, np.ndarray]]) -> StringKernelSvm:
    """From the words of each training text; evidence gives what a machine makes of the texts, and their labels. Without telling words (or without texts of a class) every text gets the share of toxic ones."""
    rng = np.random.default_rng(SEED)
    telling = telling_words(in_toxic, in_clean)
    flat = StringKernelSvm(np.zeros(1 << 20, np.float32), 0.0, np.zeros(5), float(np.log((len(in_toxic) + 1) / (len(in_clean) + 1))))
    common = Counter(w for words in in_clean for w in words)
    if not telling or not common:
        return flat
    names = [w for w, _ in telling]
    ordered = sorted(common, key=lambda w: (-common[w], w))
    some = ordered[: CLEAN_WORDS // 2] + [ordered[i] for i in sorted(rng.choice(len(ordered), min(len(ordered), CLEAN_WORDS // 2), replace=False))]
    some = list(dict.fromkeys(some))
    half = LANDMARKS // 2
    marks = names[:half] + some[:: max(1, len(some) // half)][:half]
    rows, seqs, values = features(marks)
    column, at = np.unique(seqs, return_inverse=True)
    phi = np.zeros((len(marks), len(column)))
    np.add.at(phi, (rows, at), values)

    def mapped(words: list[bytes], whiten: np.ndarray) -> np.ndarray:
        out = []
        for s in range(0, len(words), 1000):
            part = words[s : s + 1000]
            r, q, v = features(part)
            k = np.searchsorted(column, q)
            ok = (k < len(column)) & (column[np.minimum(k, len(column) - 1)] == q)
            x = np.zeros((len(part), len(column)))
            np.add.at(x, (r[ok], k[ok]), v[ok])
            out.append(x @ phi.T @ whiten)
        return np.concatenate(out)

    values_, vectors = np.linalg.eigh(phi @ phi.T)
    good = values_ > 1e-8 * values_.max()
    whiten = vectors[:, good] / np.sqrt(values_[good])
    positives = names + [w for _ in range(4) for w in _disturbed(names, rng)]
    for _ in range(ROUNDS):  # each with the clean words that come nearest after the one before
        z = mapped(positives + some, whiten)
        y = np.r_[np.ones(len(positives)), -np.ones(len(some))]
        w, bias = _svm(z, y, np.r_[np.full(len(positives), 1 / len(positives)), np.full(len(some), 1 / len(some))] * 1000)
        tensor = np.zeros(1 << 20, np.float32)
        tensor[column] = phi.T @ (whiten @ w)
        net = StringKernelSvm(tensor, bias, np.zeros(5), 0.0)
        value = net.values(np.frombuffer(b"".join(ordered), np.uint8), np.array([len(x) for x in ordered]))
        known = set(some)
        some += [x for x in (ordered[i] for i in np.argsort(-value, kind="stable")[:1000]) if x not in known]
    f, y = evidence(net)
    net.mean, net.spread = f.mean(axis=0), f.std(axis=0) + 1e-6
    net.slope, net.shift = _logistic((f - net.mean) / net.spread, y)
    return net


def train_on_texts(toxic: list[str], clean: list[str]) -> StringKernelSvm:
    """train() where the texts are at hand."""
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    return train([text_words(t) for t in toxic], [text_words(t) for t in clean], lambda net: (np.array([net.evidence(t) for t in toxic + clean]), y))


def fit(docs: DataFrame, labels: DataFrame) -> StringKernelSvm:
    """From documents that labels (doc_id, toxic) name with 0 or 1. The ids of a bounded number of rows go to every executor; their texts stay there, and their words and evidence go to the driver. A document labelled twice counts as toxic if one says so; rows equal in id and text count once, and of rows that share an id those are read that a hash of id and text picks."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(F.max("toxic").cast("int").alias("l_toxic"))
    counts = {r["l_toxic"]: r["n"] for r in rows.groupBy("l_toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("l_toxic") == 1, min(1.0, TOXIC_TEXTS / max(1, counts.get(1, 0)))).otherwise(min(1.0, CLEAN_TEXTS / max(1, counts.get(0, 0))))
    chance = F.pmod(F.xxhash64("l_doc", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = texts.join(F.broadcast(rows.where(chance < rate)), F.col("doc_id") == F.col("l_doc")).select("l_doc", "l_toxic", F.coalesce("text", F.lit("")).alias("text"))
    # ids that stand for many texts give one in expectation
    several = own.groupBy("l_doc").agg(F.approx_count_distinct(F.xxhash64("text")).alias("k"))
    among = F.pmod(F.xxhash64("l_doc", "text", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    picked = own.join(several, "l_doc").where((F.col("k") <= 2) | (among < 1 / F.col("k"))).select("l_toxic", "text", F.xxhash64("l_doc", "text").alias("key")).dropDuplicates(["key"])
    picked = Workspace(docs.sparkSession, "toxicity").write(picked, "training")
    words: dict[int, list[set[bytes]]] = {0: [], 1: []}
    pool: dict[bytes, bytes] = {}  # each word once in memory
    sent = sorted(arrow_map(picked, _words_of, "key long, l_toxic int, words binary").collect(), key=lambda r: r["key"])
    for r in sent:
        words[r["l_toxic"]].append({pool.setdefault(w, w) for w in bytes(r["words"]).split(bytes([SPACE])) if w})
    del pool, sent

    def evidence(net: StringKernelSvm) -> tuple[np.ndarray, np.ndarray]:
        shared = docs.sparkSession.sparkContext.broadcast(net)  # 4 MB whatever the input

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [shared.value.evidence(t).tolist() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.float64()))], ["l_toxic", "key", "f"])

        got = sorted(arrow_map(picked, run, "l_toxic int, key long, f array<double>").collect(), key=lambda r: r["key"])
        return np.array([r["f"] for r in got]), np.array([float(r["l_toxic"]) for r in got])

    return train(words[1], words[0], evidence)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [bytes([SPACE]).join(sorted(text_words(t))) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(found, pa.binary())], ["key", "l_toxic", "words"])


def scored(docs: DataFrame, net: StringKernelSvm) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts have no insult: the score of a text without words. Rows with the same or a null id stay rows of their own; extra columns are ignored. No rows: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 4 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            evidence = [e for s in slices([len(t) for t in texts], SLICE_CHARS) for e in evidence_of(own, texts[s])]
            scores = own.scores(np.array(evidence).reshape(len(texts), -1)) if texts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def evidence_of(net: StringKernelSvm, texts: list[str]) -> list[np.ndarray]:
    """evidence() of each text, of short ones in one pass."""
    if any(len(t) > SLICE_CHARS for t in texts):
        return [net.evidence(t) for t in texts]
    parts = [encode(t) for t in texts]
    values = net.values(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
    return [summed_up(v, net.bias) for v in np.split(values, np.cumsum([len(p[1]) for p in parts])[:-1])]

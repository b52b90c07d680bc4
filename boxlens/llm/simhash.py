"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, each read as a word of the shortened
binary Golay code [23, 12, 7]. That code is perfect: every word lies within 3 bits of exactly one codeword.
fuzzy(x) is the codeword indices of x and of its one-bit neighbours, at most 6 of them; if x and y differ
in one bit at most, the index of y is in fuzzy(x). Three errors over three segments leave two segments
with at most one error each (the worst is set aside), so for one of the pairs (a, b) of segments
    index(y_a) in fuzzy(x_a)   and   index(x_b) in fuzzy(y_b).
Every fingerprint is therefore filed under index(a) x fuzzy(b) and under fuzzy(a) x index(b): any two
within 3 bits meet in a bucket of 24 bits of key, where their distance is computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map, as_bytes, slices
from boxlens.llm.components import connected_components
from boxlens.llm.near_copies import WIDTH, representatives

SHINGLE, SEED, RADIUS = 3, 42, 3
SLICE_BYTES = 1 << 18
#: First bit and width of each segment, and the pairs of segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GOLAY_POLYNOMIAL = 0xC75
#: Up to this many in a bucket, all its pairs are compared at once; beyond, it is searched breadth first.
SMALL_BUCKET = 16


# --- fingerprints ---------------------------------------------------------------------------------------


@lru_cache(1)
def _spread() -> np.ndarray:
    """For each byte, a word of 8 byte counters that holds its bits."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.ascontiguousarray(bits.astype(np.uint8)).view("<u8")[:, 0]


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of width words, repeats included; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # A-Z only, and at the bytes between words only: this is bytes
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    return majorities([shingle_hashes(t, width) for t in texts])


def majorities(per_text: list[list[int]]) -> np.ndarray:
    """Bit j is 1 if it is set in over half of a text's shingle hashes. uint64; zero without any."""
    n = np.array([len(h) for h in per_text], np.int64)
    out = np.zeros(len(per_text), np.uint64)
    if not n.sum():
        return out
    hashes = np.fromiter((h for hs in per_text for h in hs), "<u8", int(n.sum()))
    counters = _spread()[hashes.view(np.uint8).reshape(-1, 8)]
    # byte counters hold 255 at most: each text is summed in runs of that many rows
    full = np.flatnonzero(n)
    begin = np.cumsum(n) - n
    runs = -(-n[full] // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(begin[full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    sums = np.ascontiguousarray(np.add.reduceat(counters, at, axis=0)).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            parts = [fingerprints(texts[s], width) for s in slices([len(t) for t in texts], SLICE_BYTES)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))], ["doc_id", "fp"])

    return run


# --- keys -----------------------------------------------------------------------------------------------


@lru_cache(1)
def golay_table() -> np.ndarray:
    """Index of the codeword within 3 bits of each 23-bit word."""
    words = np.arange(4096, dtype=np.uint32) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(GOLAY_POLYNOMIAL << (bit - 11)), rest)
    codewords = words | rest
    one = [1 << i for i in range(23)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    table = np.zeros(1 << 23, np.uint16)
    for e in errors:
        table[codewords ^ np.uint32(e)] = np.arange(4096, dtype=np.uint16)
    return table


def fuzzy(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each word; and the rows and values of fuzzy(word), each value once."""
    table = golay_table()
    own = table[words].astype(np.int64)
    near = np.sort(np.concatenate([own[:, None], *(table[words ^ np.uint32(1 << i)].astype(np.int64)[:, None] for i in range(width))], axis=1), axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, cols = np.nonzero(fresh)
    return own, rows, near[rows, cols]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fps and the keys they are filed under."""
    found = [fuzzy(((fps >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.uint32), width) for first, width in SEGMENTS]
    rows, keys = [], []
    for k, (a, b) in enumerate(PAIRS):
        (own_a, rows_a, near_a), (own_b, rows_b, near_b) = found[a], found[b]
        again = near_b == own_b[rows_b]  # fuzzy(a) x index(b) has it too
        rows += [rows_a, rows_b[~again]]
        keys += [k << 24 | near_a << 12 | own_b[rows_a], (k << 24 | own_a[rows_b] << 12 | near_b)[~again]]
    return np.concatenate(rows), np.concatenate(keys)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            rows, keys = bucket_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "fp"])


# --- buckets --------------------------------------------------------------------------------------------


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within radius connect, one less than each group's members. What has been reached is not compared again, so a dense bucket takes far less than its square."""
    left, right, rest = [], [], np.unique(fps)
    while rest.size:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                got = rest[near]
                left.append(np.full(got.size, x, fps.dtype))
                right.append(got)
                todo += list(got)
                rest = rest[~near]
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


class _Forest:
    """What the links of this task connect so far. Only links that connect more are passed on; it holds fingerprints that have a link, in blocks."""

    MOST = 200_000

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (y := p.get(x, x)) != x:
            p[x] = x = p.get(y, y)
        return x

    def fresh(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        if len(self.parent) > self.MOST:
            self.parent.clear()  # links may then be passed on again, none is lost
        out = []
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            if (x := self.root(a)) != (y := self.root(b)):
                self.parent[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def _links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys sorted."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edge)
    left, right = [], []
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    for d in range(1, SMALL_BUCKET):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not at.size:
            break
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= RADIUS]
        left.append(fps[at])
        right.append(fps[at + d])
    for k in np.flatnonzero(sizes > SMALL_BUCKET):
        a, b = spanning_links(fps[edge[k] : edge[k + 1]])
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket may go over a batch's end."""
    forest = _Forest()
    keys, fps = np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def batch(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        found = forest.fresh(*_links_of(k, f))
        return pa.RecordBatch.from_arrays([pa.array(np.array([x[i] for x in found], np.uint64).view(np.int64)) for i in (0, 1)], ["a", "b"])

    for b in batches:
        keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(keys) and keys[0] != keys[-1]:
            end = int(np.searchsorted(keys, keys[-1]))
            yield batch(keys[:end], fps[:end])
            keys, fps = keys[end:], fps[end:]
    if len(keys):
        yield batch(keys, fps)


# --- operator -------------------------------------------------------------------------------------------


def fingerprint_roots(work: Workspace, fps: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints (fp, distinct) that links of RADIUS bits connect to a lesser one, the least."""
    filed = arrow_map(fps, _file, "key int, fp long")
    return connected_components(work, arrow_map(filed.repartition("key").sortWithinPartitions("key"), _verify, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: hex of the fingerprint, smallest doc_id that links reach.

    Null texts have no words: fingerprint zero, linked like any other. Rows with the same id stay rows of their
    own; a null id never names a component. No rows: no rows. Extra columns are ignored.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    marked = work.write(arrow_map(rows, _fingerprint_batches(width), "doc_id long, fp long"), "fingerprints")
    # equal fingerprints count once from here on
    classes = work.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "classes")
    roots = fingerprint_roots(work, classes.select("fp"))
    rooted = work.write(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_doc", F.coalesce("root", "fp").alias("root")), "rooted")
    named = work.write(rooted.groupBy("root").agg(F.min("least_doc").alias("component_id")), "named")
    of_class = work.write(rooted.join(named, "root").select("fp", "component_id"), "of_class")
    return marked.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with one row of each group of near copies (five words, similarity 0.8 or more): the one of the least id, then least text hash; of rows equal in both, one. Candidates share a group of fingerprints within RADIUS bits or, for what 64 bits do not reach, a key of near_copies; their sets decide. Rows with a null id stay. All columns stay. No rows: no rows."""
    kept = representatives(docs, width).select(F.col("doc_id").alias("k_doc"), F.col("h").alias("k_h")).hint("merge")
    # the row as a struct, so that no column of it meets the names used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    one = rows.join(kept, (F.col("_doc") == F.col("k_doc")) & (F.col("_h") == F.col("k_h")), "left_semi").dropDuplicates(["_doc", "_h"])
    return one.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))

"""Near copies by the Jaccard similarity of word shingles, for stages.

A text's set is its distinct hashes of WIDTH words. Two things file a set. Its SimHash fingerprint, with all that Golay keys
connect to it within three bits; copies with a word or two changed are in one such group. And, as a fingerprint of 64 bits
does not tell a similarity of 0.8, BANDS keys, each of ROWS least hashes under functions of their own: two sets of similarity
s share one with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. What shares a file is compared set by set: first with the
least set of it; then, where these links leave it in several groups, in blocks, whose sets' overlaps are products of
matrices within a task. A row is a set in a pair of blocks, never a pair of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map, as_bytes
from boxlens.llm.components import connected_components
from boxlens.llm.spans import keyed

#: Similar is SIMILAR[0] / SIMILAR[1] or more.
WIDTH, SIMILAR, BANDS, ROWS = 5, (4, 5), 20, 5
#: Sets of a block, and their bytes; columns of a matrix.
BLOCK_ROWS, BLOCK_BYTES, COLUMNS = 1024, 4 << 20, 4096
MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes in order."""
    from boxlens.llm.simhash import shingle_hashes

    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * MULTIPLIERS).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * MIX
        keys ^= keys >> np.uint64(29)
    return keys


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        from boxlens.llm.simhash import majorities, shingle_hashes

        for b in batches:
            hashes = [shingle_hashes(t, width) for t in as_bytes(b.column(2))]
            sets = [np.unique(np.array(x, np.uint64)) for x in hashes]
            cls = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = [band_keys(s).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(majorities(hashes).view(np.int64))], ["doc_id", "h", "cls", "n", "keys", "fp"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width).view(np.int64) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cls", "hashes"])

    return run


def _similar_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = ([x.values.to_numpy().view(np.uint64) for x in b.column(c)] for c in ("s_a", "s_b"))
        same = pa.array([similar(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(same), b.column("b").filter(same)], ["a", "b"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of a shares with each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    flat = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in (a, b)]
    shared = np.intersect1d(*flat)
    places = []
    for r, f in zip(rows, flat, strict=True):
        column = np.searchsorted(shared, f)
        both = np.flatnonzero(shared[np.minimum(column, len(shared) - 1)] == f) if len(shared) else np.zeros(0, np.int64)
        both = both[np.argsort(column[both], kind="stable")]
        places.append((r[both], column[both]))
    for at in range(0, len(shared), COLUMNS):
        sides = []
        for (r, column), x in zip(places, (a, b), strict=True):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            side = np.zeros((len(x), COLUMNS), np.float32)
            side[r[lo:hi], column[lo:hi] - at] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _compare(t: pa.Table) -> pa.Table:
    """Links of a pair of blocks of a file (or of one with itself) that connect what its similar sets of different groups connect."""
    cls, root, own, hi = (t.column(c).to_numpy() for c in ("cls", "root", "block", "hi"))
    sets = [x.values.to_numpy().view(np.uint64) for x in t.column("hashes").combine_chunks()]
    size = np.array([len(x) for x in sets])
    left, right = np.flatnonzero(own != hi), np.flatnonzero(own == hi)
    left = left if len(left) else right
    both = overlaps([sets[k] for k in left], [sets[k] for k in right])
    alike = both * SIMILAR[1] >= (size[left][:, None] + size[right][None, :] - both) * SIMILAR[0]
    group: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := group.get(x, x)) != x:
            group[x] = x = group.get(y, y)
        return x

    found = []
    for i, j in zip(*np.nonzero(alike & (root[left][:, None] != root[right][None, :])), strict=True):
        x, y = top(int(root[left[i]])), top(int(root[right[j]]))
        if x != y:
            group[max(x, y)] = min(x, y)
            found.append((int(cls[left[i]]), int(cls[right[j]])))
    return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(work: Workspace, docs: DataFrame, classes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b) of classes (cls, place, n, keys, fp): links that connect what similar pairs in a common file connect. docs: doc_id, h, text."""
    from boxlens.llm.simhash import fingerprint_roots

    marked = classes.where("keys is not null")
    roots = fingerprint_roots(Workspace(work.spark, "fingerprints"), marked.select("fp").distinct())
    group = F.xxhash64(F.lit("fingerprints"), F.coalesce("root", "fp")).alias("key")
    by_group = marked.select("cls", "n", "fp").join(roots, F.col("fp") == F.col("node"), "left").select(group, "cls", "n")
    filed = work.write(marked.select(F.explode("keys").alias("key"), "cls", "n").unionByName(by_group), "filed")
    least = work.write(filed.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("m"), F.count("*").alias("k")).where("k > 1").select("key", F.col("m.cls").alias("m"), F.col("m.n").alias("m_n")), "least")
    shared = work.write(filed.join(least, "key"), "shared")  # of buckets with several classes
    fits = lambda x, y: F.least(x, y) * SIMILAR[1] >= F.greatest(x, y) * SIMILAR[0]  # noqa: E731  sizes further apart are never similar
    wanted = shared.select("cls").distinct().join(classes.select("cls", "place.doc_id", "place.h"), "cls")
    of_text = docs.join(wanted.hint("merge"), ["doc_id", "h"]).dropDuplicates(["cls"]).select("cls", "text")
    sets = work.write(arrow_map(of_text, _sets(width), "cls long, hashes array<long>"), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("s_a")).hint("merge"), "a")
        both = one.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("s_b")).hint("merge"), "b")
        return work.write(arrow_map(both.select("a", "b", "s_a", "s_b"), _similar_only, "a long, b long"), name)

    tried = work.write(shared.where((F.col("cls") != F.col("m")) & fits(F.col("n"), F.col("m_n"))).select(F.col("m").alias("a"), F.col("cls").alias("b")).distinct(), "tried")
    first = verified(tried, "first")
    roots = connected_components(work, first)
    rooted = work.write(shared.join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root")), "rooted")
    open_keys = work.write(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "open")
    rest = work.write(rooted.join(open_keys, "key"), "rest")
    # files of the same sets count once
    shape = rest.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("hashes"), F.expr("bit_xor(xxhash64(cls))").alias("members"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK_ROWS, F.col("hashes") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    shape = work.write(shape.select("key", "k", "hashes", "members", blocks).groupBy("k", "hashes", "members", "blocks").agg(F.min("key").alias("key")).select("key", "blocks"), "shape")
    dealt = rest.join(shape, "key").select("key", "cls", "root", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    held = dealt.join(sets.hint("merge"), "cls").select("key", "cls", "root", "block", "hashes", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = held.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "root", "hashes")
    second = work.write(pairs.groupBy("key", "lo", "hi").applyInArrow(_compare, "a long, b long"), "second")
    return first.unionByName(second)


def representatives(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h) of the least row of each group that similar pairs connect. Rows with a null id are left out; texts without words are one group."""
    work = Workspace(docs.sparkSession, "copies")
    rows = keyed(docs).where("doc_id is not null")
    marked = work.write(arrow_map(rows, _sketches(width), "doc_id long, h long, cls long, n long, keys array<long>, fp long"), "sketches")
    classes = work.write(marked.groupBy("cls").agg(F.min(F.struct("doc_id", "h")).alias("place"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("fp").alias("fp")), "classes")
    roots = connected_components(work, links(work, rows, classes, width))
    rooted = classes.join(roots, F.col("cls") == F.col("node"), "left").select("place", F.coalesce("root", "cls").alias("root"))
    return work.write(rooted.groupBy("root").agg(F.min("place").alias("place")).select("place.doc_id", "place.h"), "kept")

"""Repeated multi-line chunks.

A rolling hash over the hashes of two lines chooses boundaries, which therefore depend on nothing before those lines; between
two lines of white space there always is one. What lies between boundaries is a chunk. Chunks with an equal digest are
candidates, and grouping them by their bytes compares them: all but the first of a group (least doc_id, then least
line; null ids last) are removed.

A repeated run of lines need not hold a whole chunk, and its ends seldom are a chunk's. So the pairs of neighbouring lines
are compared in the same way: those over a boundary, and those inside the first chunk of each group. The first place of a
pair is never inside a later chunk, so nothing is lost there, and a chunk that a million documents share gives its pairs
once. Any run of two lines or more that occurs before goes whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map
from boxlens.llm.spans import cut_out, joined, keyed, with_text

#: Lines of a chunk on average; and the fewest of a run that goes.
AVERAGE, MIN_LINES = 4, 2
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ROW = "doc_id long, h long, start int, n int, c1 long, c2 long, pairs array<struct<p1: bigint, p2: bigint>>"


def lines(text: bytes) -> list[bytes]:
    """Lines without their line feeds. An empty text has none."""
    return text.split(b"\n") if text else []


def chunks(rows: list[bytes]) -> list[tuple[int, int]]:
    """(start, n) of the chunks of a document's lines, one after another."""
    from xxhash import xxh3_64_intdigest

    if not rows:
        return []
    hashes = np.fromiter(map(xxh3_64_intdigest, rows), np.uint64, len(rows))
    rolling = np.r_[np.uint64(0), hashes[:-1]] * MULTIPLIER + hashes
    rolling = (rolling ^ (rolling >> np.uint64(31))) * MIX
    blank = np.fromiter((not r.strip() for r in rows), bool, len(rows))
    ends = (rolling >> np.uint64(40)) % np.uint64(AVERAGE) == 0
    ends[:-1] |= blank[:-1] & blank[1:]
    ends[-1] = True
    edges = np.r_[0, np.flatnonzero(ends) + 1].tolist()
    return [(s, e - s) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of several lines with the digests of their pairs of lines; pairs over a boundary, without."""
    from xxhash import xxh3_128_digest

    kind = pa.list_(pa.struct([("p1", pa.int64()), ("p2", pa.int64())]))
    for b in batches:
        out: list[tuple] = []
        digests: list[bytes] = []
        sizes: list[int | None] = []
        inner: list[bytes] = []
        for doc, h, text in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            rows = lines(text)
            if len(rows) < MIN_LINES:
                continue
            pairs = [xxh3_128_digest(b"\n".join(rows[k : k + 2])) for k in range(len(rows) - 1)]
            for start, n in chunks(rows):
                end = start + n
                if n >= MIN_LINES:
                    out.append((doc, h, start, n))
                    digests.append(pairs[start] if n == 2 else xxh3_128_digest(b"\n".join(rows[start:end])))
                    inner += pairs[start : end - 1]
                    sizes.append(n - 1)
                if end < len(rows) and (rows[end - 1].strip() or rows[end].strip()):
                    out.append((doc, h, end - 1, 2))
                    digests.append(pairs[end - 1])
                    sizes.append(None)
        cols = list(zip(*out, strict=True)) or [()] * 4
        keys, of_pairs = (np.frombuffer(b"".join(x), "<i8").reshape(-1, 2) for x in (digests, inner))
        offsets = pa.array([*(None if n is None else e - n for n, e in zip(sizes, np.cumsum([n or 0 for n in sizes]).tolist(), strict=True)), len(inner)], pa.int32())
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(of_pairs[:, k].copy()) for k in (0, 1)], fields=list(kind.value_type)))
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(keys[:, k].copy()) for k in (0, 1)), listed], ["doc_id", "h", "start", "n", "c1", "c2", "pairs"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for doc, h, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
            rows = lines(text or b"")
            out += [(doc, h, s["start"], s["n"], b"\n".join(rows[s["start"] : s["start"] + s["n"]])) for s in spans]
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "h", "start", "n", "body"])


def repeated_chunks(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, h, start, n) of the chunks and pairs of lines that are not the first of their bytes."""
    found = work.write(arrow_map(keyed(docs), _digests, ROW), "chunks")
    none = F.col("doc_id").isNull().alias("none")
    whole = found.where("pairs is not null")
    firsts = whole.groupBy("c1", "c2").agg(F.count("*").alias("k"), F.min(F.struct(none, "doc_id", "start", "h", "pairs")).alias("f"))
    firsts = work.write(firsts, "firsts")
    inner = firsts.select("f.doc_id", "f.h", "f.start", F.posexplode("f.pairs").alias("at", "p")).select("doc_id", "h", (F.col("start") + F.col("at")).alias("start"), F.col("p.p1").alias("c1"), F.col("p.p2").alias("c2"))
    pairs = work.write(inner.unionByName(found.where("pairs is null").select("doc_id", "h", "start", "c1", "c2")), "pairs")
    several = work.write(pairs.groupBy("c1", "c2").agg(F.count("*").alias("k")).where("k > 1").select("c1", "c2"), "several")
    again = pairs.join(several, ["c1", "c2"]).select("doc_id", "h", "start", F.lit(MIN_LINES).alias("n"))
    copies = whole.select("doc_id", "h", "start", "n", "c1", "c2").join(firsts.where("k > 1").select("c1", "c2"), ["c1", "c2"]).select("doc_id", "h", "start", "n")
    candidates = work.write(copies.unionByName(again).distinct(), "candidates")
    bodies = work.write(arrow_map(joined(docs, candidates, "inner").select("doc_id", "h", "text", "spans"), _bodies, "doc_id long, h long, start int, n int, body binary"), "bodies")
    place = F.struct(none, "doc_id", "start", "h")
    first = work.write(bodies.groupBy("body").agg(F.min(place).alias("first")), "first")
    late = bodies.join(first, "body").where(place != F.col("first"))
    return work.write(late.select("doc_id", "h", "start", "n").distinct(), "late")


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row: lines, lines removed, those kept, joined by line feeds.

    Null and empty texts have no lines and give an empty text. Rows equal in id and text are one document: a chunk is
    first in both or in none. No rows: no rows. Chunks of white space only stay. Extra columns are ignored.
    """
    work = Workspace(docs.sparkSession, "lines")
    rows = docs.select("doc_id", "text")
    cut = cut_out(rows, repeated_chunks(rows, work), lines, b"\n", False)
    return cut.select(F.col("_rest.doc_id").cast("long").alias("doc_id"), F.col("n").alias("n_lines"), "n_removed", "text")


def stage(docs: DataFrame) -> DataFrame:
    """docs with those lines removed, all columns kept; every row stays. Null and empty texts stay as they are. No rows: no rows."""
    spans = repeated_chunks(docs.select("doc_id", "text"), Workspace(docs.sparkSession, "lines"))
    return with_text(cut_out(docs, spans, lines, b"\n", True), docs.columns)

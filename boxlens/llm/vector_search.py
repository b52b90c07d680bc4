"""Approximate nearest neighbours by collision counting over single-projection sorted arrays (C2LSH, QALSH).

Vectors are dealt to cells: those of about the same length (a factor of two) that are nearest, by angle, to the same pivot. A
cell's vectors, in blocks, have PROJECTIONS random lines, each with their projections in order. A query's window on a line is
centred on its own projection; virtual rehashing widens its windows until enough vectors have collided with it on
enough lines. They are verified by their inner products. The k-th best of these then says how wide windows must be for a
vector that is no worse to collide often enough with probability RELIABLE; what these windows add is verified too.

For largest inner products, vectors get one more component that makes them as long as the block's longest, and the query
is brought to that length: the nearest is then the one with the largest product. A query first meets the cell whose
pivot it is nearest, then, with what it found there, those cells that the angle to the pivot and the lengths do not rule out.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map
from boxlens.llm.embedding_join import far_apart, unit, usable

PROJECTIONS, SEED = 128, 5
#: A vector is a candidate once it collides on this share of the lines; windows reach what is no worse than the k-th best found with this probability.
COLLISIONS, RELIABLE = 0.77, 0.75
#: The first window's half width, as a share of the vectors' length, the factor of each rehashing, and how many candidates, in k, the first widening wants.
FIRST_WIDTH, FACTOR, WANTED = 0.5, 1.15, 2
#: Bytes of a block's vectors, and of the queries that meet it in one task, for which its sorted arrays are made once; queries treated at once; a line's windows end at one of PLACES places of its sorted array.
BLOCK_BYTES, QUERY_BYTES, CHUNK, PLACES, K = 8 << 20, 16 << 20, 256, 256, 20
#: Rows a cell aims at, and the most pivots, which the driver holds; they are chosen among SAMPLE vectors for each.
CELL_ROWS, LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 8192, 4, 1024, 4


@lru_cache(8)
def window_factor(lines: int, needed: int, reliable: float) -> float:
    """Half width, as a share of the distance, at which that many lines collide with that probability."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if sum(comb(lines, j) * p**j * (1 - p) ** (lines - j) for j in range(needed, lines + 1)) >= reliable:
            high = p
        else:
            low = p
    return NormalDist().inv_cdf((1 + high) / 2)


class _Counter:
    """Counts of many bits at once: plane p holds bit p of every count. Three words of a plane become one of it and one of the next."""

    def __init__(self):
        self.planes: list[np.ndarray] = []
        self.waiting: list[np.ndarray | None] = []

    def add(self, v: np.ndarray, p: int = 0) -> None:
        if p == len(self.planes):
            self.planes.append(v)
            self.waiting.append(None)
        elif self.waiting[p] is None:
            self.waiting[p] = v
        else:
            a, b = self.planes[p], self.waiting[p]
            half = a ^ b
            carry = (a & b) | (half & v)
            self.planes[p], self.waiting[p] = half ^ v, None
            self.add(carry, p + 1)

    def at_least(self, n: int) -> np.ndarray:
        """Bits of the counts of n or more."""
        for p in range(64):  # what waits goes in; carries may add planes
            if p < len(self.planes) and self.waiting[p] is not None:
                a, b = self.planes[p], self.waiting[p]
                self.planes[p], self.waiting[p] = a ^ b, None
                carry = a & b
                if p + 1 == len(self.planes) or self.waiting[p + 1] is None:
                    self.add(carry, p + 1)
                else:
                    c, d = self.planes[p + 1], self.waiting[p + 1]
                    half = c ^ d
                    self.planes[p + 1], self.waiting[p + 1] = half ^ carry, None
                    self.add((c & d) | (half & carry), p + 2)
        more, same = np.zeros_like(self.planes[0]), ~np.zeros_like(self.planes[0])
        if n >> len(self.planes):
            return more
        for p in reversed(range(len(self.planes))):
            if n >> p & 1:
                same = same & self.planes[p]
            else:
                more = more | (same & self.planes[p])
                same = same & ~self.planes[p]
        return more | same


class CollisionIndex:
    """Sorted arrays of one block. vectors: (n, d) doubles, of lengths that are not far apart. The vectors up to each of PLACES places of an array are also kept as a set of bits, so a window is the difference of two sets, and collisions on all lines are counted for 64 vectors in a word."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, n = vectors, len(vectors)
        self.scale = float(np.abs(vectors).max())  # so that no square overflows or vanishes
        scaled = vectors / self.scale
        square = (scaled**2).sum(axis=1)
        self.length = float(np.sqrt(square.max()))
        more = np.sqrt(np.maximum(self.length**2 - square, 0))[:, None]
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        shadows = np.c_[scaled, more] / self.length @ self.lines
        order = np.argsort(shadows, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(shadows.T, order, 1)
        self.step = -(-n // PLACES)
        parts, words = -(-n // self.step), -(-n // 64)
        self.upto = np.zeros((PROJECTIONS, parts + 1, words), np.uint64)
        part = np.arange(n) // self.step
        for j in range(PROJECTIONS):
            member = np.zeros((parts, words * 64), bool)
            member[part, order[j]] = True
            self.upto[j, 1:] = np.bitwise_or.accumulate(np.packbits(member, axis=1, bitorder="little").view("<u8"), axis=0)

    def _collisions(self, centre: np.ndarray, width: np.ndarray | float) -> np.ndarray:
        """For each query (a column of centre) the set of vectors that lie within width on enough lines."""
        counter = _Counter()
        for sorted_, upto, c in zip(self.sorted, self.upto, centre, strict=True):
            low = np.searchsorted(sorted_, c - width, "left") // self.step
            high = -(-np.searchsorted(sorted_, c + width, "right") // self.step)
            counter.add(upto[high] ^ upto[np.minimum(low, high)])
        return counter.at_least(int(np.ceil(COLLISIONS * PROJECTIONS)))

    def directions(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centres of the queries' windows, and their lengths as (largest component, length over it)."""
        most = np.abs(queries).max(axis=1, keepdims=True)
        x = queries / most
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return (np.c_[x / size, np.zeros(len(x))] @ self.lines).T, np.c_[most, size]

    def widths(self, products: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Windows that a vector with such a product falls into on enough lines, with probability RELIABLE."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            cosine = products / self.scale / self.length / sizes[:, 0] / sizes[:, 1]
        cosine = np.clip(np.where(np.isnan(cosine), -1, cosine), -1, 1)
        return window_factor(PROJECTIONS, int(np.ceil(COLLISIONS * PROJECTIONS)), RELIABLE) * np.sqrt(2 - 2 * cosine) + 1e-9

    def enough(self, centre: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Rows found by widening each query's windows until that many, or all, collide often enough."""
        n, out = len(self.vectors), [np.zeros(0, np.int64)] * centre.shape[1]
        open_, width = np.arange(centre.shape[1]), FIRST_WIDTH
        while open_.size:
            hit = self._collisions(centre[:, open_], width)
            done = np.bitwise_count(hit).sum(axis=1, dtype=np.int64) >= min(n, wanted)
            for q, bits in zip(open_[done], hit[done], strict=True):
                out[q] = _rows(bits)
            open_, width = open_[~done], width * FACTOR
        return out

    def within(self, centre: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
        return [_rows(bits) for bits in self._collisions(centre, width)]


def _rows(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; an overflow is infinite, and minus infinity where it has no sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = (rows * query).sum(axis=1)
    return np.where(np.isnan(score), -np.inf, score)


def _best(rows: np.ndarray, own: np.ndarray, found: np.ndarray, query: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the rows found, ties to the smaller id, and their products, none below floor."""
    near = rows[found]
    if len(found) > k:  # the last kept and all that rounding could put before it
        with np.errstate(over="ignore", invalid="ignore"):
            rough = near @ query
        if np.isfinite(rough).all():
            kept = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - 1e-9 * np.abs(rough).max())
            found, near = found[kept], near[kept]
    score = products(near, query)
    good = score >= floor
    best = np.lexsort((own[found[good]], -score[good]))[:k]
    return found[good][best], score[good][best]


def search(rows: np.ndarray, own: np.ndarray, queries: np.ndarray, asked: np.ndarray, floors: np.ndarray, k: int):
    """For each query: rows found, best first, their products, and how many were verified. floors: a product below which rows do not matter, minus infinity if none is known."""
    index = CollisionIndex(rows)
    for at in range(0, len(queries), CHUNK):
        part = slice(at, at + CHUNK)
        x, me, least = queries[part], asked[part], floors[part]
        centre, sizes = index.directions(x)
        floor, seen = least.copy(), [np.zeros(0, np.int64)] * len(x)
        fresh = np.flatnonzero(np.isneginf(floor))
        for q, found in zip(fresh, index.enough(centre[:, fresh], WANTED * k + 1), strict=True):
            seen[q] = found
            score = _best(rows, own, found[own[found] != me[q]], x[q], -np.inf, k)[1]
            if len(score) == k:
                floor[q] = score[-1]
        for q, found in enumerate(index.within(centre, index.widths(floor, sizes))):
            found = np.union1d(found, seen[q]) if len(seen[q]) else found
            found = found[own[found] != me[q]]
            yield *_best(rows, own, found, x[q], least[q], k), len(found)


# --- cells ----------------------------------------------------------------------------------------------


def _places(pivots: dict[int, np.ndarray]):
    """(vec_id, embedding, dim, band, cell, log_length, cosine): where each vector belongs; its length is 2^log_length, its angle to the pivot has that cosine."""

    def run(batches):
        for b in batches:
            dims = np.array([len(x) for x in b.column(1)])
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                x, p = _vectors(part.column(1)), pivots.get(int(dim))
                most = np.abs(x).max(axis=1)
                log_length = np.log2(most) + np.log2(((x / most[:, None]) ** 2).sum(axis=1)) / 2
                near, cosine = np.zeros(len(x), np.int32), np.full(len(x), -1.0)
                if p is not None:
                    u = unit(x.ravel(), int(dim))
                    for s in range(0, len(u), CHUNK):
                        to = u[s : s + CHUNK] @ p.T
                        near[s : s + CHUNK], cosine[s : s + CHUNK] = to.argmax(axis=1), to.max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(x), dim, np.int32)), pa.array(np.floor(log_length).astype(np.int32)), pa.array(near), pa.array(log_length), pa.array(cosine)], ["vec_id", "embedding", "dim", "band", "cell", "log_length", "cosine"])

    return run


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(column[0]))


def promises(u: np.ndarray, log_length: np.ndarray, pivots: np.ndarray | None, cells: list) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the largest product that each query could have in each cell (a cosine that is not positive counts as next to none); and of its product with a vector at the pivot."""
    out, at_pivot = np.empty((2, len(u), len(cells)))
    for j, c in enumerate(cells):
        to = np.ones(len(u)) if pivots is None else np.clip(u @ pivots[c["cell"]], -1, 1)
        cosine = np.cos(np.maximum(np.arccos(to) - np.arccos(np.clip(c["cosine"], -1, 1)), 0))
        length = log_length + c["log_length"] + 1e-9
        out[:, j], at_pivot[:, j] = length + np.log2(np.maximum(cosine, 1e-12)), length + np.log2(np.maximum(to, 1e-12))
    return out, at_pivot


def _visits(pivots: dict[int, np.ndarray], cells: dict[int, list], k: int, first: bool):
    """(vec_id, embedding, dim, band, cell, floor): the cells that a query is to meet: first the one of 2 k rows or more (or of the most) whose pivot tells most of it; then all others that promise no less than its floor."""

    def run(batches):
        for b in batches:
            dims = np.array([len(x) for x in b.column(1)])
            for dim in np.unique(dims):
                here = cells.get(int(dim), [])
                if not here:
                    continue
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                for s in range(0, part.num_rows, CHUNK):
                    some = part.slice(s, CHUNK)
                    x = _vectors(some.column(1))
                    most = np.abs(x).max(axis=1)
                    log_length = np.log2(most) + np.log2(((x / most[:, None]) ** 2).sum(axis=1)) / 2
                    promise, guess = promises(unit(x.ravel(), int(dim)), log_length, pivots.get(int(dim)), here)
                    enough = np.array([c["n"] >= 2 * k for c in here])
                    if not enough.any():
                        enough[np.argmax([c["n"] for c in here])] = True
                    home = np.where(enough[None, :], guess, -np.inf).argmax(axis=1)
                    goes = np.zeros(promise.shape, bool)
                    goes[np.arange(len(x)), home] = True
                    floor = np.full(len(x), -np.inf)
                    if not first:
                        floor = some.column(2).to_numpy(zero_copy_only=False)
                        with np.errstate(divide="ignore", invalid="ignore"):
                            log_floor = np.where(floor > 0, np.log2(np.maximum(floor, 0)), -np.inf)
                        goes = ~goes & (promise >= log_floor[:, None])
                    q, c = np.nonzero(goes)
                    rows = some.take(pa.array(q))
                    bands, numbers = (np.array([x[n] for x in here], np.int32) for n in ("band", "cell"))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(q), dim, np.int32)), pa.array(bands[c]), pa.array(numbers[c]), pa.array(floor[q])], ["vec_id", "embedding", "dim", "band", "cell", "floor"])

    return run


def _search(k: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        x, ids, floors = _vectors(t.column("embedding")), t.column("vec_id").to_numpy(), t.column("floor").to_numpy()
        asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        if not asks.any() or asks.all():
            return pa.table([[], [], [], []], schema=out)
        own, asked = ids[~asks], ids[asks]
        got: list[list] = [[], [], [], []]
        for q, (found, score, verified) in enumerate(search(x[~asks], own, x[asks], asked, floors[asks], k)):
            # the number verified comes in a row of its own
            for held, values in zip(got, ([asked[q]] * (len(found) + 1), [None, *own[found].tolist()], [None, *score.tolist()], [verified, *[None] * len(found)]), strict=True):
                held += values
        return pa.table([pa.array(c, f.type) for c, f in zip(got, out, strict=True)], schema=out)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k rows of vectors found with the largest inner product, ties to the smaller id, never its own id.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; nor do
    vectors meet of different lengths. Repeated rows count once each, as candidates; as queries, once. Products that
    overflow are infinite, and minus infinity where they have no sign. Fewer candidates: all. No rows: no rows.
    """
    return ranked(written_hits(vectors, queries, k), k)


def written_hits(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, vec_id, score, verified): what each query found in each block; and, in rows without vec_id, how many vectors it verified there."""
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "search")
    clean = lambda df: df.selectExpr("cast(vec_id as bigint) vec_id", "embedding").where("vec_id is not null").where(usable())
    kind = dict(vectors.dtypes)["embedding"]
    asked = work.write(clean(queries).dropDuplicates(["vec_id", "embedding"]), "asked")
    n = clean(vectors).count()
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, -(-n // CELL_ROWS)))
    by_dim: dict[int, list] = {}
    for r in clean(vectors).orderBy(F.xxhash64("embedding"), "vec_id").limit(SAMPLE * wanted).select("embedding").collect():
        by_dim.setdefault(len(r[0]), []).append(r[0])
    pivots = {d: far_apart(unit(np.array(v, np.float64).ravel(), d), wanted) for d, v in by_dim.items()}
    rows = work.write(arrow_map(clean(vectors), _places(pivots), f"vec_id long, embedding {kind}, dim int, band int, cell int, log_length double, cosine double"), "rows")
    key = ["dim", "band", "cell"]
    # one row a pivot and factor of two of the lengths
    sizes = work.write(rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("log_length").alias("log_length"), F.min("cosine").alias("cosine")), "cells")
    cells: dict[int, list] = {}
    for r in sizes.orderBy(*key).collect():
        cells.setdefault(r["dim"], []).append(r.asDict())
    visit = f"vec_id long, embedding {kind}, dim int, band int, cell int, floor double"

    def met(asking: DataFrame, first: bool, name: str) -> DataFrame:
        visits = work.write(arrow_map(asking, _visits(pivots, cells, k, first), visit), f"{name}-visits")
        shape = sizes.join(visits.groupBy(*key).agg(F.ceil(F.count("*") * 8 * F.first("dim") / QUERY_BYTES).cast("int").alias("groups")), key)
        shape = shape.select(*key, F.ceil(F.col("n") * 8 * F.col("dim") / BLOCK_BYTES).cast("int").alias("blocks"), "groups")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        dealt = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
        held = rows.join(shape, key).withColumn("block", dealt("blocks")).select(*key, "block", each("groups").alias("group"), F.lit(False).alias("asks"), "vec_id", "embedding", F.lit(0.0).alias("floor"))
        ask = visits.join(shape, key).withColumn("group", dealt("groups")).select(*key, each("blocks").alias("block"), "group", F.lit(True).alias("asks"), "vec_id", "embedding", "floor")
        found = held.unionByName(ask).groupBy(*key, "block", "group").applyInArrow(_search(k), "query_id long, vec_id long, score double, verified long")
        return work.write(found, name)

    home = met(asked, True, "home")
    floors = ranked(home, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = asked.join(floors, "vec_id", "left").select("vec_id", "embedding", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return home.unionByName(met(rest, False, "rest"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

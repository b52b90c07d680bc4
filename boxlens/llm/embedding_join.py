"""Near-duplicate vectors by an exact metric range join.

Unit vectors at cosine c lie sqrt(2 - 2c) apart. Pivots, chosen far from each other in a bounded sample, split the space
into cells of the nearest pivot. For x in the cell of p, a vector within r of x can lie in, or be, the cell of q only if
(|xq|^2 - |xp|^2) / 2|pq| <= r, the distance from x to the plane halfway between (the triangle inequality's bound, in its
sharper form for vectors). Such cells get a copy of x. Each cell joins its own rows with its own rows and the copies, in
blocks, apart from others.

Within a cell a second bound comes before the whole product. On the few directions that the pivots spread most, x and y have
shadows Bx and By; what is left of them is no longer than the lengths tell: x.y <= Bx.By + |x - Bx| |y - By|.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map
from boxlens.llm.components import connected_components

#: The fewest and the most pivots, which the driver holds, one for CELL_ROWS vectors at most; they are chosen among SAMPLE
#: vectors for each. How many are used, PROBED vectors of the sample tell: what a copy and a pair compared cost, in
#: nanoseconds, and how many of both there would be. Larger cells are joined in blocks of BLOCK_BYTES.
CELL_ROWS, LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, PROBED, COPY_COST, PAIR_COST, BLOCK_BYTES, CHUNK = 32, 16, 4096, 4, 1024, 5000.0, 5.0, 16 << 20, 256
#: Directions of the bound in a cell, and the share of pairs it may leave before whole products of all are cheaper.
SHADOW, DENSE = 16, 0.02
#: Pairs held at once in a block, and how far single precision may be off.
MOST_PAIRS, SLACK = 4_000_000, 1e-4


def usable(column: str = "embedding"):
    """Not null or zero, no null and no non-finite components."""
    return F.expr(f"{column} is not null and not exists({column}, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists({column}, x -> x <> 0)")


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.astype(np.float64).reshape(-1, dim)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy(zero_copy_only=False), len(column[0]))


def far_apart(sample: np.ndarray, wanted: int) -> np.ndarray:
    """That many of the unit vectors at most, each the furthest from those before it; none twice."""
    picked, nearest = [0], sample @ sample[0]
    while len(picked) < min(wanted, len(sample)):
        k = int(nearest.argmin())
        if nearest[k] > 1 - 1e-9:
            break
        picked.append(k)
        np.maximum(nearest, sample @ sample[k], out=nearest)
    return sample[picked]


def reached(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector its nearest pivot, and the cells that a vector within radius of it can be in."""
    square = 2 - 2 * (x @ p.T)
    near = square.argmin(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (p[near] @ p.T), 1e-12))
    reach = (square - square[np.arange(len(x)), near][:, None]) / (2 * apart) <= radius + 1e-6
    reach[np.arange(len(x)), near] = True
    return near, reach


def expected(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[float, float]:
    """Copies a vector, its own row included, and the share of all pairs that meet in a cell, as x tells."""
    near, reach = reached(x, p, radius)
    return float(reach.sum() / len(x)), float((np.bincount(near, minlength=len(p)) * reach.sum(axis=0)).sum() / len(x) ** 2)


def cheapest(sample: np.ndarray, n: int, radius: float) -> np.ndarray:
    """The pivots, LEAST_PIVOTS or a doubling of them, with the least expected cost for n vectors."""
    order = far_apart(sample, max(LEAST_PIVOTS, min(MOST_PIVOTS, n // CELL_ROWS)))
    best, cost, m = order, np.inf, LEAST_PIVOTS
    while True:
        copies, share = expected(sample[:PROBED], order[:m], radius)
        now = n * copies * COPY_COST + n * n * share * PAIR_COST
        if now < cost:
            best, cost = order[:m], now
        if m >= len(order):
            return best
        m *= 2


def choose_pivots(vectors: DataFrame, n: int, radius: float) -> dict[int, np.ndarray]:
    """Of each dimension, from a bounded number of vectors, those with the least hashes."""
    by_dim: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE * max(LEAST_PIVOTS * 16, min(MOST_PIVOTS, n // CELL_ROWS))).select("embedding").collect():
        by_dim.setdefault(len(r[0]), []).append(r[0])
    return {d: cheapest(unit(np.array(v).ravel(), d), n, radius) for d, v in by_dim.items()}


def _cells(pivots: dict[int, np.ndarray], radius: float):
    """(cell, home, rep, copies, embedding): one home row and its boundary copies. Dimensions never meet: a cell is dim * MOST_PIVOTS + pivot."""

    def part_of(part: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        p = pivots.get(dim)
        if p is None:  # no vector of that length is in the sample
            rows, cells, home = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), np.ones(part.num_rows, bool)
        else:
            near, reach = reached(_matrix(part.column(2)), p, radius)
            rows, cells = np.nonzero(reach)
            home = cells == near[rows]
        out = part.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(cells + dim * MOST_PIVOTS), pa.array(home), out.column(0), out.column(1), out.column(2)], ["cell", "home", "rep", "copies", "embedding"])

    def run(batches):
        for b in batches:
            dims = np.array([len(x) for x in b.column(2)])
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, part.num_rows, CHUNK):
                    yield part_of(part.slice(at, CHUNK), int(dim))

    return run


def shadow_basis(pivots: np.ndarray | None) -> np.ndarray | None:
    """(dim, SHADOW) orthonormal directions along which the pivots spread most; none for short vectors."""
    if pivots is None or pivots.shape[1] < 2 * SHADOW:
        return None
    return np.linalg.svd(pivots, full_matrices=True)[2][:SHADOW].T


def shadows(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray | None:
    """Rows whose products are no less than those of x."""
    if basis is None:
        return None
    low = x @ basis
    return np.c_[low, np.sqrt(np.maximum(1 - (low * low).sum(axis=1), 0))].astype(np.float32)


def _exact(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products in double precision, in parts."""
    return np.concatenate([np.zeros(0), *((x[left[s : s + CHUNK * CHUNK]] * x[right[s : s + CHUNK * CHUNK]]).sum(axis=1) for s in range(0, len(left), CHUNK * CHUNK))])


def _pairs(x: np.ndarray, single: np.ndarray, shadow: np.ndarray | None, rows: np.ndarray, others: np.ndarray, threshold: float):
    """(i, j) of rows[i] and others[j] that link, by i, in parts of MOST_PAIRS or one row. What the shadows leave is multiplied in double precision; if they leave much, all is in single precision and what comes near the threshold again in double."""
    found = close = None
    if shadow is not None:
        found = shadow[rows] @ shadow[others].T >= np.float32(threshold - SLACK)
    if found is None or found.mean() > DENSE:
        close = single[rows] @ single[others].T
        found = close >= np.float32(threshold - SLACK)
    number = found.sum(axis=1)
    at = 0
    while at < len(rows):
        end, held = at + 1, number[at]
        while end < len(rows) and held + number[end] <= MOST_PAIRS:
            held += number[end]
            end += 1
        i, j = np.nonzero(found[at:end])
        i += at
        unsure = np.arange(len(i)) if close is None else np.flatnonzero(close[i, j] < threshold + SLACK)
        low = unsure[_exact(x, rows[i[unsure]], others[j[unsure]]) < threshold]
        yield np.delete(i, low), np.delete(j, low)
        at = end


def _join_block(threshold: float, bases: dict[int, np.ndarray | None]):
    out = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        """Rows with links: what a home row links with here. Rows with other: links that connect what the block's pairs connect."""
        x = _matrix(t.column("embedding"))
        single, shadow = x.astype(np.float32), shadows(x, bases.get(x.shape[1]))
        ids, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        asks, answers = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "answers"))
        q, c = np.flatnonzero(asks), np.flatnonzero(answers)
        label, rep, other, total = np.arange(len(x)), [], [], np.zeros(len(q))
        for at in range(0, len(q), CHUNK):
            rows = q[at : at + CHUNK]
            for i, j in _pairs(x, single, shadow, rows, c, threshold):
                total[at : at + len(rows)] += np.bincount(i, copies[c[j]], len(rows))
                edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else []
                for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                    own, near = rows[i[lo]], c[j[lo:hi]]
                    got, mine = label[near], label[own]
                    if (got == mine).all():
                        continue
                    seen, first = np.unique(got, return_index=True)
                    links = near[first[seen != mine]]
                    rep += [int(ids[own])] * len(links)
                    other += ids[links].tolist()
                    label[np.isin(label, np.r_[seen, mine])] = min(mine, seen[0])
        some = np.flatnonzero(total)
        none = [None] * len(some)
        return pa.table([pa.array([*ids[q[some]].tolist(), *rep], pa.int64()), pa.array([*none, *other], pa.int64()), pa.array([*total[some].astype(np.int64).tolist(), *[None] * len(rep)], pa.int64())], schema=out)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. Cosine in double precision of threshold or more links.

    Equal vectors count once in the join and as many as they are in n_links. Vectors that are null, zero or hold
    null or non-finite components link with nothing, as do those of different lengths with each other, and rows
    with a null id (component null, kept). No rows: no rows. Extra columns are ignored.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "vectors")
    rows = vectors.selectExpr("cast(vec_id as bigint) vec_id", "embedding").withColumn("_ok", F.col("vec_id").isNotNull() & usable())
    classes = work.write(rows.where("_ok").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "embedding"), "classes")
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    pivots = choose_pivots(classes, classes.count(), radius)
    bases = {d: shadow_basis(p) for d, p in pivots.items()}
    cells = work.write(arrow_map(classes, _cells(pivots, radius), "cell long, home boolean, rep long, copies long, embedding " + dict(vectors.dtypes)["embedding"]), "cells")
    # blocks of a cell: as many as its rows need; counts are one row a pivot and dimension
    counts = cells.groupBy("cell").agg(F.ceil(F.count("*") * 8 * F.expr(f"cell div {MOST_PIVOTS}") / BLOCK_BYTES).cast("int").alias("blocks"))
    blocked = cells.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    answers = blocked.select("cell", F.explode(each).alias("asker"), F.col("block").alias("answerer"), (F.col("home") & (F.col("asker") == F.col("answerer"))).alias("asks"), F.lit(True).alias("answers"), "rep", "copies", "embedding")
    asks = blocked.where("home").select("cell", F.col("block").alias("asker"), F.explode(each).alias("answerer"), F.lit(True).alias("asks"), F.lit(False).alias("answers"), "rep", "copies", "embedding").where("asker <> answerer")
    found = answers.unionByName(asks).groupBy("cell", "asker", "answerer").applyInArrow(_join_block(threshold, bases), "rep long, other long, links long")
    found = work.write(found, "found")
    counted = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(work, found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = work.write(classes.select("rep", "embedding").join(counted, "rep").join(roots, F.col("rep") == F.col("node"), "left").select("embedding", F.col("links").alias("_links"), F.coalesce("root", "rep").alias("_component")), "of_class")
    joined = rows.where("_ok").join(of_class, "embedding").select("vec_id", (F.col("_links") - 1).alias("n_links"), F.col("_component").alias("component_id"))
    alone = rows.where("not _ok or _ok is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

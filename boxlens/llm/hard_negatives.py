"""Hard negatives by a Voronoi-partition distributed nearest-neighbour join.

Every vector v gets one more component, sqrt(M^2 - |v|^2) with M the largest length, and every anchor a gets 0 there. Then
|a - v|^2 = M^2 + |a|^2 - 2 a.v: the largest product is the nearest vector, and limits on a score are limits on a distance.
Pivots split the augmented vectors into cells of the nearest pivot; anchors are grouped by it too. An anchor that looks for
scores from low to high needs of the cell of p only vectors v with

    r(low) >= |a - p| - |v - p|,  r(low) >= |v - p| - |a - p|  and  r(high) <= |a - p| + |v - p|

(r: the distance of a score), and none where the plane halfway between p and its own pivot is further than r(low). The rings of
a group's anchors are put together, one ring a group and cell; candidates are copied to the groups whose ring they lie in, and
each group joins its anchors with its candidates, in blocks, apart from others.

A search has two passes. The first looks into the anchors' own cells only, to learn how good the k-th best is at least; the
second is over the rings that this leaves, and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map

SCALE, CLASSES, RELABELLED, ANCHORS, POSITIVES, NEGATIVES = 256, 10, 7, 100, 5, 10
#: The fewest and the most groups of anchors of one length. Pivots are means of a sample of SAMPLE vectors, and of SAMPLED components, at most; TURNS rounds move them.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, SAMPLED, TURNS = 2, 32, 4096, 1 << 20, 5
#: How many groups there are, PROBES of the sample tell, and what a copy and a product cost, in nanoseconds.
PROBES, COPY_COST, PAIR_COST = 128, 15000.0, 20.0
#: A task joins that many anchors with that many bytes of candidates at most; products of CHUNK anchors are held at once. Anchors of one class are expanded in SHARES parts.
SLOT, BLOCK_BYTES, CHUNK, SHARES = 16384, 8 << 20, 64, 4
#: Rounding of distances as a share of M, products below it are exact in double precision, and the ends of 64 bits.
SLACK, EXACT, MOST = 1e-6, float(1 << 53), (1 << 63) - 1


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, equal ones once, labels as the contract moves them."""
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    moved = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label").cast("long") + 1) % CLASSES).otherwise(F.col("label").cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), "embedding").distinct()


def whole(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of those rows, which are of one length."""
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(len(rows), -1)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)


class Cells:
    """Pivots of each length that the sample holds, in the augmented space; largest: M. Other lengths share cell -1, which no bound rules out."""

    def __init__(self, pivots: dict[int, np.ndarray], largest: float):
        self.pivots, self.largest, self.first, n = pivots, largest, {}, 0
        for dim, p in sorted(pivots.items()):
            self.first[dim] = n
            n += len(p)

    def augmented(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v, np.sqrt(np.maximum(self.largest**2 - (v * v).sum(axis=1), 0))]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of augmented vectors to the pivots of their length."""
        p = self.pivots[x.shape[1] - 1]
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p * p).sum(axis=1), 0))


def _means(cells: Cells, dim: int, x: np.ndarray, wanted: int) -> np.ndarray:
    """That many pivots at most: means of the vectors that are nearest to each, moved TURNS times."""
    p = np.unique(x, axis=0)
    p = p[np.linspace(0, len(p) - 1, min(wanted, len(p))).astype(int)]
    for _ in range(TURNS):
        cells.pivots[dim] = p
        near = cells.distances(x).argmin(axis=1)
        p = np.array([x[near == k].mean(axis=0) for k in range(len(p)) if (near == k).any()])
    return p


def _copies(cells: Cells, dim: int, v: np.ndarray, probes: int) -> float:
    """How many groups a vector goes to, as the sample tells: its first probes are anchors that look for their POSITIVES nearest in it."""
    p, a = cells.pivots[dim], np.c_[v[:probes], np.zeros(min(probes, len(v)))]
    x = cells.augmented(v)
    far = cells.distances(a)
    reach = np.sqrt(np.sort(np.maximum((x * x).sum(axis=1) - 2 * (a @ x.T) + (a * a).sum(axis=1)[:, None], 0), axis=1)[:, min(POSITIVES, len(v) - 1)])
    group, own = far.argmin(axis=1), cells.distances(x)
    cell = own.argmin(axis=1)
    dist = own[np.arange(len(x)), cell]
    needed = np.abs(far[:, cell] - dist) <= reach[:, None]
    return sum(float(needed[group == g].any(axis=0).mean()) for g in np.unique(group)) * len(p) / max(1, len(np.unique(group)))


def choose(rows: DataFrame, largest: float, anchors: int, n: int, longest: int) -> Cells:
    """Pivots of each length that the sample holds: LEAST_PIVOTS or a doubling of them, the cheapest by the copies and products that the sample makes expect. Where no bound rules anything out, the fewest."""
    size = max(MOST_PIVOTS, min(SAMPLE, SAMPLED // max(1, longest)))
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("embedding"), "embedding").limit(size).select("embedding").collect():
        by_dim.setdefault(len(r[0]), []).append(r[0])
    cells = Cells({}, largest)
    for dim, found in by_dim.items():
        v = np.floor(np.array(found, np.float64).reshape(len(found), dim) * SCALE)
        x, best, least, wanted = cells.augmented(v), None, np.inf, LEAST_PIVOTS
        while wanted <= MOST_PIVOTS:
            p = cells.pivots[dim] = _means(cells, dim, x, wanted)
            copies = _copies(cells, dim, v, PROBES)
            cost = n * copies * COPY_COST + n * anchors * copies / len(p) * PAIR_COST
            if cost < least:
                best, least = p, cost
            if len(p) < wanted:
                break
            wanted *= 2
        cells.pivots[dim] = best
    return Cells(cells.pivots, largest)


def placed(rows: DataFrame, cells: Cells, anchors: bool) -> DataFrame:
    """rows with cell, that of the nearest pivot, and dist from it. rows end with embedding; anchors are augmented by 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            dims, cell, dist = _lengths(column), np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
            for dim in np.unique(dims):
                if dim in cells.pivots:
                    at = np.flatnonzero(dims == dim)
                    v = whole(column, at)
                    d = cells.distances(np.c_[v, np.zeros(len(v))] if anchors else cells.augmented(v))
                    cell[at], dist[at] = cells.first[dim] + d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], [*b.schema.names, "cell", "dist"])

    return arrow_map(rows, run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell long, dist double")


def rings(asks: DataFrame, cells: Cells) -> DataFrame:
    """(grp, cell, near, far): of each group of anchors and cell that some anchor of it needs, the distances from the cell's pivot between which needed vectors lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[float, float]] = {}
        for b in batches:
            column, group = b.column(3), b.column(0).to_numpy()
            low, high = ([min(x) if k == 1 else max(x) for x in b.column(k).to_pylist()] for k in (1, 2))
            dims = _lengths(column)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in cells.pivots:
                    found[-1, -1] = (0.0, np.inf)
                    continue
                v, p, begin = whole(column, at), cells.pivots[dim], cells.first[dim]
                d = cells.distances(np.c_[v, np.zeros(len(v))])
                slack = SLACK * (cells.largest + d.max(axis=1)) + 1e-9
                square = cells.largest**2 + (v * v).sum(axis=1)
                most = (np.sqrt(np.maximum(square - 2 * np.array(low, float)[at], 0)) + slack)[:, None]
                least = (np.sqrt(np.maximum(square - 2 * np.array(high, float)[at], 0)) - slack)[:, None]
                own = group[at] - begin
                apart = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(axis=2), 1e-12))[own]
                plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart)
                needed = (plane <= most) | (np.arange(len(p)) == own[:, None])
                near, far = np.maximum(np.maximum(d - most, least - d), 0), d + most
                for k, c in zip(*np.nonzero(needed & (near <= far)), strict=True):
                    key = (int(group[at[k]]), int(begin + c))
                    was = found.get(key, (np.inf, -np.inf))
                    found[key] = (min(was[0], near[k, c]), max(was[1], far[k, c]))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.float64()), pa.array([found[k][1] for k in keys], pa.float64())], ["grp", "cell", "near", "far"])

    each = arrow_map(asks.select("grp", "low", "high", "embedding"), run, "grp long, cell long, near double, far double")
    return each.groupBy("grp", "cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of whole numbers, exact; held within 64 bits."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(c).max(initial=0) < EXACT:
        return (a @ c.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    return np.clip((big(a) @ big(c).T), -MOST, MOST).astype(np.int64)


def _join_block(k: int, same: bool):
    out = pa.schema([("cls", pa.int64()), ("ask", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        """The first k of the block for each limit of each anchor."""
        t = t.combine_chunks()
        column, ids, labels = t.column("embedding").combine_chunks(), t.column("id").to_numpy(), t.column("label").to_numpy()
        lows, highs = t.column("low").to_pylist(), t.column("high").to_pylist()
        dims, asks = _lengths(column), np.array([x is not None for x in lows], bool)
        found: list[tuple] = []
        for dim in np.unique(dims[asks]):
            q, c = np.flatnonzero(asks & (dims == dim)), np.flatnonzero(~asks & (dims == dim))
            c = c[np.argsort(ids[c], kind="stable")]
            if not len(c):
                continue
            a, v = whole(column, q), whole(column, c)
            for s in range(0, len(q), CHUNK):
                for i, score in zip(q[s : s + CHUNK], products(a[s : s + CHUNK], v), strict=True):
                    at = np.flatnonzero(((labels[c] == labels[i]) == same) & (score >= min(lows[i])) & (score <= max(highs[i])))
                    at = at[np.argsort(-score[at], kind="stable")]
                    down = -score[at]
                    for n, (low, high) in enumerate(zip(lows[i], highs[i], strict=True)):
                        begin, end = np.searchsorted(down, -high, "left"), np.searchsorted(down, -low, "right")
                        best = at[begin : min(end, begin + k)]
                        found.append((np.full(len(best), ids[i]), np.full(len(best), n), ids[c[best]], score[best]))
        columns = [np.concatenate([np.zeros(0, np.int64), *(f[j] for f in found)]) for j in range(4)]
        return pa.table([pa.array(x, pa.int64()) for x in columns], schema=out)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each limit of each anchor; Spark keeps k of a task before it shuffles."""
    w = Window.partitionBy("cls", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)


def _visit(work: Workspace, name: str, asks: DataFrame, rows: DataFrame, ring: DataFrame, k: int, same: bool) -> DataFrame:
    """Candidates are copied to the groups whose ring they lie in; each group's anchors meet them in blocks."""
    ring = work.write(ring, f"{name}-ring")
    # pivots are bounded by the sample, so rings (pairs of pivots of one length) and counts of groups are too
    served = rows.join(F.broadcast(ring), "cell").where("dist >= near and dist <= far").select("grp", F.col("vec_id").alias("id"), "label", "embedding")
    blocks = served.groupBy("grp").agg(F.ceil(F.sum(F.size("embedding") * 8 + 16) / BLOCK_BYTES).cast("int").alias("blocks"))
    slots = asks.groupBy("grp").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    plan = F.broadcast(work.write(blocks.join(slots, "grp"), f"{name}-plan"))
    one_of = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("array<bigint>")
    candidates = served.join(plan, "grp").withColumn("block", one_of("blocks", "id", "embedding")).select("grp", each("slots").alias("slot"), "block", "id", "label", none.alias("low"), none.alias("high"), "embedding")
    anchors = asks.join(plan, "grp").withColumn("slot", one_of("slots", "cls")).select("grp", "slot", each("blocks").alias("block"), F.col("cls").alias("id"), "label", "low", "high", "embedding")
    met = candidates.unionByName(anchors).groupBy("grp", "slot", "block").applyInArrow(_join_block(k, same), "cls long, ask long, vec_id long, score long")
    return work.write(_first(met, k), name)


def search(work: Workspace, name: str, asks: DataFrame, rows: DataFrame, cells: Cells, k: int, same: bool) -> DataFrame:
    """(cls, ask, vec_id, score, _k): of each anchor class and each pair of limits the first k rows of its own label, or of other labels, whose score is within. asks: cls, grp, label, low, high, embedding."""
    own = asks.groupBy("grp").agg(F.first("grp").alias("cell"), F.lit(0.0).alias("near"), F.lit(float("inf")).alias("far"))
    looked = _visit(work, f"{name}-own", asks, rows, own, k, same)
    reached = looked.where(F.col("_k") == k).groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("_kth"))
    raised = F.transform("low", lambda x, n: F.greatest(x, F.coalesce(F.col("_kth")[n.cast("long")], x)))
    asks = work.write(asks.join(reached, "cls", "left").withColumn("low", raised).drop("_kth"), f"{name}-asks")
    return _visit(work, name, asks, rows, rings(asks, cells), k, same)


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `embeddings`' hard negatives; the module's constants say which rows are anchors and how many positives and negatives each has.

    Rows without id, label or vector, or with null or non-finite components, take no part; equal rows count once; rows of one
    id and different vectors are rows of their own, but not positives of one another. Vectors of different lengths never meet.
    Scores past 64 bits count as their ends. Positives without negatives, a negative score among them, give no rows. No
    rows: no rows. Extra columns are ignored.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "hard-negatives")
    rows = work.write(prepared(vectors), "rows")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (F.abs(x.cast("double")) * SCALE + 1) * (F.abs(x.cast("double")) * SCALE + 1))
    known = rows.agg(F.sqrt(F.max(squares)).alias("m"), F.max(F.size("embedding")).alias("dim"), F.sum((F.col("vec_id") % ANCHORS == 0).cast("long")).alias("anchors"), F.count("*").alias("n")).first()
    if not known["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # an anchor's own id can be among the first so many times
    again = rows.groupBy("vec_id", "label").count().agg(F.max("count")).first()[0]
    cells = choose(rows, known["m"], known["anchors"], known["n"], known["dim"])
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0)
    classes = anchors.select("label", "embedding").distinct().select(F.monotonically_increasing_id().alias("cls"), "label", "embedding")
    classes = work.write(placed(classes, cells, anchors=True).withColumnRenamed("cell", "grp"), "classes")
    # of rows with one label and vector no more than the first can be among anyone's best
    most = max(NEGATIVES, POSITIVES + again)
    turn = F.row_number().over(Window.partitionBy("label", "embedding").orderBy("vec_id"))
    candidates = rows.withColumn("_turn", turn).where(F.col("_turn") <= most).select("vec_id", "label", "embedding")
    candidates = work.write(placed(candidates, cells, anchors=False), "candidates")
    whole_range = [F.array(F.lit(x).cast("long")).alias(n) for n, x in (("low", -MOST), ("high", MOST))]
    asks = classes.select("cls", "grp", "label", *whole_range, "embedding")
    near = search(work, "positives", asks, candidates, cells, POSITIVES + again, same=True)
    positives = near.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("positives"))
    scores = F.array_distinct(F.transform(F.filter("positives", lambda p: p["down"] <= 0), lambda p: -p["down"]))
    tenths = lambda n, up: F.expr(f"transform(scores, s -> s div 10 * {n} + (s % 10 * {n} + {up}) div 10)")
    asked = classes.join(positives, "cls").withColumn("scores", scores).withColumn("low", tenths(3, 9)).withColumn("high", tenths(9, 0))
    asked = work.write(asked, "asked")
    limits = asked.where("size(scores) > 0").select("cls", "grp", "label", "low", "high", "embedding")
    far = search(work, "negatives", limits, candidates, cells, NEGATIVES, same=False)
    best = far.groupBy("cls", "ask").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("best"))
    of_class = best.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("ask", "best"))).alias("negatives"))
    found = asked.join(of_class, "cls").select("label", "embedding", "positives", "scores", "negatives", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    members = anchors.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(SHARES)).cast("int")).join(found, ["label", "embedding", "share"])
    others = F.slice(F.filter("positives", lambda p: p["vec_id"] != F.col("anchor_id")), 1, POSITIVES)
    pairs = members.withColumnRenamed("vec_id", "anchor_id").select("anchor_id", "scores", "negatives", F.explode(others).alias("p"))
    pairs = pairs.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.down")).alias("positive_score"), "scores", "negatives")
    ask = F.array_position("scores", F.col("positive_score")) - 1
    ranked = pairs.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.col("negatives")[ask]).alias("at", "n"))
    return ranked.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))

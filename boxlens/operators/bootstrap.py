"""Average precision over many resamples of the images at once.

A resample is a weight for each image, how often it was drawn. Detections are put in score order once, in blocks of a class and a
range of scores; a block takes each of its images' weights for all resamples as one array, and running sums, precisions and
envelopes are arrays over the resamples. Only arrays of a block pass between blocks: sums of those before, maxima of those behind.
One more resample, at the end, draws each image once: it must give the plain average precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.operators.evaluation import ap_of_outcomes, outcomes_of
from boxlens.operators.running import range_cuts, range_of
from boxlens.tables import Workspace

#: Detections of a block and ranges of scores, about; and rows whose arrays are held at once.
BLOCK_ROWS, MOST_RANGES, CHUNK = 8192, 1024, 256
BEFORE, BEHIND = -1, -2  # in place of an image: sums of the blocks before, and best precisions behind

_SIDE = "cls_id long, block int, image_id long, w binary, a array<double>, b array<double>"


def draw_arrays(draws: DataFrame, resamples: int) -> DataFrame:
    """(image_id, w): how often each resample (from 0) drew an image, as bytes: digits of one byte each, the lowest place of all resamples first. A resample draws an image a few times, so one place does almost always, and most bytes are 0, 1 or 2."""

    def run(t: pa.Table) -> pa.Table:
        times = np.zeros(resamples, np.int64)
        np.add.at(times, t.column("replicate").to_numpy(), t.column("times").to_numpy())
        places = max(1, -(-int(times.max(initial=0)).bit_length() // 8))
        w = b"".join((times >> 8 * k & 255).astype(np.uint8).tobytes() for k in range(places))
        return pa.table([t.column("image_id").slice(0, 1), pa.array([w], pa.binary())], schema=pa.schema([("image_id", pa.int64()), ("w", pa.binary())]))

    each = draws.select(F.col("image_id").cast("long"), F.col("replicate").cast("long"), F.col("times").cast("long"))
    return each.groupBy("image_id").applyInArrow(run, "image_id long, w binary")


def _times(w: bytes, resamples: int) -> np.ndarray:
    digits = np.frombuffer(w, np.uint8).reshape(-1, resamples).astype(np.int64)
    return (digits << 8 * np.arange(len(digits))[:, None]).sum(axis=0)


class _Block:
    """Rows of a block in score order and its images' weights, (images, resamples + 1)."""

    def __init__(self, rows: pa.Table, side: pa.Table, resamples: int):
        rows = rows.sort_by([("score", "descending"), ("det_id", "descending")])
        images, w, a, b = side.column("image_id").to_numpy(), *(side.column(c).to_pylist() for c in ("w", "a", "b"))
        own = np.flatnonzero(images >= 0)
        order = own[np.argsort(images[own], kind="stable")]
        known = np.unique(np.r_[images[own], rows.column("image_id").to_numpy()])
        self.weights = np.zeros((len(known), resamples + 1), np.int32)
        self.weights[:, -1] = 1
        for k in order:
            self.weights[np.searchsorted(known, images[k]), :-1] = _times(w[k], resamples)
        extra = {int(images[k]): (a[k], b[k]) for k in np.flatnonzero(images < 0)}
        zero = np.zeros(resamples + 1)
        self.before = [np.array(x) for x in extra.get(BEFORE, (zero, zero))]
        self.behind = np.array(extra[BEHIND][0]) if BEHIND in extra else zero
        self.image = np.searchsorted(known, rows.column("image_id").to_numpy())
        self.kind, self.n = rows.column("kind").to_numpy(), rows.column("n").to_numpy()

    def totals(self) -> list[np.ndarray]:
        """Of true and false positives and of objects."""
        return [np.bincount(self.image[at], self.n[at], len(self.weights)) @ self.weights for at in (np.flatnonzero(self.kind == k) for k in (1, 0, 2))]

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(weights, precisions) of the true positives, chunk by chunk. Only there can a precision be larger than the ones before."""
        tp, fp = self.before
        at = np.flatnonzero(self.kind < 2)
        for s in range(0, len(at), CHUNK):
            here = at[s : s + CHUNK]
            hit, w = self.kind[here] == 1, self.weights[self.image[here]]
            up = fp + np.cumsum(np.where(hit[:, None], 0, w), axis=0)
            fp, down = up[-1], up[hit]
            up = tp + np.cumsum(w[hit], axis=0) if hit.any() else np.zeros((0, w.shape[1]))
            tp = up[-1] if len(up) else tp
            yield w[hit], np.divide(up, up + down, out=np.zeros_like(up, np.float64), where=up > 0)

    def best(self) -> np.ndarray:
        return np.max([p.max(axis=0, initial=0.0) for _, p in self.walk()] or [np.zeros(self.weights.shape[1])], axis=0)

    def areas(self) -> np.ndarray:
        """Sum over true positives of weight times the best precision from there on."""
        tops = np.array([p.max(axis=0, initial=0.0) for _, p in self.walk()]).reshape(-1, self.weights.shape[1])
        behind = np.maximum.accumulate(np.r_[tops, self.behind[None]][::-1], axis=0)[::-1][1:]
        total = np.zeros(self.weights.shape[1])
        for (w, p), rest in zip(self.walk(), behind, strict=True):
            if len(p):
                total += (w * np.maximum(np.maximum.accumulate(p[::-1], axis=0)[::-1], rest)).sum(axis=0)
        return total


def _each_block(rows: DataFrame, side: DataFrame, resamples: int, fn) -> DataFrame:
    """fn(block) gives one or two arrays: (cls_id, block, a, b)."""
    out = pa.schema([("cls_id", pa.int64()), ("block", pa.int32()), ("a", pa.list_(pa.float64())), ("b", pa.list_(pa.float64()))])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = fn(_Block(left, right, resamples))
        return pa.table([[key[0].as_py()], [key[1].as_py()], [np.asarray(a, float).tolist()], [np.asarray(b, float).tolist()]], schema=out)

    keys = ["cls_id", "block"]
    return rows.groupBy(*keys).cogroup(side.groupBy(*keys)).applyInArrow(run, "cls_id long, block int, a array<double>, b array<double>")


def _along(blocks: DataFrame, fn, image: int) -> DataFrame:
    """Of each class, what fn makes of its blocks' arrays in order; rows of side. MOST_RANGES arrays a class at most."""
    out = pa.schema([("cls_id", pa.int64()), ("block", pa.int32()), ("image_id", pa.int64()), ("w", pa.binary()), ("a", pa.list_(pa.float64())), ("b", pa.list_(pa.float64()))])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        a, b = (np.array(t.column(c).to_pylist()) for c in ("a", "b"))
        a, b = fn(a, b)
        n = t.num_rows
        return pa.table([t.column("cls_id"), t.column("block"), pa.array(np.full(n, image), pa.int64()), pa.nulls(n, pa.binary()), pa.array(a.tolist(), pa.list_(pa.float64())), pa.array(b.tolist(), pa.list_(pa.float64()))], schema=out)

    return blocks.groupBy("cls_id").applyInArrow(run, _SIDE)


def _sums_before(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(a, axis=0) - a, np.cumsum(b, axis=0) - b


def _best_behind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest = np.r_[a[1:], np.zeros((1, a.shape[1]))]
    best = np.maximum.accumulate(rest[::-1], axis=0)[::-1]
    return best, best


def resampled_ap(outcomes: DataFrame, gt: DataFrame, draws: DataFrame, resamples: int) -> DataFrame:
    """(cls_id, replicate, npos, ap) of each class and resample from 0 on, and as replicate -1 of the images as they are. outcomes: of matching.claims; draws (replicate, image_id, times). Without positives: no row. Without true positives: 0."""
    work = Workspace(outcomes.sparkSession, "bootstrap")
    counted = outcomes.where("outcome <> 'ignored'")  # these change no count
    known = counted.agg(F.count("*").alias("n"), F.approx_count_distinct("cls_id").alias("classes")).first()
    ranges = max(1, min(MOST_RANGES, known["n"] // (BLOCK_ROWS * max(1, known["classes"]))))
    cuts = range_cuts(counted, "score", ranges) if ranges > 1 else []
    kind = F.when(F.col("outcome") == "tp", 1).otherwise(0)
    found = counted.select("cls_id", range_of("score", cuts, descending=True).cast("int").alias("block"), "image_id", kind.alias("kind"), F.lit(1.0).alias("n"), "score", "det_id")
    objects = gt.where(~F.col("difficult")).groupBy("cls_id", "image_id").agg(F.count("*").cast("double").alias("n"))
    spread = F.pmod(F.xxhash64("image_id"), F.lit(len(cuts) + 1)).cast("int")
    objects = objects.select("cls_id", spread.alias("block"), "image_id", F.lit(2).alias("kind"), "n", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("det_id"))
    rows = work.write(found.unionByName(objects), "rows")
    arrays = work.write(draw_arrays(draws, resamples), "arrays")
    none = F.lit(None).cast("array<double>")
    weights = rows.select("cls_id", "block", "image_id").distinct().join(arrays, "image_id").select("cls_id", "block", "image_id", "w", none.alias("a"), none.alias("b"))
    weights = work.write(weights, "weights")

    def totals(block: _Block):
        tp, fp, npos = block.totals()
        return np.r_[tp, npos], np.r_[fp, npos]

    sums = work.write(_each_block(rows, weights, resamples, totals), "sums")
    width = resamples + 1
    before = work.write(_along(sums.select("cls_id", "block", F.slice("a", 1, width).alias("a"), F.slice("b", 1, width).alias("b")), _sums_before, BEFORE), "before")
    detections = rows.where("kind < 2")
    held = weights.join(detections.select("cls_id", "block", "image_id").distinct(), ["cls_id", "block", "image_id"], "left_semi")
    some = detections.select("cls_id", "block").distinct()
    side = held.unionByName(before.join(some, ["cls_id", "block"], "left_semi"))
    best = work.write(_each_block(detections, side, resamples, lambda block: (block.best(), [])), "best")
    behind = work.write(_along(best.select("cls_id", "block", "a", F.col("a").alias("b")), _best_behind, BEHIND), "behind")
    areas = _each_block(detections, side.unionByName(behind), resamples, lambda block: (block.areas(), []))
    added = areas.select("cls_id", F.lit(0).alias("of"), "a").unionByName(sums.select("cls_id", F.lit(1).alias("of"), F.slice("a", width + 1, width).alias("a")))
    out = pa.schema([("cls_id", pa.int64()), ("replicate", pa.int64()), ("npos", pa.int64()), ("ap", pa.float64())])

    def final(t: pa.Table) -> pa.Table:
        a, of = np.array(t.column("a").to_pylist()), t.column("of").to_numpy()
        area, npos = a[of == 0].sum(axis=0) + np.zeros(width), a[of == 1].sum(axis=0)
        at = np.flatnonzero(npos > 0)
        name = np.r_[np.arange(resamples), -1]
        return pa.table([np.full(len(at), t.column("cls_id")[0].as_py()), name[at], npos[at].astype(np.int64), area[at] / npos[at]], schema=out)

    return added.groupBy("cls_id").applyInArrow(final, "cls_id long, replicate long, npos long, ap double")


def interval(outcomes: DataFrame, aps: DataFrame, gt: DataFrame, share: float = 0.95) -> DataFrame:
    """(cls_id, ap, mean, std, low, high, sane): the spread of resampled_ap; low and high hold that share in the middle, as elements. sane: the resample that draws each image once gives exactly what evaluation gives."""
    tail = round((1 - share) / 2, 12)  # a last digit too much would be an element too many
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ap) FILTER (WHERE replicate >= 0)")
    drawn = F.when(F.col("replicate") >= 0, F.col("ap"))
    found = aps.groupBy("cls_id").agg(F.avg(drawn).alias("mean"), F.stddev_samp(drawn).alias("std"), disc(tail).alias("low"), disc(1 - tail).alias("high"), F.max(F.when(F.col("replicate") < 0, F.col("ap"))).alias("identity"))
    return ap_of_outcomes(outcomes, gt).join(found, "cls_id").select("cls_id", "ap", "mean", "std", "low", "high", (F.abs(F.col("ap") - F.col("identity")) <= 1e-12).alias("sane"))


def bootstrap(det: DataFrame, gt: DataFrame, draws: DataFrame, resamples: int) -> tuple[DataFrame, DataFrame]:
    """(resampled_ap, interval). Raises where the resample that draws each image once does not give the plain average precision."""
    work = Workspace(det.sparkSession, "bootstrap")
    outcomes = outcomes_of(det, gt)
    aps = work.write(resampled_ap(outcomes, gt, draws, resamples), "aps")
    spread = work.write(interval(outcomes, aps, gt), "interval")
    if wrong := [r["cls_id"] for r in spread.where("not sane").select("cls_id").limit(3).collect()]:
        raise ValueError(f"the images as they are do not give the average precision of classes {wrong}")
    return aps, spread

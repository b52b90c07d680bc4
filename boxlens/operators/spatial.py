"""Joins of boxes with boxes by place: tiles of a grid, in levels by size.

A box belongs to the level whose tiles are at least as large as it is, and touches four of them at most. A pair is looked for
at the level of its larger box, and there only in the tile that holds the upper left corner of the intersection, so that no
pair comes twice. Boxes of very different sizes cost a copy for each level in use, never one for each tile that a large box covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.functions.boxes import SIDES, intersects, iou

#: Tiles of the lowest level are so many times as wide as boxes are on average, up to a power of two.
SPARE = 2
#: Where no larger share of all boxes than this is above the lowest level, levels above it are one.
FEW = 0.05


def _longest() -> Column:
    return F.greatest(F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1).cast("double")


def _doublings() -> Column:
    """The least power of two, as its exponent, that a box's longest side does not pass."""
    return F.greatest(F.ceil(F.log2(F.greatest(_longest(), F.lit(1.0)))), F.lit(0)).cast("int")


def grid(windows: DataFrame, boxes: DataFrame, side: int | None = None) -> tuple[int, int | None, list[int], list[int]]:
    """The exponent of the lowest level's tiles, from the mean longest side of all boxes if no side is given, and the levels of the windows' and of the boxes' own. Where few boxes are above the lowest level, levels above it are one, the highest, which is given too: a copy for each level in between would cost more than it saves. A pass over each table."""
    found = [[(r["d"], r["s"], r["n"]) for r in t.groupBy(_doublings().alias("d")).agg(F.sum(_longest()).alias("s"), F.count("*").alias("n")).collect()] for t in (windows, boxes)]
    both = [*found[0], *found[1]]
    mean = sum(s for _, s, _ in both) / max(1, sum(n for *_, n in both))
    lowest = int(SPARE * mean).bit_length() if side is None else max(0, int(side - 1).bit_length())
    few = sum(n for d, _, n in both if d > lowest) <= FEW * sum(n for *_, n in both)
    top = max([1, *(d - lowest for d, *_ in both)]) if few else None
    level = lambda d: 0 if d <= lowest else top or d - lowest
    return lowest, top, *(sorted({level(d) for d, *_ in t}) for t in found)


def _in_tiles(boxes: DataFrame, keys: list[str], prefix: str, lowest: int, top: int | None, at: Column) -> DataFrame:
    """Each box once for each tile that it touches at each level and in each role of at: _k, _role, _tx, _ty, and its columns but the keys under the prefix."""
    place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_at._k") + lowest)).cast("long")
    each = boxes.withColumn("_own", F.when(_doublings() > lowest, F.lit(top) if top else _doublings() - lowest).otherwise(F.lit(0))).withColumn("_at", F.explode(at))
    each = each.withColumn("_tx", F.explode(F.sequence(place("x1"), place("x2")))).withColumn("_ty", F.explode(F.sequence(place("y1"), place("y2"))))
    return each.select(*keys, F.col("_at._k").alias("_k"), F.col("_at._role").alias("_role"), "_tx", "_ty", *[F.col(c).alias(prefix + c) for c in boxes.columns if c not in keys])


def meetings(windows: DataFrame, boxes: DataFrame, keys: list[str], side: int | None = None) -> DataFrame:
    """Pairs that share a tile, before any test of their sides: w_* and b_*, and the tile's side. In one role windows stand at their own level and boxes at theirs and all above, in the other boxes at their own and windows at those above theirs: one join."""
    lowest, top, *own_levels = grid(windows, boxes, side)
    of_windows, of_boxes = (F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>") for used in own_levels)
    at = lambda levels, role: F.transform(levels, lambda k: F.struct(k.alias("_k"), F.lit(role).alias("_role")))
    own, from_own, above = F.array(F.col("_own")), F.filter(of_windows, lambda k: k >= F.col("_own")), F.filter(of_boxes, lambda k: k > F.col("_own"))
    w = _in_tiles(windows, keys, "w_", lowest, top, F.concat(at(own, 0), at(above, 1)))
    b = _in_tiles(boxes, keys, "b_", lowest, top, F.concat(at(from_own, 0), at(own, 1)))
    return w.join(b, [*keys, "_k", "_role", "_tx", "_ty"]).withColumn("_side", F.pow(F.lit(2.0), F.col("_k") + lowest))


def overlaps(windows: DataFrame, boxes: DataFrame, keys: list[str], side: int | None = None) -> DataFrame:
    """Pairs of equal keys whose boxes meet, each once: keys, w_*, b_* and iou. Boxes hold whole pixels, both ends inside; those without any pixel meet nothing. side: about the lowest level's tiles; chosen from the boxes if not given, and of no consequence for the result."""
    some = lambda t: t.where("x2 >= x1 and y2 >= y1")
    met = meetings(some(windows), some(boxes), keys, side)
    corner = lambda a, t: F.floor(F.greatest("w_" + a, "b_" + a) / F.col("_side")).cast("long") == F.col(t)
    found = met.where(intersects("w_", "b_") & corner("x1", "_tx") & corner("y1", "_ty"))
    return found.withColumn("iou", iou("w_", "b_")).drop("_k", "_role", "_tx", "_ty", "_side")


def best_overlap(windows: DataFrame, boxes: DataFrame, keys: list[str], box_id: str, side: int | None = None) -> DataFrame:
    """windows with the box of the largest iou (of equals the least id) and that iou; null and 0 where none meets. window_id names a window."""
    pairs = overlaps(windows.select(*keys, "window_id", *SIDES), boxes.select(*keys, box_id, *SIDES), keys, side)
    best = pairs.groupBy("w_window_id").agg(F.max_by(F.struct(f"b_{box_id}", "iou"), F.struct("iou", -F.col(f"b_{box_id}"))).alias("b"))
    best = best.select(F.col("w_window_id").alias("window_id"), F.col(f"b.b_{box_id}").alias(box_id), "b.iou")
    return windows.join(best, "window_id", "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))

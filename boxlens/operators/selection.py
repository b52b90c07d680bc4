"""Training sets, clipping, gates and other selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.functions.boxes import area, clipped, iou, mirrored
from boxlens.operators.matching import listed


def clip(det: DataFrame, w: int, h: int) -> DataFrame:
    """Boxes cut to the image; those wholly outside are dropped."""
    sides = dict(zip(("x1", "y1", "x2", "y2"), clipped(w, h), strict=True))
    return det.select(*[sides.get(c, F.col(c)) for c in det.columns]).where("x2 >= x1 and y2 >= y1")


def positives(gt: DataFrame, w: int) -> DataFrame:
    """Objects that are not difficult, truncated ones included, each also mirrored; with the area."""
    kept = gt.where(~F.col("difficult"))
    keys = ["gt_id", "image_id", "cls_id"]
    plain = kept.select(*keys, F.lit(False).alias("flip"), "x1", "y1", "x2", "y2")
    flipped = kept.select(*keys, F.lit(True).alias("flip"), *mirrored(w))
    return plain.unionByName(flipped).withColumn("size", area())


def negative_images(images: DataFrame, gt: DataFrame, classes: int) -> DataFrame:
    """(cls_id, image_id) without any object of the class; a difficult one disqualifies too."""
    each = images.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))).alias("cls_id"))
    return each.join(gt.select("image_id", "cls_id").distinct(), ["image_id", "cls_id"], "left_anti").select("cls_id", "image_id")


def positive_images(gt: DataFrame) -> DataFrame:
    """One row an image and class: its objects in order of id, as structs."""
    boxes = F.sort_array(F.collect_list(F.struct("gt_id", "x1", "y1", "x2", "y2")))
    return gt.where(~F.col("difficult")).groupBy("image_id", "cls_id").agg(F.count("*").alias("n"), boxes.alias("boxes"))


def large_enough(boxes: DataFrame, least_h: int, least_w: int, cell: int) -> DataFrame:
    """Boxes of no less than half the smallest detection window's area."""
    return boxes.where(area() >= F.lit(least_h * cell / 2) * F.lit(least_w * cell / 2))


def crop(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """The frame around a group's boxes, padded by half of the largest width and height, cut at 1."""
    w, h = F.max(F.col("x2") - F.col("x1") + 1), F.max(F.col("y2") - F.col("y1") + 1)
    found = boxes.groupBy(key).agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"), w.alias("w"), h.alias("h"))
    pad = lambda s: F.round(F.col(s) / 2).cast("long")
    return found.select(key, F.greatest(F.lit(1), F.col("a") - pad("w")).alias("x1"), F.greatest(F.lit(1), F.col("b") - pad("h")).alias("y1"), (F.col("c") + pad("w")).alias("x2"), (F.col("d") + pad("h")).alias("y2"))


def above(det: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """Scores over the threshold: strictly for the exact search, at it too for the cascade."""
    return det.where(F.col("score") >= threshold if inclusive else F.col("score") > threshold)


def gated(score: Column, overlap: Column, least: float) -> Column:
    """The score where the overlap is enough, else minus infinity."""
    return F.when(overlap < least, F.lit(float("-inf"))).otherwise(score)


def loss(overlap: Column) -> Column:
    return F.when(overlap < 0.5, 1.0).otherwise(0.0)


def output_losses(cells: DataFrame, own: DataFrame, others: DataFrame, least_own: float = 0.1, most_other: float = 0.5) -> DataFrame:
    """Loss of each candidate window of an example: minus infinity where it overlaps its own box too little or another box too much. cells: example_id, cell_id and a box; own and others: example_id and boxes. One join and one aggregate."""
    sides = ("x1", "y1", "x2", "y2")
    boxes = own.withColumn("is_own", F.lit(True)).unionByName(others.withColumn("is_own", F.lit(False)))
    pairs = cells.select("example_id", "cell_id", *[F.col(c).alias("w_" + c) for c in sides]).join(boxes.select("example_id", "is_own", *[F.col(c).alias("o_" + c) for c in sides]), "example_id")
    overlap = iou("w_", "o_")
    found = pairs.groupBy("example_id", "cell_id").agg(F.max(F.when(F.col("is_own"), overlap)).alias("own"), F.max(F.when(~F.col("is_own"), overlap)).alias("other"))
    bad = F.coalesce(F.col("other") >= most_other, F.lit(False)) | (F.col("own") < least_own)
    return found.where("own is not null").select("example_id", "cell_id", F.when(bad, F.lit(float("-inf"))).otherwise(loss(F.col("own"))).alias("loss"))


def loss_field(windows: DataFrame, boxes: DataFrame, keys: list[str], window: str, box: str, least_own: float = 0.1, most_other: float = 0.5) -> DataFrame:
    """output_losses where every box is an example and all windows of equal keys are its cells: (example_id, cell_id, loss).

    How many boxes a window overlaps too much is counted once for each window; whether others than the example's own are among
    them is then a difference, so no row stands for an example, a window and another box. Equal boxes have equal losses: a window
    meets each different box once, rows of a window stay together in the task that has its keys, and only the rows that come
    out stand for each example.
    """
    sides = ("x1", "y1", "x2", "y2")
    w = windows.select(*keys, window, *sides).repartition(*keys)
    w = w.select(*keys, *[F.col(c).alias(f"w_{c}") for c in (window, *sides)])
    b = listed(boxes, keys, box).select(*keys, *[F.col(c).alias(f"b_{c}") for c in (*sides, "ids")])
    counted = b.select(*keys, *[f"b_{c}" for c in sides], F.size("b_ids").alias("b_n")).hint("shuffle_hash")
    close = F.when(iou("w_", "b_") >= most_other, F.col("b_n")).otherwise(0)
    crowd = w.join(counted, keys).groupBy(*w.columns).agg(F.sum(close).alias("_close"))
    own = crowd.join(b.hint("shuffle_hash"), keys).withColumn("_own", iou("w_", "b_"))
    others = F.col("_close") - (F.col("_own") >= most_other).cast("int")
    value = F.when((others > 0) | (F.col("_own") < least_own), F.lit(float("-inf"))).otherwise(loss(F.col("_own")))
    held = own.select(f"w_{window}", "b_ids", value.alias("loss"))
    return held.select(F.explode("b_ids").alias("example_id"), F.col(f"w_{window}").alias("cell_id"), "loss")


def live_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that learn or have a weight other than zero."""
    return blocks.where((F.col("learn") != 0) | F.exists("w", lambda v: v != 0))


def placed_parts(parts: DataFrame) -> DataFrame:
    """Long form of filter boxes without those that were not placed, which are all zero."""
    return parts.where("x1 <> 0 or y1 <> 0 or x2 <> 0 or y2 <> 0")


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 3) -> DataFrame:
    """n rows in an order that depends on the key and the seed only."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)

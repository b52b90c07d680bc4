"""Detections against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.functions.boxes import SIDES, intersects, iou

KEYS = ["image_id", "cls_id"]


def prefixed(df: DataFrame, p: str, keep: list[str] | None = None) -> DataFrame:
    return df.select(*(KEYS if keep is None else keep), *[F.col(c).alias(p + c) for c in df.columns if c not in (KEYS if keep is None else keep)])


def overlapping_pairs(det: DataFrame, gt: DataFrame) -> DataFrame:
    """Pairs of an image and class whose boxes meet: d_* and g_* columns and iou. The equi keys carry the join; the boxes are a residual condition."""
    pairs = prefixed(det, "d_").join(prefixed(gt, "g_"), KEYS).where(intersects("d_", "g_"))
    return pairs.withColumn("iou", iou("d_", "g_"))


def different_boxes(gt: DataFrame) -> DataFrame:
    """Objects of an image and class with equal boxes as one: the least gt_id, with its difficult flag. Only it can be the best match of a detection, so there are no more rows than different boxes."""
    return gt.groupBy(*KEYS, *SIDES).agg(F.min("gt_id").alias("gt_id"), F.min_by("difficult", "gt_id").alias("difficult"))


def box_meetings(det: DataFrame, gt: DataFrame) -> DataFrame:
    """overlapping_pairs with each different box once, the pairs of a detection one after another: detections are sorted before the join, which keeps their order, so an aggregate by KEYS and d_det_id, d_score neither shuffles nor sorts pairs."""
    order = [*KEYS, "det_id", "score"]
    return overlapping_pairs(det.repartition(*KEYS).sortWithinPartitions(*order), different_boxes(gt).hint("shuffle_hash"))


#: Objects that one row lists at most.
LISTED = 4096


def listed(boxes: DataFrame, keys: list[str], box: str) -> DataFrame:
    """(keys, sides, ids): boxes of equal keys and sides as one row, or a row for each LISTED ids of them. What depends on the sides alone is then done once for all of them. Dealt by the keys."""
    same = [*keys, *SIDES]
    turn = F.row_number().over(Window.partitionBy(*same).orderBy(box))
    held = boxes.select(*same, box).repartition(*keys).withColumn("_part", F.floor((turn - 1) / LISTED))
    return held.groupBy(*same, "_part").agg(F.sort_array(F.collect_list(box)).alias("ids")).drop("_part")


def pairs_of_copies(det: DataFrame, gt: DataFrame) -> DataFrame:
    """(det_id, gt_id, iou to nine places) of overlapping_pairs. A detection meets each different box once and only the rows that come out stand for each of its objects, one after another, so that they are written in little room."""
    found = overlapping_pairs(det.select(*KEYS, "det_id", *SIDES).repartition(*KEYS), listed(gt, KEYS, "gt_id").hint("shuffle_hash"))
    return found.select("d_det_id", "g_ids", F.round("iou", 9).alias("iou")).select(F.col("d_det_id").alias("det_id"), F.explode("g_ids").alias("gt_id"), "iou")


def best_match(det: DataFrame, gt: DataFrame, least_iou: float | None = None) -> DataFrame:
    """Each detection's ground truth of the largest iou, of equals the smallest gt_id. Detections that meet none, or none of least_iou, are left out."""
    pairs = box_meetings(det.select(*KEYS, "det_id", "score", *SIDES), gt)
    if least_iou is not None:
        pairs = pairs.where(F.col("iou") >= least_iou)
    best = F.max_by(F.struct("g_gt_id", "g_difficult", "iou"), F.struct("iou", -F.col("g_gt_id")))
    return pairs.groupBy(*KEYS, "d_det_id", "d_score").agg(best.alias("b")).select(*KEYS, F.col("d_det_id").alias("det_id"), F.col("d_score").alias("score"), F.col("b.g_gt_id").alias("gt_id"), F.col("b.g_difficult").alias("difficult"), "b.iou")


def claims(det: DataFrame, gt: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """det with gt_id and outcome: tp for the first detection, in order of score, that matches a ground truth; fp; or ignored, which a match with a difficult one is. Matches are as many as detections, so they are never broadcast."""
    matched = best_match(det, gt, least_iou)
    turn = F.row_number().over(Window.partitionBy("image_id", "gt_id").orderBy(F.desc("score"), F.desc("det_id")))
    outcome = F.when(F.col("difficult"), "ignored").when(turn == 1, "tp").otherwise("fp")
    hits = matched.select("det_id", "gt_id", outcome.alias("outcome"))
    return det.join(hits.hint("merge"), "det_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("fp")))


def claim_labels(det: DataFrame, gt: DataFrame, difficult_label: int = 1) -> DataFrame:
    """(det_id, label): 1 for claims, difficult_label for matches with difficult ones, else -1."""
    found = claims(det, gt)
    return found.select("det_id", F.when(F.col("outcome") == "tp", 1).when(F.col("outcome") == "ignored", difficult_label).otherwise(-1).cast("int").alias("label"))

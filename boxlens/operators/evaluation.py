"""Precision, recall, average precision and tests of differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators.matching import best_match, claims
from boxlens.operators.ranking import top_k
from boxlens.operators.running import best_from_here, range_cuts, running
from boxlens.tables import written


def positives(gt: DataFrame, keys: list[str]) -> DataFrame:
    return gt.groupBy(*keys).agg(F.sum(F.when(~F.col("difficult"), 1).otherwise(0)).cast("long").alias("npos"))


def outcomes_of(det: DataFrame, gt: DataFrame) -> DataFrame:
    """claims() without the boxes, as a written table: what follows reads it several times."""
    return written(claims(det, gt).select("image_id", "cls_id", "det_id", "score", "gt_id", "outcome"), "outcomes")


def counted(outcomes: DataFrame, keys: list[str], times=None) -> DataFrame:
    """rn, tp and fp up to each row in order of score, whose ranges split a group's rows."""
    one = F.lit(1).cast("long") if times is None else F.col(times)
    is_ = lambda x: F.when(F.col("outcome") == x, one).otherwise(0)
    return running(outcomes, keys, "score", score_order(), range_cuts(outcomes, "score"), {"tp": is_("tp"), "fp": is_("fp")}, number="rn")


def with_precision(points: DataFrame) -> DataFrame:
    """Null while every row so far was ignored."""
    return points.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))))


def curve(outcomes: DataFrame, npos: DataFrame, keys: list[str]) -> DataFrame:
    """recall and precision at each row."""
    points = counted(outcomes, keys).join(F.broadcast(npos), keys)  # a row a group
    return with_precision(points.withColumn("recall", F.col("tp").cast("double") / F.col("npos")))


def average_precision(points: DataFrame, npos: DataFrame, keys: list[str], times=None) -> DataFrame:
    """Area under the monotone envelope: each true positive adds the best precision from it on, over the number of positives. 0 without true positives; groups without positives are left out."""
    one = F.lit(1) if times is None else F.col(times)
    best = best_from_here(points, keys, "rn", "precision", "envelope").where(F.col("outcome") == "tp")
    total = best.groupBy(*keys).agg(F.sum(F.col("envelope") * one).alias("s"))
    return npos.where("npos > 0").join(total, keys, "left").select(*keys, "npos", (F.coalesce("s", F.lit(0.0)) / F.col("npos")).alias("ap"))


def score_order() -> list:
    return [F.desc("score"), F.desc("det_id")]


def ap_of_outcomes(outcomes: DataFrame, gt: DataFrame) -> DataFrame:
    npos = positives(gt, ["cls_id"])
    return average_precision(curve(outcomes, npos, ["cls_id"]), npos, ["cls_id"])


def ap_per_class(det: DataFrame, gt: DataFrame) -> DataFrame:
    return ap_of_outcomes(outcomes_of(det, gt), gt)


def paired_sign_test(differences: DataFrame, unit: str, flips: int, seed: int = 1) -> DataFrame:
    """Two-sided randomisation test of mean(diff) = 0: (observed, extreme, p). Each round turns each unit's sign by the parity of a sum of digits of a hash both engines share. Units are dealt out and each makes its own rounds, which are summed before they are shuffled, so neither the units nor the rounds need to be few."""
    each = written(differences, "differences").repartition(unit)
    turned = each.select("diff", unit, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(flips - 1).cast("long"))).alias("round"))
    sign = F.when(F.pmod(F.floor((F.col("round") * 2654435761 + F.col(unit) * 40503 + seed) % 4294967296 / 65536), F.lit(2)) == 0, 1).otherwise(-1)
    means = turned.withColumn("s", sign * F.col("diff")).groupBy("round").agg(F.avg("s").alias("m"))
    observed = each.agg(F.avg("diff").alias("observed"))  # one row
    return means.crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.sum((F.abs("m") >= F.abs("observed") - 1e-12).cast("long")).alias("extreme")).withColumn("p", F.col("extreme").cast("double") / flips)


def error_buckets(det: DataFrame, gt: DataFrame) -> DataFrame:
    """(bucket, cls_id, n): false positives that meet nothing well enough, second detections of a claimed object, and missed objects."""
    found = outcomes_of(det, gt)
    wrong = found.where("outcome = 'fp'").select("cls_id", F.when(F.col("gt_id").isNull(), "false_positive").otherwise("multiple_detection").alias("bucket"))
    missed = gt.where(~F.col("difficult")).join(found.where("outcome = 'tp'").select("gt_id"), "gt_id", "left_anti").select("cls_id", F.lit("missed").alias("bucket"))
    return wrong.unionByName(missed).groupBy("bucket", "cls_id").agg(F.count("*").alias("n"))


@dataclass
class Errors:
    """of: the listing of wrong detections; missed: objects that no listed detection claims."""

    of: DataFrame
    missed: DataFrame


def error_listing(det: DataFrame, gt: DataFrame, listed: int = 2000, most_recall: float = 0.6, least_iou: float = 0.5) -> Errors:
    """What a reader of an evaluation looks at: the wrong ones among the first detections of each class, and what these miss.

    of: (cls_id, rank, det_id, image_id, score, kind, overlap, gt_id, claimant, recall, precision) of each wrong detection
    among the class's first listed ones, as long as recall is at most most_recall. kind is multiple_detection where the object
    that it matches was claimed, by the claimant, and false_positive elsewhere; overlap and gt_id are of the best match, null
    without one. missed: (cls_id, image_id, gt_id, overlap, det_id) of each object that is not difficult and that no listed
    detection claims, with the best overlap of those that match it best. The first of a class stay with each task before
    any shuffle, so only they are matched.
    """
    first = written(top_k(det, ["cls_id"], score_order(), listed).select("cls_id", "rank", "det_id", "image_id", "score", "x1", "y1", "x2", "y2"), "listed")
    matched = best_match(first, gt).select("det_id", "gt_id", "difficult", F.col("iou").alias("overlap"))
    turn = F.row_number().over(Window.partitionBy("image_id", "gt_id", F.col("overlap") >= least_iou).orderBy("rank"))
    hit = F.col("overlap") >= least_iou
    outcome = F.when(~F.coalesce(hit, F.lit(False)), "false_positive").when(F.col("difficult"), "ignored").when(turn == 1, "tp").otherwise("multiple_detection")
    found = written(first.join(matched, "det_id", "left").withColumn("kind", outcome), "kinds")
    upto = Window.partitionBy("cls_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # listed rows a class at most
    tp = F.sum((F.col("kind") == "tp").cast("long")).over(upto)
    fp = F.sum(F.col("kind").isin("false_positive", "multiple_detection").cast("long")).over(upto)
    npos = positives(gt, ["cls_id"])
    scored = found.withColumn("tp", tp).withColumn("fp", fp).join(F.broadcast(npos), "cls_id")  # a row a class
    scored = scored.withColumn("recall", F.col("tp").cast("double") / F.col("npos")).withColumn("precision", F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))
    claimed = found.where("kind = 'tp'").select("image_id", "gt_id", F.col("det_id").alias("claimant"))
    wrong = scored.where(F.col("kind").isin("false_positive", "multiple_detection") & (F.coalesce("recall", F.lit(0.0)) <= most_recall))
    of = wrong.join(claimed, ["image_id", "gt_id"], "left").withColumn("claimant", F.when(F.col("kind") == "multiple_detection", F.col("claimant")))
    best = found.where("gt_id is not null").groupBy("image_id", "gt_id").agg(F.max_by(F.struct("overlap", "det_id"), F.struct("overlap", -F.col("rank"))).alias("b"))
    missed = gt.where(~F.col("difficult")).join(claimed, ["image_id", "gt_id"], "left_anti").join(best, ["image_id", "gt_id"], "left")
    return Errors(
        of.select("cls_id", "rank", "det_id", "image_id", "score", "kind", "overlap", "gt_id", "claimant", "recall", "precision"),
        missed.select("cls_id", "image_id", "gt_id", F.col("b.overlap").alias("overlap"), F.col("b.det_id").alias("det_id")),
    )

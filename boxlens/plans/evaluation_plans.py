"""Queries of precision, recall and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.operators import bootstrap, evaluation, suppression
from boxlens.operators.selection import clip
from boxlens.plans.detection_plans import BEST_SQL, CLAIM_SQL, NMS_SQL, PAIRS_SQL
from boxlens.plans.registry import query
from boxlens.sources.fixtures import CLIP_SQL, DET_SQL, GT_SQL, HEIGHT, IMAGES, WIDTH, det, gt
from boxlens.tables import written

BASE_SQL = f"WITH {DET_SQL}, {GT_SQL}, {PAIRS_SQL}, {BEST_SQL}, {CLAIM_SQL}"
NPOS_SQL = "npos AS (SELECT cls_id, CAST(sum(CASE WHEN difficult THEN 0 ELSE 1 END) AS BIGINT) AS npos FROM gt GROUP BY cls_id)"
CURVE_SQL = """points AS (
  SELECT cls_id, det_id, outcome, row_number() OVER w AS rn, CAST(sum(CASE WHEN outcome = 'tp' THEN 1 ELSE 0 END) OVER u AS BIGINT) AS tp, CAST(sum(CASE WHEN outcome = 'fp' THEN 1 ELSE 0 END) OVER u AS BIGINT) AS fp
  FROM claim WINDOW w AS (PARTITION BY cls_id ORDER BY score DESC, det_id DESC), u AS (PARTITION BY cls_id ORDER BY score DESC, det_id DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT p.*, npos, CAST(tp AS DOUBLE) / npos AS recall, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS prec FROM points p JOIN npos USING (cls_id))"""
AP_SQL = """env AS (SELECT *, max(prec) OVER (PARTITION BY cls_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM curve),
sums AS (SELECT cls_id, sum(envelope / npos) AS ap FROM env WHERE outcome = 'tp' GROUP BY cls_id),
aps AS (SELECT cls_id, npos, coalesce(ap, 0) AS ap FROM npos LEFT JOIN sums USING (cls_id) WHERE npos > 0)"""


@query(f"{BASE_SQL}, {NPOS_SQL}, {CURVE_SQL} SELECT cls_id, det_id, tp, fp, round(recall, 9) AS recall, round(prec, 9) AS prec FROM curve")
def pr_curve(spark, sf_dir):
    d, g = det(spark, sf_dir), gt(spark, sf_dir)
    points = evaluation.curve(evaluation.outcomes_of(d, g), evaluation.positives(g, ["cls_id"]), ["cls_id"])
    return points.select("cls_id", "det_id", "tp", "fp", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("prec"))


@query(f"{BASE_SQL}, {NPOS_SQL}, {CURVE_SQL}, {AP_SQL} SELECT cls_id, npos, round(ap, 9) AS ap FROM aps")
def ap_per_class(spark, sf_dir):
    return evaluation.ap_per_class(det(spark, sf_dir), gt(spark, sf_dir)).withColumn("ap", F.round("ap", 9))


@query(f"{BASE_SQL}, {NPOS_SQL}, {CURVE_SQL}, {AP_SQL} SELECT count(*) AS classes, round(avg(ap), 9) AS mean_ap FROM aps")
def mean_ap(spark, sf_dir):
    return evaluation.ap_per_class(det(spark, sf_dir), gt(spark, sf_dir)).agg(F.count("*").alias("classes"), F.round(F.avg("ap"), 9).alias("mean_ap"))


def _other(sql: str) -> str:
    """The same common tables for the second run, of component 1 alone."""
    for name in ("pairs", "best", "claim", "points", "curve", "env", "sums", "aps"):
        import re

        sql = re.sub(rf"\b{name}\b", f"{name}_b", sql)
    return re.sub(r"\bFROM det d\b", "FROM one d", sql)


@query(f"{BASE_SQL}, {NPOS_SQL}, {CURVE_SQL}, {AP_SQL}, one AS (SELECT * FROM det WHERE comp = 1), {_other(', '.join([PAIRS_SQL, BEST_SQL, CLAIM_SQL, CURVE_SQL, AP_SQL]))} SELECT a.cls_id, round(a.ap, 9) AS ap_a, round(b.ap, 9) AS ap_b, round(b.ap - a.ap, 9) AS diff FROM aps a JOIN aps_b b USING (cls_id)")
def compare_runs(spark, sf_dir):
    d, g = det(spark, sf_dir), gt(spark, sf_dir)
    d = written(d, "det")  # both runs read it
    a = evaluation.ap_per_class(d, g).select("cls_id", F.col("ap").alias("ap_a"))
    b = evaluation.ap_per_class(d.where("comp = 1"), g).select("cls_id", F.col("ap").alias("ap_b"))
    r = lambda e, n: F.round(e, 9).alias(n)
    return a.join(b, "cls_id").select("cls_id", r(F.col("ap_a"), "ap_a"), r(F.col("ap_b"), "ap_b"), r(F.col("ap_b") - F.col("ap_a"), "diff"))


REPLICATES = 5
#: The reference's resamples and flips.
ALL_REPLICATES, ALL_FLIPS = 1000, 100_000


def draws(spark, replicates=REPLICATES):
    """As many draws as images, with replacement, from a rule both engines share: (replicate, image_id, times)."""
    grid = spark.range(replicates * IMAGES).select((F.col("id") / IMAGES).cast("long").alias("replicate"), (F.col("id") % IMAGES).alias("k"))
    drawn = F.floor(F.pmod((F.col("replicate") * 7919 + F.col("k") + 1) * 2654435761, F.lit(4294967296)) / 65536) % IMAGES
    return grid.select("replicate", drawn.alias("image_id")).groupBy("replicate", "image_id").agg(F.count("*").alias("times"))


def _boot_sql(replicates: int) -> str:
    """Rows (replicate, cls_id, npos, ap) as boot."""
    return f"""{BASE_SQL}, draws AS (SELECT replicate, image_id, count(*) AS times FROM (SELECT r AS replicate, (((r * 7919 + k + 1) * 2654435761) % 4294967296 // 65536) % {IMAGES} AS image_id FROM (SELECT CAST(range AS BIGINT) AS r FROM range({replicates})), (SELECT CAST(range AS BIGINT) AS k FROM range({IMAGES}))) GROUP BY replicate, image_id),
objects AS (SELECT image_id, cls_id, sum(CASE WHEN difficult THEN 0 ELSE 1 END) AS n FROM gt GROUP BY ALL),
np AS (SELECT replicate, cls_id, CAST(sum(n * times) AS BIGINT) AS npos FROM objects JOIN draws USING (image_id) GROUP BY replicate, cls_id),
tops AS (SELECT cls_id, image_id, outcome, count(*) FILTER (WHERE outcome = 'tp') OVER (PARTITION BY cls_id ORDER BY score DESC, det_id DESC) AS k FROM claim WHERE outcome <> 'ignored'),
pt AS (SELECT cls_id, image_id, k, count(*) FILTER (WHERE outcome = 'tp') AS tps, count(*) FILTER (WHERE outcome = 'fp') AS fps FROM tops GROUP BY ALL),
step AS (SELECT replicate, cls_id, k, CAST(sum(tps * times) AS BIGINT) AS tps, CAST(sum(fps * times) AS BIGINT) AS fps FROM pt JOIN draws USING (image_id) GROUP BY ALL),
upto AS (SELECT *, sum(tps) OVER w AS tp, sum(fps) OVER w - fps AS fp FROM step WINDOW w AS (PARTITION BY replicate, cls_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
en AS (SELECT replicate, cls_id, tps, max(CASE WHEN tp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END) OVER (PARTITION BY replicate, cls_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM upto),
s AS (SELECT replicate, cls_id, sum(envelope * tps) AS s FROM en WHERE tps > 0 GROUP BY replicate, cls_id),
boot AS (SELECT replicate, cls_id, npos, coalesce(s, 0) / npos AS ap FROM np LEFT JOIN s USING (replicate, cls_id) WHERE npos > 0)"""


@query(f"{_boot_sql(REPLICATES)} SELECT replicate, cls_id, npos, round(ap, 9) AS ap FROM boot")
def bootstrap_ap(spark, sf_dir):
    """A sample of bootstrap_ap_whole: its first resamples."""
    found = bootstrap.resampled_ap(evaluation.outcomes_of(det(spark, sf_dir), gt(spark, sf_dir)), gt(spark, sf_dir), draws(spark), REPLICATES)
    return found.where("replicate >= 0").withColumn("ap", F.round("ap", 9))


@query(f"{_boot_sql(ALL_REPLICATES)} SELECT replicate, cls_id, npos, round(ap, 9) AS ap FROM boot")
def bootstrap_ap_whole(spark, sf_dir):
    """With as many resamples as the reference draws."""
    aps, _ = bootstrap.bootstrap(det(spark, sf_dir), gt(spark, sf_dir), draws(spark, ALL_REPLICATES), ALL_REPLICATES)
    return aps.where("replicate >= 0").withColumn("ap", F.round("ap", 9))


@query(f"""{_boot_sql(ALL_REPLICATES)}, {NPOS_SQL}, {CURVE_SQL}, {AP_SQL},
spread AS (SELECT cls_id, avg(ap) AS mean, stddev_samp(ap) AS std, quantile_disc(ap, 0.025) AS low, quantile_disc(ap, 0.975) AS high FROM boot GROUP BY cls_id)
SELECT cls_id, round(ap, 6) AS ap, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high, true AS sane FROM aps JOIN spread USING (cls_id)""")
def bootstrap_interval(spark, sf_dir):
    """The spread of all resamples of each class, and that the images as they are give the plain average precision."""
    _, spread = bootstrap.bootstrap(det(spark, sf_dir), gt(spark, sf_dir), draws(spark, ALL_REPLICATES), ALL_REPLICATES)
    return spread.select("cls_id", *[F.round(c, 6).alias(c) for c in ("ap", "mean", "std", "low", "high")], "sane")


def _flip_sql(flips: int) -> str:
    return f"""WITH {DET_SQL}, diffs AS (SELECT cls_id, round(avg(CASE WHEN comp = 1 THEN score END) - avg(CASE WHEN comp = 2 THEN score END), 6) AS diff FROM det GROUP BY cls_id),
o AS (SELECT avg(diff) AS observed FROM diffs),
m AS (SELECT r, avg(CASE WHEN ((r * 2654435761 + cls_id * 40503 + 1) % 4294967296 // 65536) % 2 = 0 THEN diff ELSE -diff END) AS m FROM diffs, (SELECT CAST(range AS BIGINT) AS r FROM range({flips})) GROUP BY r)
SELECT round(observed, 9) AS observed, CAST(sum(CASE WHEN abs(m) >= abs(observed) - 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS extreme, sum(CASE WHEN abs(m) >= abs(observed) - 1e-12 THEN 1 ELSE 0 END) / {flips}.0::DOUBLE AS p FROM m, o GROUP BY observed"""


def differences(spark, sf_dir):
    mean = lambda c: F.avg(F.when(F.col("comp") == c, F.col("score")))
    return det(spark, sf_dir).groupBy("cls_id").agg(F.round(mean(1) - mean(2), 6).alias("diff"))


@query(_flip_sql(2000))
def paired_sign_flip(spark, sf_dir):
    """A sample of paired_sign_flip_whole: its first flips."""
    return evaluation.paired_sign_test(differences(spark, sf_dir), "cls_id", 2000).withColumn("observed", F.round("observed", 9))


@query(_flip_sql(ALL_FLIPS))
def paired_sign_flip_whole(spark, sf_dir):
    """With as many flips as the reference makes."""
    return evaluation.paired_sign_test(differences(spark, sf_dir), "cls_id", ALL_FLIPS).withColumn("observed", F.round("observed", 9))


@query(f"""{BASE_SQL} SELECT bucket, cls_id, count(*) AS n FROM (
  SELECT CASE WHEN gt_id IS NULL THEN 'false_positive' ELSE 'multiple_detection' END AS bucket, cls_id FROM claim WHERE outcome = 'fp'
  UNION ALL SELECT 'missed', cls_id FROM gt WHERE NOT difficult AND gt_id NOT IN (SELECT gt_id FROM claim WHERE outcome = 'tp')) GROUP BY bucket, cls_id""")
def error_buckets(spark, sf_dir):
    return evaluation.error_buckets(det(spark, sf_dir), gt(spark, sf_dir))


SUPPRESSED_SQL = NMS_SQL.format(keys="image_id, cls_id", wkeys="r.image_id, r.cls_id", on="w.image_id = r.image_id AND w.cls_id = r.cls_id", source="clip")
KEPT_SQL = f"""{DET_SQL.replace("det AS (", "every AS (", 1)}, {CLIP_SQL.replace("FROM det", "FROM every")}, {SUPPRESSED_SQL.replace("SELECT image_id, cls_id, unnest", "survivors AS (SELECT unnest").replace(")\nsurvivors", "),\nsurvivors")}),
det AS (SELECT clip.* FROM clip JOIN survivors USING (det_id))"""


@query(f"WITH RECURSIVE {KEPT_SQL}, {GT_SQL}, {PAIRS_SQL}, {BEST_SQL}, {CLAIM_SQL}, {NPOS_SQL}, {CURVE_SQL}, {AP_SQL} SELECT cls_id, npos, round(ap, 9) AS ap FROM aps")
def detect_and_evaluate(spark, sf_dir):
    """The whole chain: clip, suppress, match, average precision."""
    kept = suppression.suppress(clip(det(spark, sf_dir), WIDTH, HEIGHT), ["image_id", "cls_id"])
    return evaluation.ap_per_class(kept, gt(spark, sf_dir)).withColumn("ap", F.round("ap", 9))


LISTED_SQL = f"""{BASE_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY cls_id ORDER BY score DESC, det_id DESC) AS rank FROM det QUALIFY rank <= 2000),
kinds AS (SELECT t.cls_id, t.rank, t.det_id, t.image_id, t.score, b.iou AS overlap, b.gt_id,
  CASE WHEN b.iou IS NULL OR b.iou < 0.5 THEN 'false_positive' WHEN b.difficult THEN 'ignored' WHEN row_number() OVER (PARTITION BY b.gt_id, b.iou >= 0.5 ORDER BY rank) = 1 THEN 'tp' ELSE 'multiple_detection' END AS kind
  FROM top t LEFT JOIN best b ON t.det_id = b.det_id),
claimed AS (SELECT gt_id, det_id AS claimant FROM kinds WHERE kind = 'tp')"""


@query(f"""{LISTED_SQL}, {NPOS_SQL},
r AS (SELECT *, CAST(count(*) FILTER (WHERE kind = 'tp') OVER w AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE kind IN ('false_positive', 'multiple_detection')) OVER w AS BIGINT) AS fp FROM kinds WINDOW w AS (PARTITION BY cls_id ORDER BY rank ROWS UNBOUNDED PRECEDING))
SELECT cls_id, CAST(rank AS INT) AS rank, det_id, image_id, score, kind, round(overlap, 9) AS overlap, r.gt_id, CASE WHEN kind = 'multiple_detection' THEN claimant END AS claimant, round(CAST(tp AS DOUBLE) / npos, 9) AS recall, round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision
FROM r JOIN npos USING (cls_id) LEFT JOIN claimed ON r.gt_id = claimed.gt_id WHERE kind IN ('false_positive', 'multiple_detection') AND coalesce(CAST(tp AS DOUBLE) / npos, 0) <= 0.6""")
def error_listing(spark, sf_dir):
    """The wrong ones among the first 2000 detections of each class."""
    found = evaluation.error_listing(det(spark, sf_dir), gt(spark, sf_dir)).of
    return found.select(*[F.round(c, 9).alias(c) if c in ("overlap", "recall", "precision") else F.col(c) for c in found.columns])


@query(f"""{LISTED_SQL}, near AS (SELECT gt_id, overlap, det_id FROM kinds WHERE gt_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY overlap DESC, rank) = 1)
SELECT g.cls_id, g.image_id, g.gt_id, round(overlap, 9) AS overlap, det_id FROM gt g LEFT JOIN near USING (gt_id) WHERE NOT g.difficult AND g.gt_id NOT IN (SELECT gt_id FROM claimed)""")
def missed_objects(spark, sf_dir):
    """What the first 2000 detections of each class do not claim."""
    return evaluation.error_listing(det(spark, sf_dir), gt(spark, sf_dir)).missed.withColumn("overlap", F.round("overlap", 9))

"""Queries over boxes: selection, ranking, joins, suppression, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.functions.boxes import area, width
from boxlens.operators import matching, ranking, selection, suppression
from boxlens.plans.registry import query
from boxlens.sources import detections
from boxlens.sources.fixtures import CLASSES, CLIP_SQL, DET_SQL, GT_SQL, HEIGHT, WIDTH, det, gt

IOU = """greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1) + 1) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1) + 1)"""
PAIRS_SQL = f"""pairs AS (
  SELECT d.det_id, d.image_id, d.cls_id, d.score, g.gt_id, g.difficult,
    CAST({IOU} AS DOUBLE) / ((d.x2 - d.x1 + 1) * (d.y2 - d.y1 + 1) + (g.x2 - g.x1 + 1) * (g.y2 - g.y1 + 1) - {IOU}) AS iou
  FROM det d JOIN gt g ON d.image_id = g.image_id AND d.cls_id = g.cls_id AND d.x1 <= g.x2 AND g.x1 <= d.x2 AND d.y1 <= g.y2 AND g.y1 <= d.y2)"""
BEST_SQL = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS k FROM pairs) WHERE k = 1)"
CLAIM_SQL = """claim AS (
  SELECT d.det_id, d.image_id, d.cls_id, d.comp, d.score, b.gt_id,
    CASE WHEN b.gt_id IS NULL THEN 'fp' WHEN b.difficult THEN 'ignored'
         WHEN row_number() OVER (PARTITION BY b.gt_id ORDER BY d.score DESC, d.det_id DESC) = 1 THEN 'tp' ELSE 'fp' END AS outcome
  FROM det d LEFT JOIN (SELECT * FROM best WHERE iou >= 0.5) b ON d.det_id = b.det_id)"""


@query(f"WITH {DET_SQL}, {CLIP_SQL} SELECT det_id, x1, y1, x2, y2 FROM clip")
def clip_boxes(spark, sf_dir):
    return selection.clip(det(spark, sf_dir), WIDTH, HEIGHT).select("det_id", "x1", "y1", "x2", "y2")


@query(f"""WITH {GT_SQL}, p AS (SELECT * FROM gt WHERE NOT difficult)
SELECT gt_id, image_id, cls_id, false AS flip, x1, y1, x2, y2, (x2 - x1 + 1) * (y2 - y1 + 1) AS size FROM p
UNION ALL SELECT gt_id, image_id, cls_id, true, 500 - x2 + 1, y1, 500 - x1 + 1, y2, (x2 - x1 + 1) * (y2 - y1 + 1) FROM p""")
def mirror_positives(spark, sf_dir):
    return selection.positives(gt(spark, sf_dir), WIDTH)


@query(f"""WITH {DET_SQL}, {GT_SQL}, images AS (SELECT DISTINCT image_id FROM det), classes AS (SELECT CAST(range AS BIGINT) AS cls_id FROM range(20))
SELECT c.cls_id, i.image_id FROM images i, classes c WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.image_id = i.image_id AND gt.cls_id = c.cls_id)""")
def negative_images(spark, sf_dir):
    return selection.negative_images(det(spark, sf_dir), gt(spark, sf_dir), CLASSES)


@query(f"""WITH {GT_SQL} SELECT image_id, cls_id, count(*) AS n,
  string_agg(gt_id || ':' || x1 || ',' || y1 || ',' || x2 || ',' || y2, ' ' ORDER BY gt_id) AS boxes FROM gt WHERE NOT difficult GROUP BY image_id, cls_id""")
def positive_images(spark, sf_dir):
    shown = F.transform("boxes", lambda b: F.concat(b["gt_id"], F.lit(":"), F.concat_ws(",", b["x1"], b["y1"], b["x2"], b["y2"])))
    return selection.positive_images(gt(spark, sf_dir)).withColumn("boxes", F.array_join(shown, " "))


@query(f"WITH {GT_SQL} SELECT gt_id, (x2 - x1 + 1) * (y2 - y1 + 1) AS size FROM gt WHERE (x2 - x1 + 1) * (y2 - y1 + 1) >= 12.0 * 8 / 2 * (16.0 * 8 / 2)")
def large_positives(spark, sf_dir):
    return selection.large_enough(gt(spark, sf_dir), 12, 16, 8).select("gt_id", area().alias("size"))


@query(f"""WITH {GT_SQL}, c AS (SELECT image_id, min(x1) a, min(y1) b, max(x2) c, max(y2) d, max(x2 - x1 + 1) w, max(y2 - y1 + 1) h FROM gt GROUP BY image_id)
SELECT image_id, greatest(1, a - CAST(round(w / 2.0) AS BIGINT)) AS x1, greatest(1, b - CAST(round(h / 2.0) AS BIGINT)) AS y1,
  c + CAST(round(w / 2.0) AS BIGINT) AS x2, d + CAST(round(h / 2.0) AS BIGINT) AS y2 FROM c""")
def crop_union(spark, sf_dir):
    return selection.crop(gt(spark, sf_dir))


@query(f"WITH {DET_SQL} SELECT * FROM (SELECT image_id, det_id, score, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id DESC) AS INT) AS rank FROM det WHERE score > 0.5) WHERE rank <= 10")
def topk_per_image(spark, sf_dir):
    found = selection.above(det(spark, sf_dir), 0.5).select("image_id", "det_id", "score")
    return ranking.top_k(found, ["image_id"], [F.desc("score"), F.desc("det_id")], 10)


@query(f"WITH {DET_SQL} SELECT cls_id, det_id, score FROM (SELECT *, rank() OVER (PARTITION BY cls_id ORDER BY score DESC) AS r FROM det) WHERE r <= 500")
def topn_with_ties_per_class(spark, sf_dir):
    return ranking.top_with_ties(det(spark, sf_dir).select("cls_id", "det_id", "score"), ["cls_id"], "score", 500)


@query(f"WITH {DET_SQL}, {GT_SQL}, {PAIRS_SQL} SELECT det_id, gt_id, round(iou, 9) AS iou FROM pairs")
def iou_pairs(spark, sf_dir):
    return matching.pairs_of_copies(det(spark, sf_dir), gt(spark, sf_dir))


@query(f"WITH {DET_SQL}, {GT_SQL}, {PAIRS_SQL}, {BEST_SQL} SELECT det_id, gt_id, round(iou, 9) AS iou FROM best")
def best_gt_match(spark, sf_dir):
    return matching.best_match(det(spark, sf_dir), gt(spark, sf_dir)).select("det_id", "gt_id", F.round("iou", 9).alias("iou"))


@query(f"WITH {DET_SQL}, {GT_SQL}, {PAIRS_SQL}, {BEST_SQL}, {CLAIM_SQL} SELECT det_id, CAST(CASE outcome WHEN 'tp' THEN 1 WHEN 'ignored' THEN 1 ELSE -1 END AS INT) AS label FROM claim")
def claim_labels(spark, sf_dir):
    return matching.claim_labels(det(spark, sf_dir), gt(spark, sf_dir))


NMS_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, det_id DESC) AS k, x1 AS a, y1 AS b, x2 AS c, y2 AS d FROM {source}),
walk AS (
  SELECT {keys}, k, [{{'a': a, 'b': b, 'c': c, 'd': d, 'id': det_id}}] AS kept FROM ranked WHERE k = 1
  UNION ALL
  SELECT {wkeys}, r.k, CASE WHEN len(list_filter(w.kept, lambda q:
      CAST(greatest(0, least(q.c, r.c) - greatest(q.a, r.a) + 1) * greatest(0, least(q.d, r.d) - greatest(q.b, r.b) + 1) AS DOUBLE) / ((r.c - r.a + 1) * (r.d - r.b + 1)) > 0.5)) > 0
    THEN w.kept ELSE list_append(w.kept, {{'a': r.a, 'b': r.b, 'c': r.c, 'd': r.d, 'id': r.det_id}}) END
  FROM walk w JOIN ranked r ON {on} AND r.k = w.k + 1),
last AS (SELECT {keys}, arg_max(kept, k) AS kept FROM walk GROUP BY {keys})
SELECT {keys}, unnest(kept).id AS det_id FROM last"""


@query(f"WITH RECURSIVE {DET_SQL}, {CLIP_SQL}, " + NMS_SQL.format(keys="image_id, cls_id", wkeys="r.image_id, r.cls_id", on="w.image_id = r.image_id AND w.cls_id = r.cls_id", source="clip"))
def nms_per_class(spark, sf_dir):
    found = selection.clip(det(spark, sf_dir), WIDTH, HEIGHT).select("image_id", "cls_id", "det_id", "x1", "y1", "x2", "y2", "score")
    return suppression.suppress(found, ["image_id", "cls_id"]).select("image_id", "cls_id", "det_id")


@query(f"WITH RECURSIVE {DET_SQL}, {CLIP_SQL}, top AS (SELECT * FROM clip WHERE score > 1.0), " + NMS_SQL.format(keys="image_id", wkeys="r.image_id", on="w.image_id = r.image_id", source="top"))
def nms_per_image(spark, sf_dir):
    found = selection.clip(selection.above(det(spark, sf_dir), 1.0), WIDTH, HEIGHT).select("image_id", "det_id", "x1", "y1", "x2", "y2", "score")
    return suppression.suppress(found, ["image_id"]).select("image_id", "det_id")


@query(f"""WITH {GT_SQL}, a AS (SELECT gt_id, CAST(y2 - y1 + 1 AS DOUBLE) / (x2 - x1 + 1) AS aspect FROM gt WHERE NOT difficult),
o AS (SELECT aspect, row_number() OVER (ORDER BY aspect) AS k, count(*) OVER () AS n FROM a),
c AS (SELECT min(CASE WHEN k = CAST(ceil(n / 3.0) AS BIGINT) + 1 THEN aspect END) AS c1, min(CASE WHEN k = CAST(ceil(2 * n / 3.0) AS BIGINT) + 1 THEN aspect END) AS c2 FROM o)
SELECT gt_id, CAST(1 + CASE WHEN aspect >= c1 THEN 1 ELSE 0 END + CASE WHEN aspect >= c2 THEN 1 ELSE 0 END AS INT) AS bucket FROM a, c""")
def aspect_split(spark, sf_dir):
    aspects = gt(spark, sf_dir).where(~F.col("difficult")).select("gt_id", ((F.col("y2") - F.col("y1") + 1).cast("double") / width()).alias("aspect"))
    return ranking.quantile_buckets(aspects, "aspect", 3).select("gt_id", "bucket")


@query(f"""WITH {GT_SQL}, h AS (SELECT CAST(floor(ln(CAST(y2 - y1 + 1 AS DOUBLE) / (x2 - x1 + 1)) / 0.1) AS BIGINT) AS bin, count(*) AS n FROM gt WHERE NOT difficult GROUP BY 1),
s AS (SELECT a.bin, sum(b.n * CASE abs(a.bin - b.bin) WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 END) AS w FROM h a JOIN h b ON abs(a.bin - b.bin) <= 2 GROUP BY a.bin)
SELECT bin, CAST(w AS BIGINT) AS weight FROM s ORDER BY w DESC, bin LIMIT 1""")
def aspect_mode(spark, sf_dir):
    """Most frequent log aspect after smoothing with 1 2 4 2 1."""
    bins = gt(spark, sf_dir).where(~F.col("difficult")).groupBy(F.floor(F.log((F.col("y2") - F.col("y1") + 1).cast("double") / width()) / 0.1).alias("bin")).agg(F.count("*").alias("n"))
    spread = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k")) for d, k in ((-2, 1), (-1, 2), (0, 4), (1, 2), (2, 1))])).alias("s")
    smooth = bins.select("bin", "n", spread).groupBy((F.col("bin") + F.col("s.d")).alias("bin")).agg(F.sum(F.col("n") * F.col("s.k")).alias("weight"))
    return smooth.join(bins.select("bin"), "bin", "left_semi").orderBy(F.desc("weight"), "bin").limit(1)


@query(f"""WITH {GT_SQL}, o AS (SELECT (x2 - x1 + 1) * (y2 - y1 + 1) AS area, row_number() OVER (ORDER BY (x2 - x1 + 1) * (y2 - y1 + 1)) AS k, count(*) OVER () AS n FROM gt WHERE NOT difficult)
SELECT greatest(3000.0::DOUBLE, least(5000.0::DOUBLE, max(CAST(area AS DOUBLE)))) AS value FROM o WHERE k = greatest(1, CAST(floor(0.2 * n) AS BIGINT))""")
def area_p20(spark, sf_dir):
    return ranking.floor_element(gt(spark, sf_dir).where(~F.col("difficult")).select("gt_id", area().alias("area")), "area", "gt_id", 0.2, 3000.0, 5000.0)


@query(f"WITH {DET_SQL} SELECT cls_id, quantile_disc(score, 0.05) AS threshold FROM det GROUP BY cls_id")
def threshold_p5(spark, sf_dir):
    return ranking.low_percentile(det(spark, sf_dir), ["cls_id"], "score", 0.05, "threshold")


@query(f"WITH {DET_SQL} SELECT comp, count(*) AS n FROM det GROUP BY comp")
def component_usage(spark, sf_dir):
    return det(spark, sf_dir).groupBy("comp").agg(F.count("*").alias("n"))


def parts_of(d):
    """Filter boxes of a detection: 0 is its root, 1 to 3 are parts; every fourth is not placed."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("filter_id")
    long = d.select("det_id", "comp", "x1", "y1", "x2", "y2", k)
    gone = (F.col("filter_id") > 0) & (F.pmod(F.col("det_id") + F.col("filter_id"), F.lit(4)) == 0)
    side = lambda c, e: F.when(gone, 0).otherwise(e).cast("long").alias(c)
    return long.select("det_id", "comp", "filter_id", side("x1", F.col("x1") + 5 * F.col("filter_id")), side("y1", F.col("y1") + 3 * F.col("filter_id")), side("x2", F.col("x2") + 2 * F.col("filter_id")), side("y2", F.col("y2") + F.col("filter_id")))


PARTS_SQL = """parts AS (SELECT det_id, comp, f AS filter_id, CASE WHEN gone THEN 0 ELSE x1 + 5 * f END AS x1, CASE WHEN gone THEN 0 ELSE y1 + 3 * f END AS y1,
  CASE WHEN gone THEN 0 ELSE x2 + 2 * f END AS x2, CASE WHEN gone THEN 0 ELSE y2 + f END AS y2
  FROM (SELECT det.*, CAST(range AS BIGINT) AS f, range > 0 AND (det_id + range) % 4 = 0 AS gone FROM det, range(4)))"""


@query(f"WITH {DET_SQL}, {PARTS_SQL} SELECT comp, filter_id, count(*) AS n FROM parts WHERE x1 <> 0 OR y1 <> 0 OR x2 <> 0 OR y2 <> 0 GROUP BY comp, filter_id")
def filter_usage(spark, sf_dir):
    return selection.placed_parts(parts_of(det(spark, sf_dir))).groupBy("comp", "filter_id").agg(F.count("*").alias("n"))


@query(f"WITH {DET_SQL} SELECT printf('%d %.6f %d %d %d %d', image_id, score, x1, y1, x2, y2) AS line FROM det WHERE score > 1.5")
def detections_text(spark, sf_dir):
    return detections.lines(selection.above(det(spark, sf_dir), 1.5), "image_id")


@query(f"WITH {DET_SQL} SELECT image_id, det_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id DESC) AS rank FROM det WHERE score > -1.002) WHERE rank <= 25")
def hard_negatives(spark, sf_dir):
    from boxlens.operators import cache

    return cache.mined_negatives(det(spark, sf_dir), 25).select("image_id", "det_id", "rank")


@query(f"""WITH {DET_SQL}, {GT_SQL}, {PAIRS_SQL}
SELECT det_id, max(CASE WHEN iou < 0.7 THEN -1e9 ELSE score END) AS gated, max(CASE WHEN iou < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS loss FROM pairs GROUP BY det_id""")
def overlap_gate(spark, sf_dir):
    """Minus infinity is shown as -1e9."""
    pairs = matching.box_meetings(det(spark, sf_dir), gt(spark, sf_dir))
    shown = F.greatest(selection.gated(F.col("d_score"), F.col("iou"), 0.7), F.lit(-1e9))
    found = pairs.groupBy(*matching.KEYS, F.col("d_det_id").alias("det_id")).agg(F.max(shown).alias("gated"), F.max(selection.loss(F.col("iou"))).alias("loss"))
    return found.select("det_id", "gated", "loss")

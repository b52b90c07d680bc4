"""Queries over scenes: images that grow in number with the tables, boxes of very different sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlens.operators import mining, spatial
from boxlens.plans.registry import query
from boxlens.sources.fixtures import SCENE_SQL, scene_boxes, scene_windows

BOTH = "greatest(0, least(w.x2, b.x2) - greatest(w.x1, b.x1) + 1) * greatest(0, least(w.y2, b.y2) - greatest(w.y1, b.y1) + 1)"
MEET_SQL = f"""meet AS (
  SELECT w.image_id, window_id, box_id, CAST({BOTH} AS DOUBLE) / ((w.x2 - w.x1 + 1) * (w.y2 - w.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - {BOTH}) AS iou
  FROM windows w JOIN boxes b ON w.image_id = b.image_id AND w.x1 <= b.x2 AND b.x1 <= w.x2 AND w.y1 <= b.y2 AND b.y1 <= w.y2)"""


@query(f"WITH {SCENE_SQL}, {MEET_SQL} SELECT image_id, window_id, box_id, round(iou, 9) AS iou FROM meet")
def window_overlap_tiles(spark, sf_dir):
    """All windows and boxes of an image that meet, found by tiles."""
    found = spatial.overlaps(scene_windows(spark, sf_dir).drop("score"), scene_boxes(spark, sf_dir), ["image_id"])
    return found.select("image_id", F.col("w_window_id").alias("window_id"), F.col("b_box_id").alias("box_id"), F.round("iou", 9).alias("iou"))


@query(f"""WITH {SCENE_SQL}, {MEET_SQL}, best AS (SELECT window_id, box_id, iou FROM meet QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY iou DESC, box_id) = 1)
SELECT window_id, box_id, round(coalesce(iou, 0.0), 9) AS iou FROM windows LEFT JOIN best USING (window_id)""")
def window_best_overlap(spark, sf_dir):
    """Each window's best box."""
    found = spatial.best_overlap(scene_windows(spark, sf_dir), scene_boxes(spark, sf_dir), ["image_id"], "box_id")
    return found.select("window_id", "box_id", F.round("iou", 9).alias("iou"))


#: Examples of a scan, images of a batch, and bytes that the cache may hold.
MOST_EXAMPLES, BATCH, MOST_BYTES = 3000, 64, 2_000_000

WALK_SQL = f"""WITH RECURSIVE {SCENE_SQL}, sized AS (SELECT window_id, image_id, score, 4 * (x2 - x1 + 1) AS byte_size FROM windows),
turns AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS turn FROM (SELECT DISTINCT image_id FROM boxes)),
cand AS (SELECT turn, image_id, list(window_id ORDER BY score DESC, window_id DESC) FILTER (WHERE score > -1.002) AS ids, list(upto ORDER BY score DESC, window_id DESC) FILTER (WHERE score > -1.002) AS upto
  FROM turns LEFT JOIN (SELECT *, CAST(sum(byte_size) FILTER (WHERE score > -1.002) OVER (PARTITION BY image_id ORDER BY score DESC, window_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM sized) USING (image_id) GROUP BY turn, image_id),
n AS (SELECT count(*) AS n FROM turns),
walk(call, k, place, used, bytes, quota, take, turn, stop) AS (
  SELECT 1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false
  UNION ALL
  SELECT s.call, s.k + 1, s.place, s.used + t.take, s.bytes + coalesce(s.upto[t.take], 0), s.quota, t.take, s.turn, s.bytes + coalesce(s.upto[t.take], 0) >= {MOST_BYTES} OR s.used + t.take >= {MOST_EXAMPLES}
  FROM (SELECT w.*, c.upto, CASE WHEN w.k % {BATCH} = 0 THEN CAST(ceil(({MOST_EXAMPLES} - w.used) / least({BATCH}, w.n - w.k)::DOUBLE) AS BIGINT) ELSE w.was END AS quota, c.turn
        FROM (SELECT call + CASE WHEN stop OR k = n THEN 1 ELSE 0 END AS call, CASE WHEN stop OR k = n THEN 0 ELSE k END AS k, CASE WHEN stop OR k = n THEN (place + k) % n ELSE place END AS place,
                     CASE WHEN stop OR k = n THEN 0 ELSE used END AS used, bytes, quota AS was, n FROM walk, n) w
        JOIN cand c ON c.turn = (w.place + w.k) % w.n WHERE w.call <= 2) s,
    LATERAL (SELECT least(len(coalesce(s.upto, [])), s.quota, {MOST_EXAMPLES} - s.used) AS most) m,
    LATERAL (SELECT CAST(least(m.most, 1 + len(list_filter(coalesce(s.upto, []), lambda b: s.bytes + b < {MOST_BYTES}))) AS BIGINT) AS take) t)"""


@query(f"{WALK_SQL} SELECT CAST(call AS INT) AS call, image_id, unnest(ids[1:take]) AS window_id, k - 1 AS step FROM walk JOIN cand USING (turn) WHERE take > 0")
def mining_scans(spark, sf_dir):
    """Two scans, the second from where the first one stopped."""
    images = scene_boxes(spark, sf_dir).select("image_id")
    windows = scene_windows(spark, sf_dir).select(F.col("window_id").alias("det_id"), "image_id", "score", (4 * (F.col("x2") - F.col("x1") + 1)).alias("byte_size"))
    miner = mining.HardNegatives(images, windows, MOST_EXAMPLES)
    first, place = miner.scan(mining.Place(), MOST_BYTES, BATCH)
    second, _ = miner.scan(place, MOST_BYTES, BATCH)
    of = lambda df, k: df.select(F.lit(k).alias("call"), "image_id", F.col("det_id").alias("window_id"), "step")
    return of(first, 1).unionByName(of(second, 2))

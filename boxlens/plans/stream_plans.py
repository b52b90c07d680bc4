"""Queries that run as streams over what is there. An extension."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boxlens.operators.matching import best_match
from boxlens.plans.detection_plans import BEST_SQL, PAIRS_SQL
from boxlens.plans.registry import query
from boxlens.sources.fixtures import DET_SQL, GT_SQL, det, gt, read
from boxlens.streaming import claims, detections
from boxlens.tables import Workspace


def _scratch(spark) -> str:
    """In the folder that the cluster shares; gone when the application ends."""
    return Workspace(spark, f"stream-{uuid.uuid4().hex}").root


def _finished(spark, sf_dir, build):
    schema = read(spark, sf_dir, "events").schema
    root = _scratch(spark)
    files = detections.read_files(spark, f"{sf_dir}/event[s].parquet", schema)  # a pattern: the source takes a single file only so
    stream = files.withColumn("ts", F.col("ts").cast("timestamp"))
    detections.run_to_table(build(stream), f"{root}/out", f"{root}/checkpoint")
    found = spark.read.parquet(f"{root}/out")
    return found.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in found.dtypes])


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    return _finished(spark, sf_dir, lambda s: detections.windowed_counts(s, "ts", ["event_type"], "1 day"))


@query("""WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, before ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return _finished(spark, sf_dir, lambda s: detections.sessions(s, "ts", "user_id", "6 hours"))


#: Detections of one event's time.
EACH = 6
#: Rows of a stream that share state, in the mean.
ROWS_A_PART = 50_000


@query(f"""WITH {DET_SQL}, {GT_SQL}, {PAIRS_SQL}, {BEST_SQL},
m AS (SELECT b.gt_id, b.det_id, b.score, b.difficult, CAST(date_trunc('day', e.ts) AS TIMESTAMP) AS span FROM best b JOIN events e ON e.event_id = (b.det_id - 1) // {EACH} WHERE b.iou >= 0.5)
SELECT gt_id, span, det_id, CASE WHEN difficult THEN 'ignored' WHEN place = 1 THEN 'tp' ELSE 'fp' END AS outcome, place FROM (SELECT *, row_number() OVER (PARTITION BY gt_id, span ORDER BY score DESC, det_id DESC) AS place FROM m)""")
def stream_claims(spark, sf_dir):
    """Matched detections at the time of an event each, as a stream: who claims an object on each day. A last row from far ahead moves the watermark past all days."""
    root, times = _scratch(spark), read(spark, sf_dir, "events").select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    matched = best_match(det(spark, sf_dir), gt(spark, sf_dir), 0.5).select("gt_id", "det_id", "score", "difficult", F.floor((F.col("det_id") - 1) / EACH).alias("event_id"))
    rows = matched.join(times, "event_id").select("gt_id", "det_id", "score", "difficult", "ts")
    rows.write.parquet(f"{root}/in/rows")
    last = spark.range(1).select(F.lit(-1).cast("long").alias("gt_id"), F.lit(-1).cast("long").alias("det_id"), F.lit(0.0).alias("score"), F.lit(False).alias("difficult"), F.to_timestamp(F.lit("2100-01-01")).alias("ts"))
    last.write.parquet(f"{root}/in/end")
    n = spark.read.parquet(f"{root}/in/rows").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days")).first()
    parts = max(claims.PARTS, -(-n["n"] // (ROWS_A_PART * max(1, n["days"]))))
    with claims.state_in_rocks(spark):
        # files come in no order, so the watermark stays behind all that the table spans
        stream = claims.claim_stream(detections.read_files(spark, f"{root}/in/*", rows.schema), "day", 86400, "400 days", parts)
        detections.run_available(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").withColumn("span", F.col("span").cast("timestamp_ntz"))

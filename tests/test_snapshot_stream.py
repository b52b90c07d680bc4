"""Snapshots of a cache as a data source, and claims over a stream."""

import datetime as dt
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlens.sources import snapshot
from boxlens.streaming import claims, detections


def records(spark, n, first=0):
    rows = spark.range(first, first + n).selectExpr(
        "cast(id as int) dataid", "cast(id % 3 as int) scale", "cast(-id as int) x", "7 y", "if(id % 4 = 0, array(), array(1, cast(id as int))) bls", "if(id % 4 = 0, array(), transform(sequence(0, cast(id % 5 as int)), k -> cast(k * id as float))) feat",
        "true is_unique", "id * 0.5D score", "0.0D norm", "id % 4 = 0 is_zero", "id % 2 = 0 is_belief", "id % 3 = 0 is_mined", "1.5D loss",
    )
    return rows


def parts(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-"))


def test_snapshot_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "GROUP", 10)
    snapshot.register(spark)
    path = str(tmp_path / "s")
    records(spark, 100).coalesce(2).write.format("feature_snapshot").mode("append").save(path)
    records(spark, 20, 100).coalesce(1).write.format("feature_snapshot").mode("append").save(path)
    got = {r["dataid"]: r for r in spark.read.format("feature_snapshot").load(path).collect()}
    want = {r["dataid"]: r for r in records(spark, 120).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        for c in set(got[k].__fields__) - {"norm"}:
            assert r[c] == want[k][c], (k, c)
        assert r["norm"] == pytest.approx(sum(v * v for v in want[k]["feat"]) ** 0.5)
    records(spark, 3).write.format("feature_snapshot").mode("overwrite").save(path)
    assert spark.read.format("feature_snapshot").load(path).count() == 3


def test_snapshot_groups_are_read_apart(spark, tmp_path):
    """Filters on dataid leave only the groups that can hold it; each group is a partition."""
    path = str(tmp_path / "s")
    snapshot.register(spark)
    held = snapshot.GROUP
    try:
        snapshot.GROUP = 4096
        records(spark, 10_000).coalesce(1).sortWithinPartitions("dataid").write.format("feature_snapshot").mode("append").save(path)
    finally:
        snapshot.GROUP = held
    assert len(snapshot.Reader(path).partitions()) == 3
    reader = snapshot.FilteringReader(path)
    left = list(reader.pushFilters([snapshot.GreaterThanOrEqual(("dataid",), 9000), snapshot.LessThan(("dataid",), 9010), snapshot.EqualTo(("x",), 1)]))
    assert len(left) == 3 and [g.offset > 0 for g in reader.partitions()] == [True]
    for condition, n in (("dataid = 5", 1), ("dataid > 4000 and dataid <= 4200", 200), ("dataid in (1, 9999)", 2), ("dataid is null", 0), ("scale = 1", 3333)):
        assert snapshot.load(spark, path, condition).count() == n
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"


def test_snapshot_batches_are_records(spark, monkeypatch):
    """Batches are packed and unpacked as their records are, also a few bytes at a time; a reader of many groups takes several at once."""
    monkeypatch.setattr(snapshot, "PLACED", 40)
    rows = [r.asDict() for r in records(spark, 60).collect()]
    batch = pa.RecordBatch.from_pylist([*rows, rows[1] | {"bls": None}, rows[2] | {"feat": None}], schema=snapshot.ARROW)
    data = snapshot.pack_all(batch)
    assert data == b"".join(map(snapshot.pack, batch.to_pylist())) and snapshot.pack_all(batch.slice(7, 9)) == b"".join(map(snapshot.pack, batch.slice(7, 9).to_pylist()))
    assert [tuple(r.values()) for r in snapshot.unpack_all(data).to_pylist()] == list(snapshot.unpack(data))
    assert snapshot.unpack_all(b"").num_rows == 0 and snapshot.pack_all(batch.slice(0, 0)) == b""


def test_many_groups_are_few_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "GROUP", 10)
    monkeypatch.setattr(snapshot, "PARTITIONS", 3)
    path, writer = str(tmp_path / "s"), snapshot.Writer(str(tmp_path / "s"), False)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in records(spark, 95).collect()], schema=snapshot.ARROW)
    writer.commit([writer.write(iter([batch.slice(0, 33), batch.slice(33)]))])
    reader = snapshot.Reader(path)
    assert [len(p.groups) for p in reader.partitions()] == [4, 4, 2]
    assert [i for p in reader.partitions() for b in reader.read(p) for i in b["dataid"].to_pylist()] == list(range(95))


@pytest.mark.parametrize("place,value", [(16, 255), (24, 7), (70, None)])
def test_damaged_records_are_named(spark, tmp_path, place, value):
    path = str(tmp_path / "s")
    snapshot.register(spark)
    records(spark, 40, 1).coalesce(1).sortWithinPartitions("dataid").write.format("feature_snapshot").mode("append").save(path)
    file = f"{path}/{parts(path)[0]}"
    with open(file, "rb") as f:
        data = bytearray(f.read())
    if value is None:
        at = place
        data[at] ^= 0x55
    else:
        at = next(o for o in range(len(data)) if data[o : o + 4] == (2).to_bytes(4, "little") and o > 20)  # the second record's key
        data[at + place] = value
    with open(file, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match=r"part-\w+: damaged (record|group) at offset \d+"):
        spark.read.format("feature_snapshot").load(path).collect()
    assert all(snapshot.pack(dict(zip(("dataid", "scale", "x", "y", "bls", "feat", "is_unique", "score", "norm", "is_zero", "is_belief", "is_mined", "loss"), r, strict=True))) for r in snapshot.unpack(snapshot.pack(records(spark, 1, 1).first().asDict())))


def test_failed_writes_leave_a_snapshot_as_it_was(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshot.register(spark)
    records(spark, 10).write.format("feature_snapshot").mode("append").save(path)
    bad = records(spark, 5000, 20).withColumn("score", F.when(F.col("dataid") > 4900, F.expr("assert_true(false)").cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("feature_snapshot").mode("append").save(path)
    assert spark.read.format("feature_snapshot").load(path).count() == 10
    records(spark, 0).write.format("feature_snapshot").mode("append").save(path)
    assert spark.read.format("feature_snapshot").load(path).count() == 10


def test_claims_change_hands_until_the_watermark(spark, tmp_path):
    """A better detection that comes late, but in time, takes the claim; a row after the span's end was passed is dropped; each outcome goes out once."""
    schema = "gt_id long, det_id long, score double, difficult boolean, ts timestamp"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [(1, 10, 0.5, False, at(1)), (2, 20, 0.1, True, at(2)), (3, 30, 1.0, False, at(5)), (3, 31, 1.0, False, at(5))],
        [(1, 11, 0.9, False, at(3)), (1, 10, 0.5, False, at(1))],
        [(1, 12, 0.2, False, at(27))],
        [(1, 14, 0.3, False, at(28))],
        [(1, 13, 2.0, False, at(4))],
        [(-1, -1, 0.0, False, at(9999))],
    ]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with claims.state_in_rocks(spark):
        stream = claims.claim_stream(detections.read_files(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, 1), "day", 86400, "2 hours")
        detections.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = sorted((r["gt_id"], r["span"].day, r["det_id"], r["outcome"], r["place"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 1, 10, "fp", 2), (1, 1, 11, "tp", 1), (1, 2, 12, "fp", 2), (1, 2, 14, "tp", 1), (2, 1, 20, "ignored", 1), (3, 1, 30, "fp", 2), (3, 1, 31, "tp", 1)]


def test_objects_of_a_span_share_state(spark, tmp_path):
    """There are as many timers as spans and parts, however many objects; outcomes are each object's own."""
    day = dt.datetime(2024, 1, 1)
    rows = [(g, 10 * g + k, float((g * 7 + k * 5) % 4), (g + k) % 5 == 0, day + dt.timedelta(hours=30 * (g % 2) + k)) for g in range(200) for k in range(3)]
    spark.createDataFrame([*rows, rows[0]], "gt_id long, det_id long, score double, difficult boolean, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    time.sleep(0.05)
    spark.createDataFrame([(-1, -1, 0.0, False, day + dt.timedelta(days=900))], "gt_id long, det_id long, score double, difficult boolean, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    with claims.state_in_rocks(spark):
        stream = claims.claim_stream(detections.read_files(spark, f"{tmp_path}/in/*", schema, 1), "day", 86400, "400 days", 4)
        run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    timers = max(int(o["customMetrics"].get("numRegisteredTimers", 0)) for p in run.recentProgress for o in p["stateOperators"])
    assert 0 < timers <= 8
    want = []
    for g in range(200):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], -r[1]))
        want += [(g, r[1], "ignored" if r[3] else "tp" if k == 0 else "fp", k + 1) for k, r in enumerate(own)]
    got = [(r["gt_id"], r["det_id"], r["outcome"], r["place"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want)

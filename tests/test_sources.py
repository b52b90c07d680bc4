import pytest
from pyspark.sql import functions as F

from boxlens.sources import detections, fixtures
from boxlens.streaming import detections as streams

SF = "/root/testdata/sf0.001"


def test_text_round_trip(spark, tmp_path):
    d = fixtures.det(spark, SF).where("score > 1.9")
    detections.write_text(d, "image_id", str(tmp_path / "out"))
    back = detections.read_text(spark, str(tmp_path / "out"))
    want = sorted((str(r["image_id"]), r["score"], r["x1"]) for r in d.collect())
    assert sorted((r["image_id"], r["score"], int(r["x1"])) for r in back.collect()) == want
    moved = d.limit(1).withColumn("x1", F.lit(1.25))
    assert " 1.250000 " in detections.lines(moved, "image_id").first()["line"]


def test_image_sets_and_annotations(spark, tmp_path):
    (tmp_path / "set.txt").write_text("000001\n000007  \n\n")
    (tmp_path / "flag.txt").write_text("000001 -1\n000007  1\n")
    assert [r[0] for r in detections.read_image_set(spark, str(tmp_path / "set.txt")).collect()] == ["000001", "000007"]
    assert [tuple(r) for r in detections.read_labelled_set(spark, str(tmp_path / "flag.txt")).collect()] == [("000001", -1), ("000007", 1)]
    (tmp_path / "a.xml").write_text("<annotation><filename>1.jpg</filename><size><width>50</width><height>40</height></size><object><name>car</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>30</xmax><ymax>20</ymax></bndbox></object><object><name>cat</name><bndbox><xmin>5</xmin><ymin>5</ymin><xmax>9</xmax><ymax>9</ymax></bndbox></object></annotation>")
    image, gt = detections.read_annotations(spark, str(tmp_path / "a.xml"))
    assert [tuple(r) for r in image.collect()] == [("1.jpg", 50, 40)]
    assert [(r["cls"], r["x2"], r["difficult"], r["truncated"]) for r in gt.collect()] == [("car", 30.0, True, False), ("cat", 9.0, False, False)]


def test_load_or_compute(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert detections.load_or_compute(spark, str(tmp_path), "t", {"a": 1}, compute).count() == 3
    detections.load_or_compute(spark, str(tmp_path), "t", {"a": 2}, compute)
    assert len(calls) == 2


@pytest.mark.parametrize("sf,rows,x1,y1,x2,y2", [("0.001", 6000, 1311582, 1129653, 1882353, 1685721), ("0.01", 60000, 14392531, 10756702, 20104936, 16308361)])
def test_fixture_sums(spark, sf, rows, x1, y1, x2, y2):
    r = fixtures.det(spark, f"/root/testdata/sf{sf}").agg(F.count("*"), F.sum("x1"), F.sum("y1"), F.sum("x2"), F.sum("y2"), F.countDistinct("det_id")).first()
    assert tuple(r) == (rows, x1, y1, x2, y2, rows)


def test_stream_suppression(spark, tmp_path):
    from boxlens.operators.suppression import suppress

    d = fixtures.det(spark, SF).select("image_id", "cls_id", "det_id", "x1", "y1", "x2", "y2", "score")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), d.schema)
    streams.suppress_each_batch(stream, ["image_id", "cls_id"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted(r["det_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["det_id"] for r in suppress(d, ["image_id", "cls_id"]).collect())


def test_rewritten_table_is_numbered_anew(spark, tmp_path):
    from boxlens.sources import fixtures

    whole = fixtures.read(spark, "/root/testdata/sf0.001", "lineitem")
    for rows in (whole.where("l_linenumber = 1"), whole):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        ids = [r["det_id"] for r in fixtures.det(spark, str(tmp_path)).collect()]
        assert sorted(ids) == list(range(1, rows.count() + 1))


def test_colour_is_kept(spark, tmp_path):
    import struct

    rows = [[(10, 20, 30), (40, 50, 60)], [(70, 80, 90), (100, 110, 120)]]  # red, green, blue
    data = b"".join(b"".join(bytes(p[::-1]) for p in row) + b"\0\0" for row in rows[::-1])
    (tmp_path / "a.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(data), 0, 0, 0, 0) + data)
    got = detections.read_pixels(spark, str(tmp_path)).first()
    assert (got["h"], got["w"]) == (2, 2) and got["pixels"] == [float(v) for row in rows for p in row for v in p]
    assert detections.read_pixels(spark, str(tmp_path), mirrored=True).first()["pixels"][:3] == [40.0, 50.0, 60.0]

"""Text and table sources and sinks of detections, image sets and annotations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(det: DataFrame, image: str) -> DataFrame:
    """A line a detection: image, score with six places, and the sides; whole numbers as such, others with six places."""
    side = lambda c: F.format_string("%d", F.col(c)) if dict(det.dtypes)[c] in ("bigint", "int") else F.format_string("%.6f", F.col(c))
    return det.select(F.concat_ws(" ", F.col(image).cast("string"), F.format_string("%.6f", F.col("score")), *[side(c) for c in ("x1", "y1", "x2", "y2")]).alias("line"))


def write_text(det: DataFrame, image: str, path: str) -> None:
    lines(det, image).write.text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="image_id string, score double, x1 double, y1 double, x2 double, y2 double")


def read_image_set(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; lines without text are none."""
    return spark.read.text(path).select(F.trim("value").alias("image_id")).where("image_id <> ''")


def read_labelled_set(spark: SparkSession, path: str) -> DataFrame:
    """An id and a flag a line, any white space between."""
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("image_id"), parts[1].cast("int").alias("flag"))


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """XML records, an image each, as tables image and gt: sizes, and objects with class, box and flags."""
    schema = "filename string, size struct<width: long, height: long>, object array<struct<name: string, difficult: int, truncated: int, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
    found = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    image = found.select(F.col("filename").alias("image_id"), "size.width", "size.height")
    objects = found.select(F.col("filename").alias("image_id"), F.posexplode("object").alias("pos", "o"))
    box = [F.col(f"o.bndbox.{a}").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))]
    flag = lambda c: F.coalesce(F.col(f"o.{c}") == 1, F.lit(False)).alias(c)
    return image, objects.select("image_id", F.col("pos").cast("long").alias("gt_id"), F.col("o.name").alias("cls"), *box, flag("difficult"), flag("truncated"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Encoded images with their path, for a decoder to run on."""
    return spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("image_id"), "content")


def load_or_compute(spark: SparkSession, root: str, name: str, config: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under the name and a digest of the configuration; computed and written where there is none."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root}/{name}-{digest}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def read_pixels(spark: SparkSession, path: str, mirrored: bool = False) -> DataFrame:
    """Decoded images (image_id, h, w, pixels), undecodable ones left out: grey values row by row, or red, green and blue of each pixel in turn, three times as many. mirrored: left to right."""
    import numpy as np
    import pandas as pd

    found = spark.read.format("image").option("dropInvalid", True).load(path)
    raw = found.select(F.substring_index("image.origin", "/", -1).alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for d in batches:
            rows = []
            for r in d.itertuples(index=False):
                im = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, :3][:, :, ::-1].astype(float)  # stored blue first
                rows.append((r.image_id, r.height, r.width, (im[:, ::-1] if mirrored else im).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "h", "w", "pixels"])

    return raw.mapInPandas(run, "image_id string, h long, w long, pixels array<double>")

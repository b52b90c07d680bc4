"""Reports over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(aps: DataFrame) -> DataFrame:
    """A line a class (ap in percent) and their mean last; classes without a value (null or NaN) are shown as such and not averaged."""
    known = F.when(F.col("ap").isNotNull() & ~F.isnan("ap"), F.col("ap"))
    lines = aps.select(F.lit(0).alias("last"), F.col("cls_id").cast("string").alias("name"), F.round(known * 100, 1).alias("percent"))
    mean = aps.agg(F.round(F.avg(known) * 100, 1).alias("percent")).select(F.lit(1).alias("last"), F.lit("mean").alias("name"), "percent")
    return lines.unionByName(mean).orderBy("last", "name").drop("last")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes both runs have: both values and the difference."""
    return a.select("cls_id", F.col("ap").alias("ap_a")).join(b.select("cls_id", F.col("ap").alias("ap_b")), "cls_id").withColumn("diff", F.col("ap_b") - F.col("ap_a"))

"""Numbering, top-k and cut points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators.running import range_cuts, range_of
from boxlens.tables import written

_BOUNDS: dict[tuple, tuple] = {}


def number_rows(df: DataFrame, order: list[str], name: str, memo: tuple | None = None) -> DataFrame:
    """Row numbers from 1 over the whole table in a total order whose first column is a number, without one task that holds all rows. memo: what names the table and its version, so that its bounds are found once.

    Ranges of the first column (their bounds and counts, a few numbers each, pass through the driver) are numbered apart. Rows
    equal in the first column share a range.
    """
    first = order[0]
    key = memo and (df.sparkSession.sparkContext.applicationId, *memo)
    if not key or key not in _BOUNDS:
        parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        cuts = sorted(set(df.approxQuantile(first, [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
        found = df.groupBy(_bucket(first, cuts).alias("b")).count().collect()
        before, total = {}, 0
        for r in sorted(found, key=lambda r: r["b"]):
            before[r["b"]], total = total, total + r["count"]
        if key:
            _BOUNDS[key] = cuts, before
    cuts, before = _BOUNDS[key] if key else (cuts, before)
    if not before:
        return df.withColumn(name, F.lit(None).cast("long"))
    offset = F.create_map(*[F.lit(x) for b, n in before.items() for x in (int(b), n)])
    bucket = _bucket(first, cuts)
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return df.withColumn("_b", bucket).withColumn(name, (local + offset[F.col("_b")]).cast("long")).drop("_b")


def _bucket(column: str, cuts: list[float]) -> Column:
    """How many cuts are at most the value."""
    if not cuts:
        return F.lit(0)
    # halving steps, as a test of each cut costs more than all else that is done with the row
    held, steps = F.array(*[F.lit(c) for c in cuts]), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, k: at + F.when(F.get(held, at + k - 1) <= F.col(column), k).otherwise(0))


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k of each group in a total order. Spark keeps k a group and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_with_ties(df: DataFrame, keys: list[str], by: str, n: int) -> DataFrame:
    """Rows whose value is at least the group's n-th largest."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    return df.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= n).drop("_r")


def low_percentile(df: DataFrame, keys: list[str], by: str, share: float, name: str) -> DataFrame:
    """Element ceil(share * n), from 1, of the sorted values."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {by})").alias(name))


def _counts_upto(df: DataFrame, by: str) -> tuple[DataFrame, int]:
    """(by, upto): each distinct value and how many rows are at most it; and how many rows there are. Ranges of the values are summed apart; only a number a range, RANGES at most, passes through the driver."""
    counts = written(df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("c")), "counts")
    ranged = counts.withColumn("_range", range_of(by, range_cuts(counts, by), descending=False))
    before, total = {}, 0
    for r in sorted(ranged.groupBy("_range").agg(F.sum("c").alias("c")).collect(), key=lambda r: r["_range"]):
        before[r["_range"]], total = total, total + r["c"]
    inside = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.create_map(*[F.lit(x) for pair in (before or {0: 0}).items() for x in pair])
    return ranged.select(by, (F.sum("c").over(inside) + ahead[F.col("_range")]).alias("upto")), total


def floor_element(df: DataFrame, by: str, tie: str, share: float, low: float, high: float) -> DataFrame:
    """Element floor(share * n) of the sorted values, at least the first, held in [low, high]. One row; nulls do not count."""
    upto, n = _counts_upto(df, by)
    return upto.where(F.col("upto") >= F.greatest(F.floor(F.lit(share) * n), F.lit(1))).agg(F.greatest(F.lit(low), F.least(F.lit(high), F.min(F.col(by).cast("double")))).alias("value"))


def quantile_buckets(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """bucket (from 1) by cut points at elements ceil((i-1) n / buckets) + 1, the last open: equal values share one, unlike ntile. Cut points come from counts per value; a null is in the first."""
    upto, n = _counts_upto(df, by)
    cuts = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(i) * n / buckets) + 1, F.col(by))).alias(f"_cut{i}") for i in range(1, buckets)]
    bounds = upto.agg(*cuts)  # one row
    bucket = F.lit(1)
    for i in range(1, buckets):
        bucket = bucket + F.coalesce((F.col(by) >= F.col(f"_cut{i}")).cast("int"), F.lit(0))
    return df.crossJoin(F.broadcast(bounds)).withColumn("bucket", bucket).drop(*[f"_cut{i}" for i in range(1, buckets)])

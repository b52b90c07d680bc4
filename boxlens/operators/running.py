"""Running sums and maxima over groups that may hold any share of the rows.

A window over a group runs in one task. Here a group's rows are split by ranges of the order column, each range is a
window of its own, and what lies before it is added from a table of one row a group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def range_cuts(df: DataFrame, by: str, ranges: int = RANGES) -> list[float]:
    """Cut points of a number column at equal shares, approximately; exactness does not matter, only that all rows use the same ones."""
    found = df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 500)).first()[0]
    return sorted(set(found or []))


def range_of(by: str, cuts: list[float], descending: bool) -> Column:
    """Number of the range a value is in, in the order's direction. Equal values share one."""
    if not cuts:
        return F.lit(0)
    at_most = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(by)))
    return (F.lit(len(cuts)) - at_most) if descending else at_most


def running(df: DataFrame, keys: list[str], by: str, order: list[Column], cuts: list[float], sums: dict[str, Column], descending: bool = True, number: str | None = None) -> DataFrame:
    """df with, for each row, sums up to it (names of sums) and its number in the group's order. order begins with by, in its direction."""
    ranged = df.withColumn("_range", range_of(by, cuts, descending))
    each = dict(sums) | ({number: F.lit(1)} if number else {})
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in each.items()])
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in each])
    here = ranged
    for n, e in each.items():
        here = here.withColumn(f"_s_{n}", F.sum(e).over(inside))
    joined = here.join(before, [*keys, "_range"])
    return joined.select(*[c for c in df.columns], "_range", *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in each])


def best_from_here(df: DataFrame, keys: list[str], number: str, value: str, name: str) -> DataFrame:
    """Largest value from each row to its group's end. df has the _range that running() gave."""
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(number)).rowsBetween(Window.unboundedPreceding, 0)
    tops = df.groupBy(*keys, "_range").agg(F.max(value).alias("_top"))
    behind = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    after = tops.select(*keys, "_range", F.max("_top").over(behind).alias("_after"))
    here = df.withColumn("_here", F.max(value).over(inside)).join(after, [*keys, "_range"])
    return here.withColumn(name, F.greatest("_here", F.coalesce("_after", F.col("_here")))).drop("_here", "_after")

"""Feature-vector cache: distinct vectors, margins, objective and what to keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlens.operators.running import range_cuts, running
from boxlens.tables import written

KEY = ["dataid", "scale", "x", "y"]
SUPPORT_MARGIN = 1e-4


class FeatureCache:
    """Rows live in a Parquet folder: adding appends, shrinking writes a new snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def save(self, path: str) -> None:
        self.load().write.mode("errorifexists").parquet(path)

    def byte_size(self) -> int:
        return self.load().agg(F.coalesce(F.sum("byte_size"), F.lit(0))).first()[0]

    def shrink(self, keep: DataFrame, path: str) -> FeatureCache:
        """A new cache of the rows whose eid is in keep."""
        self.load().join(keep.select("eid"), "eid", "left_semi").write.mode("errorifexists").parquet(path)
        return FeatureCache(self.spark, path)


def dedupe(rows: DataFrame, vector: list[str]) -> DataFrame:
    """One row of each key and vector: the least eid."""
    return rows.groupBy(*KEY, *vector).agg(F.min("eid").alias("eid"), F.count("*").alias("copies"))


def block_digest(column: str = "blocks") -> Column:
    """Of an entry's blocks, whatever order they were stored in."""
    return F.xxhash64(F.sort_array(column))


def dedupe_vectors(entries: DataFrame, keys: list[str], digest: Callable[[], Column] = block_digest) -> DataFrame:
    """One row (keys, eid, copies, n_blocks, n_values) of each key and feature vector: the least eid.

    entries: keys, eid, blocks (array of bl, f), only blocks that are stored; their order does not matter. Keys and digests are
    shuffled first, without the vectors. Vectors move only for the digests that several entries of a key share, and then they
    are compared as they are: equal digests of different vectors stay apart.
    """
    some = written(entries.select(*keys, "eid", digest().alias("_digest"), F.sort_array("blocks").alias("blocks")), "entries")
    sizes = [F.size("blocks").alias("n_blocks"), F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(b["f"])).alias("n_values")]
    narrow = some.select(*keys, "eid", "_digest", *sizes)
    groups = written(narrow.groupBy(*keys, "_digest").agg(F.count("*").alias("copies"), F.min(F.struct("eid", "n_blocks", "n_values")).alias("e")), "digests")
    alone = groups.where("copies = 1").select(*keys, "e.eid", "copies", "e.n_blocks", "e.n_values")
    shared = some.join(groups.where("copies > 1").select(*keys, "_digest"), [*keys, "_digest"], "left_semi")
    compared = shared.groupBy(*keys, "_digest", "blocks").agg(F.min("eid").alias("eid"), F.count("*").alias("copies"))
    return alone.unionByName(compared.select(*keys, "eid", "copies", *sizes))


def block_store(entries: DataFrame) -> DataFrame:
    """(bl, f, eid, uses): each block's different vectors once, with the least entry that holds it and how many do."""
    each = entries.select("eid", F.explode("blocks").alias("b"))
    return each.groupBy("b.bl", "b.f").agg(F.min("eid").alias("eid"), F.count("*").alias("uses"))


def info_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("is_belief").agg(F.count("*").alias("entries"), F.countDistinct(F.struct(*KEY)).alias("examples"), F.sum("byte_size").cast("long").alias("bytes"))


def margins(rows: DataFrame) -> DataFrame:
    """(eid, margin): how far the belief's score lies above the row's score and loss. rows: eid, keys, is_belief, score, loss."""
    beliefs = rows.where("is_belief = 1").groupBy(*KEY).agg(F.max("score").alias("belief"))
    return rows.where("is_belief = 0").join(beliefs, KEY).select("eid", (F.col("belief") - F.col("score") - F.col("loss")).alias("margin"))


def objective_terms(rows: DataFrame, c: float) -> DataFrame:
    """Loss of each example: c (best of score + loss, less the belief's score), and whether its belief is the zero vector, which makes it background."""
    return rows.groupBy(*KEY).agg(
        (F.lit(c) * (F.max(F.col("score") + F.col("loss")) - F.max(F.when(F.col("is_belief") == 1, F.col("score"))))).alias("term"),
        F.max(F.when(F.col("is_belief") == 1, F.col("is_zero"))).alias("background"),
    )


def hinge_totals(scores: DataFrame, c: float) -> DataFrame:
    """c times the hinge losses of foreground (1 - s) and background (1 + s) rows."""
    fg = F.greatest(F.lit(0.0), 1 - F.col("score"))
    bg = F.greatest(F.lit(0.0), 1 + F.col("score"))
    return scores.groupBy("is_fg").agg((F.lit(c) * F.sum(F.when(F.col("is_fg") == 1, fg).otherwise(bg))).alias("loss"))


def retained(rows: DataFrame, most_bytes: int, most_examples: int) -> DataFrame:
    """Rows (eid) that stay in the cache.

    Everything that was not mined stays. Of the mined rows that are no beliefs, the most violating (least margin) stay until
    half of what the others leave of the capacity is reached: the row that reaches the bytes stays too, examples are counted as
    distinct keys. Support vectors always stay. Beliefs of kept mined examples follow them.
    """
    fixed = rows.where("is_mined = 0")
    mined = rows.where("is_mined = 1 and is_belief = 0")
    used = fixed.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("used_bytes"), F.countDistinct(F.struct(*KEY)).alias("used_examples"))
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy("margin", "eid"))
    ranked = mined.withColumn("_first", (turn == 1).cast("long"))
    ranked = running(ranked, [], "margin", [F.col("margin"), F.col("eid")], range_cuts(mined, "margin"), {"_upto": F.col("byte_size"), "_examples": F.col("_first")}, descending=False)
    room = ranked.withColumn("_bytes", F.col("_upto") - F.col("byte_size")).crossJoin(F.broadcast(used))  # one row
    fits = (F.col("_bytes") < F.greatest(F.lit(0), (F.lit(most_bytes) - F.col("used_bytes")) / 2)) & (F.col("_examples") <= F.greatest(F.lit(0), (F.lit(most_examples) - F.col("used_examples")) / 2))
    kept = room.where(fits | (F.col("margin") <= SUPPORT_MARGIN))
    beliefs = rows.where("is_mined = 1 and is_belief = 1").join(kept.select(*KEY).distinct(), KEY, "left_semi")
    return fixed.select("eid").unionByName(kept.select("eid")).unionByName(beliefs.select("eid"))


def random_negatives(images: DataFrame, per_image: int, span: int, seed: int = 3) -> DataFrame:
    """Windows drawn for each image from a hash of image, draw and seed: the same on any cluster."""
    draw = F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))).alias("draw")
    h = lambda k: F.pmod(F.xxhash64("image_id", "draw", F.lit(seed), F.lit(k)), F.lit(span))
    return images.select("image_id", draw).select("image_id", "draw", h(0).alias("x"), h(1).alias("y"))


def mined_negatives(det: DataFrame, quota: int, threshold: float = -1.002) -> DataFrame:
    """Hard negatives: the best of each image over the threshold, quota at most."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc("det_id"))
    return det.where(F.col("score") > threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)

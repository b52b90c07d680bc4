"""A scan for hard negatives that stops when the cache is full and goes on from there at its next call.

Images come in a fixed order, turned so that the scan begins after the image where the one before ended. They are taken in
batches; at a batch's begin the room left is divided among its images, and that is how many of its best detections an image may
give. So what an image gives depends on what all before it gave. The counts that this needs are walked through in segments,
one row an image of a segment; detections never pass the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators.ranking import number_rows
from boxlens.tables import Workspace, shared_dir

#: Images whose counts the driver holds at once.
SEGMENT = 8192
THRESHOLD = -1.002


@dataclass
class Place:
    """How many images, in their order, lie before the next scan's first; how many bytes the cache holds; and whether the last scan saw every image."""

    position: int = 0
    used_bytes: int = 0
    complete: bool = False

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.position, self.used_bytes, self.complete)], "position long, used_bytes long, complete boolean").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Place:
        return cls(*spark.read.parquet(path).first())


class HardNegatives:
    """Candidates, written once, of which scans take: detections over the threshold, ranked within their image. det: det_id, image_id, score, byte_size; images: image_id, all that are looked at, in order of id."""

    def __init__(self, images: DataFrame, det: DataFrame, most_examples: int, threshold: float = THRESHOLD):
        self.spark, self.work, self.most_examples = images.sparkSession, Workspace(images.sparkSession, "mining"), most_examples
        turns = number_rows(images.select("image_id").distinct(), ["image_id"], "turn").withColumn("turn", F.col("turn") - 1)
        turns = self.work.write(turns, "turns")
        best = Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc("det_id"))
        # no image can give more than a whole scan; Spark keeps that many of an image and task before it shuffles
        ranked = det.where(F.col("score") > threshold).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_examples)
        ranked = ranked.join(turns, "image_id").select("turn", "rank", "image_id", "det_id", "score", "byte_size")
        self.candidates = self.work.write(ranked.repartitionByRange("turn").sortWithinPartitions("turn", "rank"), "candidates")
        counts = turns.select("turn").join(self.candidates.groupBy("turn").agg(F.count("*").alias("n")), "turn", "left").select("turn", F.coalesce("n", F.lit(0)).alias("n"))
        self.counts = self.work.write(counts.repartitionByRange("turn").sortWithinPartitions("turn"), "counts")
        self.images = turns.count()

    def _segments(self, position: int):
        """Ranges of turns in the scan's order, SEGMENT images at most."""
        for begin, end in ((position, self.images), (0, position)):
            for s in range(begin, end, SEGMENT):
                yield s, min(end, s + SEGMENT)

    def _bytes(self, takes: dict[int, int], low: int, high: int) -> dict[int, int]:
        """Bytes of what each image of a segment gives."""
        rows = self.spark.createDataFrame(list(takes.items()), "turn long, take long")
        held = self.candidates.where(F.col("turn").between(low, high)).join(F.broadcast(rows), "turn").where("rank <= take")
        return {r["turn"]: r["b"] for r in held.groupBy("turn").agg(F.sum("byte_size").alias("b")).collect()}

    def _until(self, turn: int, take: int, room: int) -> tuple[int, int]:
        """(examples, bytes) of an image until its bytes reach the room: the example that reaches it still goes in."""
        upto = Window.partitionBy("turn").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # one image
        rows = self.candidates.where((F.col("turn") == turn) & (F.col("rank") <= take)).select("turn", "rank", F.sum("byte_size").over(upto).alias("b"))
        first = rows.where(F.col("b") >= room).orderBy("rank").first()
        return first["rank"], first["b"]

    def scan(self, place: Place, most_bytes: int, batch: int) -> tuple[DataFrame, Place]:
        """(image_id, det_id, score, byte_size, step) of what this scan takes, and where the next one begins. step: the image's number in the scan. Ends after the image with which the examples reach most_examples or the bytes, those held before included, most_bytes."""
        if not self.images:
            return self.candidates.select("image_id", "det_id", "score", "byte_size", F.lit(0).cast("long").alias("step")).limit(0), place
        taken = f"taken-{place.position}-{place.used_bytes}"
        used, held, done, quota, parts = 0, place.used_bytes, 0, 0, []
        for low, high in self._segments(place.position):
            counts = {r["turn"]: r["n"] for r in self.counts.where(F.col("turn").between(low, high - 1)).collect()}
            takes, before = {}, done
            for turn in range(low, high):
                if done % batch == 0:
                    quota = -(-(self.most_examples - used) // min(batch, self.images - done))
                takes[turn] = min(counts[turn], quota, self.most_examples - used)
                used, done = used + takes[turn], done + 1
                if used >= self.most_examples:
                    break
            sizes, full = self._bytes({t: n for t, n in takes.items() if n}, low, high), used >= self.most_examples
            steps = {t: before + k for k, t in enumerate(takes)}
            for turn, n in takes.items():
                size = sizes.get(turn, 0)
                if held + size >= most_bytes:  # also where it was full before: one example goes in before that is seen
                    if n:
                        takes[turn], size = self._until(turn, n, max(most_bytes - held, 0))
                    held, done, full = held + size, steps[turn] + 1, True
                    takes = {t: m for t, m in takes.items() if steps[t] <= steps[turn]}
                    break
                held += size
            rows = [(t, n, steps[t]) for t, n in takes.items() if n]
            parts.append(self.work.write(self.spark.createDataFrame(rows, "turn long, take long, step long"), f"{taken}-{low}"))
            if full:
                break
        takes = parts[0]
        for p in parts[1:]:
            takes = takes.unionByName(p)
        found = self.candidates.join(takes, "turn").where("rank <= take").select("image_id", "det_id", "score", "byte_size", "step")
        return found, Place((place.position + done) % self.images, held, not full)


def default_place(spark) -> str:
    return f"{shared_dir(spark)}/mining-place"

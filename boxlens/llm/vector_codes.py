"""Vector code compression: codebooks by rounds of assignment and update, the nearest entry found by annular norm pruning.

An entry within d of a vector has a norm within d of the vector's. Entries are sorted by norm; of each vector the entry of the
closest norm gives a first best distance, binary search gives the interval of norms that it allows, both ends included, and only
entries of that annulus are evaluated, in whole numbers. As the best distance shrinks, so does the annulus.

Each round is one pass over the vectors. Sums are made in the tasks and added by entry on the executors; the driver gets one row
an entry, PARTS x ENTRIES of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole components are held within it, so that all sums of squares and of rows stay exact in 64 bits. Vectors treated at once.
LARGEST, CHUNK = 1 << 26, 4096
#: Shares in which the rows of one label are joined with its sum.
SALTS = 64


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component, within LARGEST."""
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def bounds(dim: int) -> list[int]:
    """Ends of the parts: equal, or one component longer for the first ones where dim is no multiple of PARTS."""
    size, more = divmod(dim, PARTS)
    return [0, *np.cumsum([size + (k < more) for k in range(PARTS)]).tolist()]


class Annuli:
    """A codebook of one part, sorted by norm; of equal norms the lower index is first."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries * entries).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row the nearest entry's index, of equals the lowest, its squared distance, and how many distances were evaluated in all."""
        own, n = np.sqrt((x * x).sum(axis=1).astype(np.float64)), len(self.norms)
        right = np.searchsorted(self.norms, own)
        left = np.maximum(right - 1, 0)
        right = np.minimum(right, n - 1)
        first = np.where(own - self.norms[left] <= self.norms[right] - own, left, right)
        best = ((x - self.entries[first]) ** 2).sum(axis=1)
        index = self.order[first].copy()
        slack = 1e-9 * (own + self.norms[-1]) + 1e-9  # a norm is off by less
        reach = np.sqrt(best) + slack
        low, high = np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")
        looked = len(x)
        for e in range(int(low.min(initial=n)), int(high.max(initial=0))):
            at = np.flatnonzero((low <= e) & (e < high) & (first != e))
            at = at[np.abs(self.norms[e] - own[at]) <= np.sqrt(best[at]) + slack[at]]
            d = ((x[at] - self.entries[e]) ** 2).sum(axis=1)
            looked += len(at)
            better = (d < best[at]) | ((d == best[at]) & (self.order[e] < index[at]))
            best[at[better]], index[at[better]] = d[better], self.order[e]
        return index, best, looked


def _kept(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.expr("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"))


def _blocks(column: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their whole components) of the rows of that length."""
    size = np.diff(column.offsets.to_numpy())
    at = np.flatnonzero(size == dim)
    for s in range(0, len(at), CHUNK):
        rows = at[s : s + CHUNK]
        yield rows, whole(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), dim)


def first_entries(kept: DataFrame) -> np.ndarray | None:
    """(entries, dim): the vectors of the least vec_ids, ENTRIES of them at most; of equal ids the lesser vector first. Their length is that of the first; those of other lengths are passed over."""
    ordered = kept.select("vec_id", "embedding").withColumn("_dim", F.size("embedding")).orderBy(F.asc_nulls_last("vec_id"), "embedding")
    head = ordered.limit(1).collect()
    if not head:
        return None
    rows = ordered.where(F.col("_dim") == head[0]["_dim"]).limit(ENTRIES).collect()
    return np.array([whole(np.array(r["embedding"], np.float64)) for r in rows]).reshape(len(rows), head[0]["_dim"])


def _sums(kept: DataFrame, books: list[np.ndarray], edge: list[int]) -> list[np.ndarray]:
    """The updated codebooks: each entry is the floored mean of its parts; unused ones stay."""
    width, dim = max(b - a for a, b in zip(edge, edge[1:], strict=False)), edge[-1]
    names = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        total = np.zeros((PARTS, len(books[0]), width + 1), np.int64)
        for b in batches:
            for _, x in _blocks(b.column(0), dim):
                for p in range(PARTS):
                    part = x[:, edge[p] : edge[p + 1]]
                    index, _, _ = annuli[p].nearest(part)
                    np.add.at(total[p], index, np.c_[np.ones(len(x), np.int64), part, np.zeros((len(x), width - part.shape[1]), np.int64)])
        p, e = np.nonzero(total[:, :, 0])
        rows = total[p, e]
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), *(pa.array(rows[:, k]) for k in range(width + 1))], ["part", "entry", "n", *names])

    schema = ", ".join(f"{s} long" for s in ("part", "entry", "n", *names))
    found = arrow_map(kept.select("embedding"), run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    new = [b.copy() for b in books]
    for r in found.collect():  # a row an entry
        part = new[r["part"]]
        part[r["entry"]] = [r[s] // r["n"] for s in names[: part.shape[1]]]
    return new


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], list[int]] | None:
    """(the codebook of each part, ends of the parts); none without kept vectors."""
    kept = _kept(vectors)
    entries = first_entries(kept)
    if entries is None:
        return None
    edge = bounds(entries.shape[1])
    books = [entries[:, a:b].copy() for a, b in zip(edge, edge[1:], strict=False)]
    for _ in range(rounds):
        books = _sums(kept, books, edge)
    return books, edge


def codes(vectors: DataFrame, books: list[np.ndarray], edge: list[int]) -> DataFrame:
    """(vec_id, label, code, error) of every kept row. Vectors of another length than the codebooks' have none: null code and error."""
    dim = edge[-1]
    hexed = np.array([f"{k:02x}" for k in range(len(books[0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        for b in batches:
            code, error = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            for rows, x in _blocks(b.column(2), dim):
                found = [annuli[p].nearest(x[:, edge[p] : edge[p + 1]]) for p in range(PARTS)]
                code[rows] = ["".join(c) for c in np.stack([hexed[i] for i, _, _ in found], axis=1)]
                error[rows] = np.sum([d for _, d, _ in found], axis=0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    label = dict(vectors.dtypes)["label"]
    return arrow_map(_kept(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector has no null and no non-finite component.

    Equal rows and rows of one or a null id stay rows of their own; a null id is after all others among the first entries. Fewer
    rows than ENTRIES give fewer entries. Components of LARGEST / SCALE or more count as that. Vectors of no components have
    code 00 for each part and error 0. label_error leaves out vectors without error. No rows: no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    trained = train(vectors)
    if trained is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books, edge = trained
    found = Workspace(spark, "codes").write(codes(vectors, books, edge), "codes")
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    joined = salted.alias("a").join(totals.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

"""Two clusters that mirror each other: which of a row and its mirror image belongs to the first.

The second centre is the first one's mirror image, so one centre says all: a row is turned if its mirror image lies nearer. As
turning leaves lengths as they are, the cost is the squares' sum less the squared sum of what was chosen over the number of rows.
All restarts are one pass: a pass assigns every row for each restart's centre and sums what was chosen; no row keeps a state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.operators.sums import summed

RESTARTS, PASSES, CHUNK = 25, 50, 2048


def _chosen(x: np.ndarray, centres: np.ndarray, mirror: np.ndarray) -> np.ndarray:
    """(rows, restarts): turned or not. Equal distances: not turned."""
    return x[:, mirror] @ centres.T > x @ centres.T


def _pass(rows: DataFrame, centres: np.ndarray, mirror: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(sums of what each restart chose, rows, sum of squares)."""
    r, dim = centres.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, square = np.zeros((r, dim)), 0, 0.0
        for d in batches:
            for s in range(0, len(d), CHUNK):
                x = np.stack(d["v"].iloc[s : s + CHUNK].to_numpy()).astype(np.float64)
                turned = _chosen(x, centres, mirror).astype(np.float64)
                total += (1 - turned).T @ x + turned.T @ x[:, mirror]
                n, square = n + len(x), square + float((x * x).sum())
        if n:
            yield pd.DataFrame({"a": [[*total.ravel(), float(n), square]]})

    found = summed(rows.mapInPandas(run, "a array<double>"), "a", r * dim + 2)
    return found[:-2].reshape(r, dim), found[-2], found[-1]


def mirrored_split(vectors: DataFrame, key: str, column: str, mirror: list[int], restarts: int = RESTARTS, passes: int = PASSES, seed: int = 3) -> tuple[DataFrame, float]:
    """((key, turned), cost) of the best of the restarts: the sum over both clusters of squared distances from their centres.

    mirror: a permutation that undoes itself. Restarts begin at rows that a hash of key and seed picks; a restart's cost never
    rises, and passes end when no sum changes. Which of the two clusters is the first is settled by the row of the least key,
    which is not turned. Null vectors are left out; no rows: no rows, cost 0.
    """
    mirror = np.asarray(mirror)
    if not (mirror[mirror] == np.arange(len(mirror))).all():
        raise ValueError("a mirror image's mirror image must be the vector itself")
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("v"))
    seeds = rows.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(restarts).collect()
    if not seeds:
        return vectors.select(key, F.lit(False).alias("turned")).limit(0), 0.0
    centres = np.array([r["v"] for r in seeds], np.float64)
    last = None
    for _ in range(passes):
        sums, n, square = _pass(rows, centres, mirror)
        gain = (sums * sums).sum(axis=1)
        if last is not None and (gain <= last * (1 + 1e-12)).all():
            break
        centres, last = sums / n, gain
    best = centres[int(np.argmax(last))]
    first = np.array(rows.orderBy("k").first()["v"], np.float64)
    if _chosen(first[None], best[None], mirror)[0, 0]:
        best = best[mirror]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            x = np.stack(d["v"].to_numpy()).astype(np.float64) if len(d) else np.zeros((0, len(mirror)))
            yield pd.DataFrame({"k": d["k"], "turned": _chosen(x, best[None], mirror)[:, 0]})

    found = rows.mapInPandas(run, f"k {dict(vectors.dtypes)[key]}, turned boolean").withColumnRenamed("k", key)
    return found, float(2 * (square - last.max() / n))

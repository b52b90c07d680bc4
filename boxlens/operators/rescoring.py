"""Box regression and context rescoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.functions.boxes import sigmoid
from boxlens.operators.sums import summed

TARGETS = ("x1", "y1", "x2", "y2")
SCORE_FLOOR = -1.1
LAMBDA = 0.01


def part_features(parts: DataFrame) -> DataFrame:
    """One row a detection: offsets of each part from its root box in root widths and heights (without the last pixel), then 1. parts: det_id, filter_id (0 is the root) and boxes."""
    root = parts.where("filter_id = 0").select("det_id", F.col("x1").alias("rx"), F.col("y1").alias("ry"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    rest = parts.where("filter_id > 0").join(root, "det_id")
    one = F.struct("filter_id", ((F.col("x1") - F.col("rx")).cast("double") / F.col("w")).alias("dx"), ((F.col("y1") - F.col("ry")).cast("double") / F.col("h")).alias("dy"))
    pairs = rest.groupBy("det_id").agg(F.sort_array(F.collect_list(one)).alias("p"))
    flat = F.flatten(F.transform("p", lambda s: F.array(s["dx"], s["dy"])))
    return pairs.select("det_id", F.concat(flat, F.array(F.lit(1.0))).alias("x"))


def solve_plain(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.lstsq(a + ridge * np.eye(len(a)), b, rcond=None)[0]


def solve_sparse(a: np.ndarray, b: np.ndarray, ridge: float, penalty: float = LAMBDA, sweeps: int = 10_000, tolerance: float = 1e-10) -> np.ndarray:
    """Least squares with penalty times the sum of magnitudes, coordinate by coordinate, from the normal equations alone."""
    a, beta = a + ridge * np.eye(len(a)), np.zeros(b.shape)
    for _ in range(sweeps):
        before = beta.copy()
        for j in np.flatnonzero(np.diag(a) > 0):
            rest = b[j] - a[j] @ beta + a[j, j] * beta[j]
            beta[j] = np.sign(rest) * np.maximum(np.abs(rest) - penalty / 2, 0) / a[j, j]
        if np.abs(beta - before).max() <= tolerance * max(1.0, np.abs(beta).max()):
            break
    return beta


#: Of fit_boxes, by name.
METHODS = {"default": solve_plain, "minl2": lambda a, b, ridge: solve_plain(a, b, ridge + LAMBDA), "minl1": solve_sparse}


def fit_boxes(rows: DataFrame, ridge: float = 0.0, method: str = "default") -> DataFrame:
    """(comp, target, beta): least squares of each target for each component from normal equations; by method plain, with squares or with magnitudes of the weights at LAMBDA. rows: comp, x, and the targets t_*. Partial sums are made where rows lie; one small matrix a component and task is shuffled."""
    names = [f"t_{t}" for t in TARGETS]
    if method.lower() not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    solver = METHODS[method.lower()]

    def partial(batches):
        sums: dict = {}
        for d in batches:
            for comp, part in d.groupby("comp"):
                x, y = np.stack(part["x"].to_numpy()), part[names].to_numpy(np.float64)
                a, b = sums.get(comp, (0.0, 0.0))
                sums[comp] = a + x.T @ x, b + x.T @ y
        yield pd.DataFrame([(c, a.ravel().tolist(), b.ravel().tolist()) for c, (a, b) in sums.items()], columns=["comp", "a", "b"])

    def solve(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.sum([np.array(v) for v in d[c]], axis=0) for c in ("a", "b"))
        n = len(b) // len(TARGETS)
        beta = solver(a.reshape(n, n), b.reshape(n, -1), ridge)
        return pd.DataFrame({"comp": key[0], "target": TARGETS, "beta": [beta[:, k].tolist() for k in range(len(TARGETS))]})

    parts = rows.select("comp", "x", *names).mapInPandas(partial, "comp long, a array<double>, b array<double>")
    return parts.groupBy("comp").applyInPandas(solve, "comp long, target string, beta array<double>")


def apply_boxes(det: DataFrame, features: DataFrame, model: DataFrame) -> DataFrame:
    """Boxes moved by the regression: each side by its prediction times the box's width or height. The model is four rows a component."""
    wide = model.groupBy("comp").pivot("target", list(TARGETS)).agg(F.first("beta")).select("comp", *[F.col(t).alias(f"b_{t}") for t in TARGETS])
    joined = det.join(features, "det_id").join(F.broadcast(wide), "comp")
    dot = lambda b: F.aggregate(F.zip_with("x", b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = {"x1": F.col("x2") - F.col("x1"), "x2": F.col("x2") - F.col("x1"), "y1": F.col("y2") - F.col("y1"), "y2": F.col("y2") - F.col("y1")}
    moved = {t: (F.col(t) + dot(f"b_{t}") * size[t]).alias(t) for t in TARGETS}
    return joined.select(*[moved.get(c, F.col(c)) for c in det.columns])


def class_maxima(det: DataFrame, classes: int) -> DataFrame:
    """One row an image: the sigmoid of each class's best score, no less than the floor's."""
    best = det.groupBy("image_id").pivot("cls_id", list(range(classes))).agg(F.max("score"))
    floored = lambda c: F.greatest(F.coalesce(F.col(str(c)), F.lit(SCORE_FLOOR)), F.lit(SCORE_FLOOR))
    return best.select("image_id", *[sigmoid(floored(c)).alias(f"m{c}") for c in range(classes)])


def context_features(det: DataFrame, maxima: DataFrame, w: int, h: int, classes: int) -> DataFrame:
    """x: sigmoid score, four sides over the image's size, then the maxima of its image."""
    own = [sigmoid(F.col("score")), *[F.col(c) / float(w if c[0] == "x" else h) for c in TARGETS]]
    return det.join(maxima, "image_id").select("det_id", F.array(*own, *[F.col(f"m{c}") for c in range(classes)]).alias("x"))


def fit_context(rows: DataFrame, positive_weight: float = 2.0, steps: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """A linear machine over products of features up to the second degree and cubes, in place of a kernel machine of degree 3: weights for (x, label -1 or 1; 0 is left out). Each step is a pass that sums gradients where rows lie."""
    data = rows.where("label <> 0").select("x", "label")
    first = data.select(F.size("x").alias("n")).first()
    if not first:
        return np.zeros(0)
    width = expanded(np.zeros((1, first["n"]))).shape[1]

    def gradient(w):
        def run(batches):
            total, n = np.zeros(width), 0.0
            for d in batches:
                for x, at in matrices(d):
                    y = d["label"].to_numpy(zero_copy_only=False)[at].astype(np.float64)
                    c = np.where(y > 0, positive_weight, 1.0) * np.maximum(0, 1 - y * scored(x, w))
                    total, n = total - weighted(x, c * y), n + len(x)
            if n:
                yield pa.RecordBatch.from_pydict({"g": [[*total.tolist(), float(n)]]}, schema=pa.schema([("g", pa.list_(pa.float64()))]))

        found = summed(data.mapInArrow(run, "g array<double>"), "g", width + 1)
        return found[:-1] / found[-1]

    w = speed = np.zeros(width)
    for _ in range(steps):
        speed = 0.9 * speed - 0.1 * (gradient(w) + ridge * w)
        w = w + speed
    return w


def expanded(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j], x**3], axis=1)


def scored(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """expanded(x) @ w, without its columns: the products are a quadratic form."""
    n = x.shape[1]
    form = np.zeros((n, n))
    form[np.triu_indices(n)] = w[1 + n : -n]
    return w[0] + x @ w[1 : 1 + n] + ((x @ form) * x).sum(axis=1) + (x * x * x) @ w[-n:]


def weighted(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """c @ expanded(x), without its columns."""
    cx = x * c[:, None]
    return np.concatenate([[c.sum()], cx.sum(axis=0), (cx.T @ x)[np.triu_indices(x.shape[1])], (cx * x * x).sum(axis=0)])


#: Rows that are held as a matrix at once.
ROWS = 4096


def matrices(batch: pa.RecordBatch):
    """(x, rows): the vectors of a batch, ROWS at a time, as they lie in Arrow."""
    for s in range(0, batch.num_rows, ROWS):
        held = batch["x"].slice(s, ROWS)
        yield held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1), slice(s, s + len(held))


def rescore(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """(det_id, score) by the trained machine."""

    def run(batches):
        for d in batches:
            score = np.concatenate([np.zeros(0), *(scored(x, w) for x, _ in matrices(d))])
            yield pa.RecordBatch.from_arrays([d["det_id"], pa.array(score)], names=["det_id", "score"])

    return rows.select("det_id", "x").mapInArrow(run, "det_id long, score double")

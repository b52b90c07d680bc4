"""Star cascade: block scores, order of parts, thresholds, staged evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.operators.sums import summed


#: Pairs of a vector and a filter that are held at once.
PAIRS = 1 << 16


def block_scores(weights: DataFrame, features: DataFrame) -> DataFrame:
    """(det_id, block, score): weight times feature, summed by block. Both in long form: (block, idx, w) and (det_id, block, idx, f); weights are the model's."""
    return features.join(F.broadcast(weights), ["block", "idx"]).groupBy("det_id", "block").agg(F.sum(F.col("w") * F.col("f")).alias("score"))


def part_order(scores: DataFrame, parts: list[str]) -> list[str]:
    """Greedy: each time the part whose removal leaves the sum of the rest with the least variance. All variances and covariances come from one pass; the driver gets one row."""
    n = len(parts)
    pairs = [F.covar_samp(parts[i], parts[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    row = scores.agg(*pairs).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    left, order = list(range(n)), []
    while left:
        rest = lambda i: [j for j in left if j != i]
        best = min(left, key=lambda i: (round(float(cov[np.ix_(rest(i), rest(i))].sum()), 9), i))
        order.append(parts[best])
        left.remove(best)
    return order


def stage_thresholds(scores: DataFrame, order: list[str], threshold: float) -> DataFrame:
    """(stage, value): the least partial sum of each stage over examples whose whole score is at least the threshold."""
    whole = sum((F.col(p) for p in order[1:]), F.col(order[0]))
    good = scores.where(whole >= threshold)
    upto, mins = F.lit(0.0), []
    for k, p in enumerate(order):
        upto = upto + F.col(p)
        mins.append(F.min(upto).alias(str(k)))
    stack = ", ".join(f"{k}L, `{k}`" for k in range(len(order)))
    return good.agg(*mins).selectExpr(f"stack({len(order)}, {stack}) AS (stage, value)")


def mixed_thresholds(scores: DataFrame, projected_order: list[str], full_order: list[str], threshold: float, projected_offset: float = 0.0, offset: float = 0.0) -> DataFrame:
    """(stage, value) of a cascade that first places parts by their projected scores, then puts whole scores in their place: the least partial sum of each stage over examples whose whole score is at least the threshold. Columns come in cascade order, each part's deformation before its filter. The sums grow by a projected column a stage until all are in; from then on a window of that many columns slides over both orders. The last stage is the threshold itself. No such example: infinite, so that nothing passes."""
    n = len(projected_order)
    if n != len(full_order):
        raise ValueError("both orders must have the same number of columns")
    whole = sum((F.col(c) for c in full_order), F.lit(offset))
    line, sums = [*projected_order, *full_order], []
    for k in range(2 * n - 1):
        of = line[: k + 1] if k < n else line[k - n + 1 : k + 1]
        sums.append(F.coalesce(F.min(sum((F.col(c) for c in of), F.lit(projected_offset if k < n else offset))), F.lit(float("inf"))).alias(str(k)))
    sums.append(F.when(F.count("*") > 0, F.lit(float(threshold))).otherwise(F.lit(float("inf"))).alias(str(2 * n - 1)))
    stack = ", ".join(f"{k}L, `{k}`" for k in range(2 * n))
    return scores.where(whole >= threshold).agg(*sums).selectExpr(f"stack({2 * n}, {stack}) AS (stage, value)")


def staged(candidates: DataFrame, order: list[str], thresholds: list[float], final: float) -> DataFrame:
    """Candidates that pass every stage, score and the number of parts evaluated for each of the others too: (det_id, score, evaluated, passed). A part is evaluated only for the rows that are left."""

    def run(batches):
        for d in batches:
            parts = d[order].to_numpy(np.float64)
            score, alive, evaluated = np.zeros(len(d)), np.ones(len(d), bool), np.zeros(len(d), np.int64)
            for k, t in enumerate(thresholds):
                at = np.flatnonzero(alive)
                score[at] += parts[at, k]
                evaluated[at] += 1
                alive[at[score[at] < t]] = False
            yield pd.DataFrame({"det_id": d["det_id"], "score": score, "evaluated": evaluated, "passed": alive & (score >= final)})

    return candidates.select("det_id", *order).mapInPandas(run, "det_id long, score double, evaluated long, passed boolean")


def gram(vectors: DataFrame, column: str, dims: int) -> np.ndarray:
    """Mean outer product, not centred: a matrix a task, added on the executors."""

    def run(batches):
        total, n = np.zeros((dims, dims)), 0
        for d in batches:
            if len(d):
                x = np.stack(d[column].to_numpy()).astype(np.float64)
                total, n = total + x.T @ x, n + len(x)
        yield pd.DataFrame({"g": [[*total.ravel(), float(n)]]})

    found = summed(vectors.select(column).mapInPandas(run, "g array<double>"), "g", dims * dims + 1)
    return found[:-1].reshape(dims, dims) / max(1.0, found[-1])


def principal(gram_matrix: np.ndarray, k: int) -> np.ndarray:
    """(dims, k): directions of the most energy, each with its largest part positive."""
    values, vectors = np.linalg.eigh(gram_matrix)
    v = vectors[:, np.argsort(-values, kind="stable")[:k]]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def star_cascade(candidates: DataFrame, costs: np.ndarray, hypothesis: list[float], deformation: list[float], final: float) -> DataFrame:
    """Star models: (det_id, score, evaluated, passed). candidates: det_id, root, and parts, for each part in order its appearance at each place around its anchor; costs: of those places.

    Before each part a candidate whose score is under the part's hypothesis threshold goes; then a place is only looked at if
    the score less its cost reaches the deformation threshold. evaluated counts places looked at. final is met at equality too.
    """

    def run(batches):
        for d in batches:
            n = len(d)
            score, alive, looked = d["root"].to_numpy(np.float64).copy(), np.ones(n, bool), np.zeros(n, np.int64)
            parts = np.array([np.stack(r) for r in d["parts"]]).reshape(n, *costs.shape) if n else np.zeros((0, *costs.shape))
            for k, cost in enumerate(costs):
                alive &= score >= hypothesis[k]
                at = np.flatnonzero(alive)
                open_ = score[at, None] - cost >= deformation[k]
                looked[at] += open_.sum(axis=1)
                score[at] += np.where(open_, parts[at, k] - cost, -np.inf).max(axis=1)
            yield pd.DataFrame({"det_id": d["det_id"], "score": score, "evaluated": looked, "passed": alive & (score >= final)})

    return candidates.select("det_id", "root", "parts").mapInPandas(run, "det_id long, score double, evaluated long, passed boolean")


def projected(levels: DataFrame, basis: np.ndarray) -> DataFrame:
    """Feature levels with each cell projected on a basis (dims, k)."""

    def run(batches):
        for d in batches:
            if len(d):
                d = d.copy()
                d["feat"] = [(np.asarray(f, np.float64).reshape(-1, basis.shape[0]) @ basis).astype(np.float32).ravel().tolist() for f in d["feat"]]
                d["dims"] = basis.shape[1]
            yield d

    return levels.mapInPandas(run, levels.schema)


def low_rank_survivors(vectors: DataFrame, key: str, column: str, filters: dict[int, np.ndarray], thresholds: dict[int, float], basis: np.ndarray, stages: list[int]) -> DataFrame:
    """(key, filter, projected): the pairs whose product with the filter can reach its threshold.

    basis (dims, k): orthonormal directions, those of most energy first. Stage by stage more of them are projected on; what is left
    of a vector and a filter is no longer than the lengths tell, so their product is no more than the projected one and the product
    of what is left. A pair that this bound rules out is not looked at again; none that reaches the threshold is lost.
    """
    names = sorted(filters)
    f = np.array([filters[k] for k in names], np.float64)
    pf, limit = f @ basis, np.array([thresholds[k] for k in names])
    rest = [np.sqrt(np.maximum((f * f).sum(axis=1) - (pf[:, :k] ** 2).sum(axis=1), 0)) for k in stages]
    size = np.sqrt((f * f).sum(axis=1))

    def run(batches):
        step = max(1, PAIRS // max(1, len(f)))
        for d in batches:
            for at in range(0, len(d), step):
                part = d.iloc[at : at + step]
                row, col, value = left(np.stack(part[column].to_numpy()).astype(np.float64))
                yield pd.DataFrame({key: part[key].to_numpy()[row], "filter": np.array(names)[col], "projected": value})

    def left(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        px, square = x @ basis, (x * x).sum(axis=1)
        row, col = np.divmod(np.arange(len(x) * len(f)), len(f))
        value, done = np.zeros(len(row)), 0
        for k, of_filter in zip(stages, rest, strict=True):
            value = value + (px[row, done:k] * pf[col, done:k]).sum(axis=1)
            done = k
            own = np.sqrt(np.maximum(square - (px[:, :k] ** 2).sum(axis=1), 0))
            slack = 1e-9 * np.sqrt(square[row]) * size[col]
            good = np.flatnonzero(value + own[row] * of_filter[col] + slack >= limit[col])
            row, col, value = row[good], col[good], value[good]
        return row, col, value

    return vectors.select(key, column).mapInPandas(run, f"{key} {dict(vectors.dtypes)[key]}, filter long, projected double")


def low_rank_cascade(vectors: DataFrame, key: str, column: str, filters: dict[int, np.ndarray], thresholds: dict[int, float], basis: np.ndarray, stages: list[int]) -> DataFrame:
    """(key, filter, score) of the pairs whose whole product is at least the filter's threshold: projected products for all, whole ones for what the bounds leave. Filters and directions are the model's, so bounded."""
    names = sorted(filters)
    left = low_rank_survivors(vectors, key, column, filters, thresholds, basis, stages)
    whole = vectors.select(key, column).join(left.select(key, "filter"), key)

    def run(batches):
        for d in batches:
            if len(d):
                x, at = np.stack(d[column].to_numpy()).astype(np.float64), d["filter"].to_numpy()
                score = (x * np.array([filters[k] for k in names], np.float64)[np.searchsorted(names, at)]).sum(axis=1)
                good = score >= np.array([thresholds[k] for k in names])[np.searchsorted(names, at)]
                yield pd.DataFrame({key: d[key], "filter": at, "score": score})[good]

    return whole.mapInPandas(run, f"{key} {dict(vectors.dtypes)[key]}, filter long, score double")

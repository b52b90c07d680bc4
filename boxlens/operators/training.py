"""Training: objective over a distributed cache, bounded L-BFGS on the driver, the outer loop."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.operators.sums import summed

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def lbfgs(objective: Objective, start: np.ndarray, lower: np.ndarray | None = None, iterations: int = 1000, tolerance: float = 1e-6, memory: int = 100) -> tuple[np.ndarray, float, int]:
    """Least value over w >= lower: two-loop recursion over the coordinates that are free, projected steps, cubic backtracking. Stops when the free gradient or the change is within tolerance."""
    lower = np.full(len(start), -np.inf) if lower is None else lower
    w = np.maximum(np.asarray(start, float), lower)
    value, g = objective(w)
    pairs: deque = deque(maxlen=memory)
    for turn in range(iterations):
        free = ~((w <= lower) & (g >= 0))
        if not free.any() or np.abs(g[free]).max() <= tolerance:
            return w, value, turn
        d, alphas = np.where(free, -g, 0.0), []
        usable = [(s[free], y[free]) for s, y in pairs]
        usable = [(s, y) for s, y in usable if s @ y > 1e-10]
        q = d[free]
        for s, y in reversed(usable):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q = q - a * y
        if usable:
            s, y = usable[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y), a in zip(usable, reversed(alphas), strict=True):
            q = q + s * (a - (y @ q) / (s @ y))
        d[free] = q
        if g @ d > -1e-12 * abs(value):
            d = np.where(free, -g, 0.0)
        step = 1.0 if usable else min(1.0, 1.0 / max(1e-12, np.abs(g[free]).sum()))
        slope = g @ d
        for _ in range(40):
            new = np.maximum(w + step * d, lower)
            new_value, new_g = objective(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * (g @ (new - w)):
                break
            # the cubic through both values and slopes, kept between a tenth and a half of the step
            new_slope = new_g @ d
            r = slope + new_slope - 3 * (value - new_value) / (0 - step) if np.isfinite(new_value) else np.nan
            root = r * r - slope * new_slope
            guess = step - step * (new_slope + np.sqrt(root) - r) / (new_slope - slope + 2 * np.sqrt(root)) if np.isfinite(root) and root >= 0 else np.nan
            step = float(np.clip(guess, 0.1 * step, 0.5 * step)) if np.isfinite(guess) else 0.5 * step
        else:
            return w, value, turn
        change = new - w
        pairs.append((change, new_g - g))
        done = np.abs(change).max() <= tolerance * 1e-3 or abs(new_value - value) <= tolerance * 1e-3 * max(1.0, abs(value))
        w, value, g = new, new_value, new_g
        if done:
            return w, value, turn + 1
    return w, value, iterations


def latent_objective(cache: DataFrame, c: float, regularisation: np.ndarray) -> Objective:
    """c times the sum over examples of (best of score + loss, less the belief's score), and half the squared weights. cache: example_id, is_belief, loss, x. Its rows are dealt and sorted by example and kept until the objective's release() is called; each call is one pass that holds a batch and the example left open by the one before; gradients are added on the executors."""
    grouped = cache.select("example_id", "is_belief", "loss", "x").repartition("example_id").sortWithinPartitions("example_id").persist()

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches):
            value, g = 0.0, np.zeros(len(w))
            last, raised, top = None, 0.0, None  # the open example, its best score and that row
            for b in batches:
                if not b.num_rows:
                    continue
                x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(w))
                ids, belief, loss = (b[c].to_numpy(zero_copy_only=False) for c in ("example_id", "is_belief", "loss"))
                score, belief = x @ w, belief.astype(bool)
                value, g = value - float(score[belief].sum()), g - belief @ x
                lossy = np.where(belief, score, score + loss)
                order = np.lexsort((-lossy, ids))
                best = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]  # of each example, which come in order
                if top is not None and ids[best[0]] == last:
                    if lossy[best[0]] <= raised:
                        best = best[1:]
                    else:
                        top = None
                if len(best):
                    if top is not None:
                        value, g = value + raised, g + top
                    value, g = value + float(lossy[best[:-1]].sum()), g + x[best[:-1]].sum(axis=0)
                    last, raised, top = ids[best[-1]], float(lossy[best[-1]]), x[best[-1]].copy()
            if top is not None:
                yield pa.RecordBatch.from_pydict({"a": [[value + raised, *(g + top)]]})

        found = summed(grouped.mapInArrow(run, "a array<double>"), "a", len(w) + 1)
        return 0.5 * float((regularisation * w * w).sum()) + c * found[0], regularisation * w + c * found[1:]

    objective.release = grouped.unpersist
    return objective


def softmax_regulariser(component_norms: np.ndarray, beta: float = 1000.0) -> tuple[float, np.ndarray]:
    """A smooth largest of half the components' squared norms, and each one's share."""
    half = 0.5 * component_norms
    top = half.max()
    e = np.exp(beta * (half - top))
    return float(top + np.log(e.sum()) / beta), e / e.sum()


def converged(full: float, cached: float, ratio: float = 1.05) -> bool:
    return full / cached < ratio if cached > 0 else full <= 0


def _only(objective: Objective, learns: np.ndarray) -> Objective:
    def of_these(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = objective(w)
        return value, np.where(learns, g, 0.0)

    return of_these


def train(initial: np.ndarray, relabel: Callable[[np.ndarray], DataFrame], mine: Callable[[np.ndarray], DataFrame], keep: Callable[[DataFrame, np.ndarray], DataFrame], c: float, regularisation: np.ndarray, rounds: int = 8, mining: int = 5, path: str | None = None, lower: np.ndarray | None = None, learns: np.ndarray | None = None, inner: int = 1000, log: list | None = None) -> np.ndarray:
    """Relabel, mine, optimise, evict. Rows of relabel and mine: example_id, is_belief, loss, x. Each cache is written, so that no plan reaches back over rounds. Each solve begins where the one before ended and takes inner steps at most. Weights stay at lower or more; those that do not learn stay as they are. log gets (round, step, value on the cache, value with all that is mined now) of each solve."""
    w, last = initial, np.inf
    for turn in range(rounds):
        cache = relabel(w)
        for step in range(mining):
            cache = keep(cache, w).unionByName(mine(w)).distinct()
            if path:
                cache.write.mode("overwrite").parquet(f"{path}/{turn}-{step}")
                cache = cache.sparkSession.read.parquet(f"{path}/{turn}-{step}")
            held = latent_objective(cache, c, regularisation)
            w, value, _ = lbfgs(held if learns is None else _only(held, learns), w, lower, inner)
            held.release()
            mined = latent_objective(cache.unionByName(mine(w)).distinct(), c, regularisation)
            full, _ = mined(w)
            mined.release()
            if log is not None:
                log.append((turn, step, value, full))
            if converged(full, value):
                break
        if value / last > 0.999 if np.isfinite(last) else False:
            break
        last = value
    return w


def split_aspects(aspects: np.ndarray, groups: int) -> np.ndarray:
    """Group (from 0) of each aspect by cut points at equal shares; equal aspects share a group."""
    order, n = np.sort(aspects), len(aspects)
    cuts = [order[min(n - 1, int(np.ceil(i * n / groups)))] for i in range(1, groups)]
    return np.searchsorted(np.array(cuts), aspects, side="right")


def split_mirrored(features: np.ndarray, mirrored: np.ndarray, restarts: int = 25, passes: int = 10, seed: int = 3) -> np.ndarray:
    """Two-means where the second centre is the first one's mirror image: which rows to mirror so that all agree best. Flips rows while that brings them closer; the best of several starts."""
    rng, best, best_cost = np.random.default_rng(seed), None, np.inf
    for _ in range(restarts):
        flip = rng.random(len(features)) < 0.5
        for _ in range(passes):
            centre = np.where(flip[:, None], mirrored, features).mean(axis=0)
            now = ((mirrored - centre) ** 2).sum(axis=1) < ((features - centre) ** 2).sum(axis=1)
            if (now == flip).all():
                break
            flip = now
        chosen = np.where(flip[:, None], mirrored, features)
        cost = float(((chosen - chosen.mean(axis=0)) ** 2).sum())
        if cost < best_cost - 1e-12:
            best, best_cost = flip, cost
    return best


def usage(det: DataFrame) -> DataFrame:
    return det.groupBy("comp").agg(F.count("*").alias("n"))

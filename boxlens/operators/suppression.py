"""Greedy non-maximum suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def keep(boxes: np.ndarray, scores: np.ndarray, ids: np.ndarray, threshold: float) -> np.ndarray:
    """Positions kept, best first: a box goes if a kept one covers more than threshold of it. Of equal scores the larger id is first."""
    x1, y1, x2, y2 = boxes.T
    area = (x2 - x1 + 1) * (y2 - y1 + 1)
    left, kept = np.lexsort((-ids, -scores)), []
    while left.size:
        i, left = left[0], left[1:]
        kept.append(i)
        w = np.minimum(x2[i], x2[left]) - np.maximum(x1[i], x1[left]) + 1
        h = np.minimum(y2[i], y2[left]) - np.maximum(y1[i], y1[left]) + 1
        left = left[~((w > 0) & (h > 0) & (w * h / area[left] > threshold))]
    return np.array(kept, np.int64)


def _edges(d: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Rows, but the first, where a group begins; null keys are equal."""
    new = np.zeros(max(len(d) - 1, 0), bool)
    for k in keys:
        v, none = d[k].to_numpy(), d[k].isna().to_numpy()
        new |= (v[1:] != v[:-1]) & ~(none[1:] & none[:-1])
    return np.flatnonzero(new) + 1


def suppress(det: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Rows of det that survive within their group, an image's boxes of a class.

    Groups are dealt to tasks by their keys and come one after another, many to an Arrow batch: a function call for each group
    would cost more than its boxes. A task holds a batch and its last group.
    """

    def survivors(d: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        boxes, scores, ids = d[["x1", "y1", "x2", "y2"]].to_numpy(np.float64), d["score"].to_numpy(np.float64), d["det_id"].to_numpy(np.int64)
        at = [0, *edges.tolist(), len(d)]
        return d.iloc[np.concatenate([lo + keep(boxes[lo:hi], scores[lo:hi], ids[lo:hi], threshold) for lo, hi in zip(at[:-1], at[1:], strict=True)])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for d in batches:
            if not len(d):
                continue
            if held and not len(_edges(pd.concat([held[-1].tail(1), d.head(1)]), keys)):
                edges = _edges(d, keys)
                if not len(edges):
                    held.append(d)
                    continue
            d = pd.concat([*held, d], ignore_index=True)
            edges = _edges(d, keys)
            if not len(edges):
                held = [d]
                continue
            yield survivors(d.iloc[: edges[-1]], edges[:-1])
            held = [d.iloc[edges[-1] :]]
        if held:
            yield survivors(pd.concat(held, ignore_index=True), np.zeros(0, np.int64))

    return det.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, det.schema)

"""Learning a grammar: feature vectors of outputs, beliefs and rivals of labelled boxes, hard negatives, the training of a model.

A row of a cache is an output's vector over all parameters that learn or are not zero, block after block. An image is
handled in one task, as in inference; rows go to the cache, never to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.operators import inference, kernels, training
from boxlens.operators.grammar import Model
from boxlens.tables import Workspace

#: Fixed values of the training rules: outputs this far under the margin are hard; overlaps of a belief, of a rival, and with other objects; slack of rivals.
HARD, BELIEF_OVERLAP, RIVAL_OVERLAP, OTHER_OVERLAP, SLACK = -1.002, 0.7, 0.1, 0.5, 0.01
FEATURES = "data_id long, level long, y long, x long, rule long, is_belief boolean, is_mined boolean, loss double, score double, x_vec array<double>"
NAMES = ["data_id", "level", "y", "x", "rule", "is_belief", "is_mined", "loss", "score", "x_vec"]


# --- parameters as one vector ---------------------------------------------------------------------------


def layout(model: Model) -> dict[int, slice]:
    """Where each written block is: blocks that learn or have a weight other than zero."""
    out, at = {}, 0
    for k, b in enumerate(model.blocks):
        if b.learn != 0 or b.weights.any():
            out[k] = slice(at, at + b.weights.size)
            at += b.weights.size
    return out


def parameters(model: Model, places: dict[int, slice]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.blocks[k].weights for k in places)])


def with_parameters(model: Model, places: dict[int, slice], w: np.ndarray) -> Model:
    out = deepcopy(model)
    for k, s in places.items():
        out.blocks[k].weights = np.array(w[s], float)
    return out


# --- vectors of outputs ---------------------------------------------------------------------------------


def output_vector(model: Model, places: dict[int, slice], features: list[np.ndarray], nodes: list[tuple], interval: int) -> np.ndarray:
    """What the parameters of each block are multiplied by in an output's score: a block used by several nodes adds up. features: of the levels, padded; nodes: of its derivation."""
    x = np.zeros(sum(s.stop - s.start for s in places.values()))
    filters = {f.symbol: f for f in model.filters}
    at = {n[0]: n for n in nodes}
    for node, parent, symbol, k, level, row, col in nodes:
        if parent is not None and model.rules[at[parent][3]].kind == "D":
            rule, dy, dx = model.rules[at[parent][3]], at[parent][5] - row, at[parent][6] - col
            if rule.deformation in places:
                x[places[rule.deformation]] -= [dx * dx, -dx if rule.flip else dx, dy * dy, dy]
        if k is None:
            f = filters[symbol]
            if f.block in places:
                patch = features[level - 1][row : row + f.size[0], col : col + f.size[1]]
                x[places[f.block]] += (kernels.flip_filter(patch) if f.flip else patch).ravel()
            continue
        rule = model.rules[k]
        if rule.offset in places:
            x[places[rule.offset]] += inference.BIAS_FEATURE
        if rule.location in places:
            x[places[rule.location].start + min((level - 1) // interval, 2)] += 1
    return x


def block_scores(model: Model, places: dict[int, slice], x: np.ndarray) -> dict[int, float]:
    """The share of each block in a score."""
    return {k: float(model.blocks[k].weights @ x[s]) for k, s in places.items()}


class _Scored:
    """An image's chart; levels that are not kept are impossible."""

    def __init__(self, model: Model, row, interval: int):
        self.model, self.interval, self.pad = model, interval, inference.padding(model)
        levels = kernels.pyramid(kernels.image_of(row), interval, kernels.CELL, self.pad)
        self.scales, self.features = [s for s, _ in levels], [f for _, f in levels]
        self.terminals, self.size = inference.terminal_scores(model, self.features), (row.h, row.w)

    def evaluate(self, kept: set[int] | None = None) -> inference.Chart:
        hidden = {s: [a if kept is None or level in kept else np.full(a.shape, -np.inf) for level, a in enumerate(t, 1)] for s, t in self.terminals.items()}
        return inference.evaluate(self.model, hidden, self.interval, self.pad)

    def overlaps(self, box) -> dict[int, list[np.ndarray]]:
        """Of each rule of the start symbol: its window at each cell with a box."""
        shapes = [a.shape for a in next(iter(self.terminals.values()))]
        return {k: [kernels.overlap_field(shape, r.window, 1 / s, self.pad, box, self.size) for shape, s in zip(shapes, self.scales, strict=True)] for k, r in enumerate(self.model.rules) if r.lhs == self.model.start}

    def vector(self, places: dict[int, slice], chart: inference.Chart, level: int, y: int, x: int) -> np.ndarray:
        nodes = list(inference.derivation(self.model, chart, level, y, x, self.interval, self.pad))
        return output_vector(self.model, places, self.features, nodes, self.interval)


def adjusted(model: Model, chart: inference.Chart, by_rule: dict[int, list[np.ndarray]]) -> inference.Chart:
    """The chart with other scores of the start symbol's rules; of equal rules the first is chosen."""
    own = np.array(sorted(by_rule))
    levels = [np.stack(at) for at in zip(*(by_rule[k] for k in own), strict=True)]
    return replace(chart, scores={**chart.scores, model.start: [a.max(axis=0) for a in levels]}, chosen={**chart.chosen, model.start: [own[a.argmax(axis=0)] for a in levels]})


def hard_outputs(scored: _Scored, places: dict[int, slice], data_id: int, threshold: float, most: int | None) -> Iterator[tuple]:
    """An example for each output over the threshold: its vector with loss 1, and a zero vector as the belief."""
    zero, chart = [0.0] * sum(s.stop - s.start for s in places.values()), scored.evaluate()
    for score, level, y, x in inference.best_outputs(scored.model, chart, threshold, most):
        rule = int(chart.chosen[scored.model.start][level - 1][y, x])
        yield data_id, level, y, x, None, True, True, 0.0, 0.0, zero
        yield data_id, level, y, x, rule, False, True, 1.0, score, scored.vector(places, chart, level, y, x).tolist()


def labelled_outputs(scored: _Scored, places: dict[int, slice], boxes: list[tuple], most: int, least: float) -> Iterator[tuple]:
    """For each box (data_id, sides) the belief, its best output of enough overlap; up to most rivals, outputs whose score with loss comes within SLACK of the belief's, in another window; and a zero vector with loss 1, the choice of no object. A box without any such output gives nothing."""
    model, fields = scored.model, [scored.overlaps(b[1:]) for b in boxes]
    good = {level for f in fields for tables in f.values() for level, o in enumerate(tables, 1) if (o >= least).any()}
    chart = scored.evaluate(good | {level - scored.interval for level in good})
    zero, floor = [0.0] * sum(s.stop - s.start for s in places.values()), -100.0
    for b, field in zip(boxes, fields, strict=True):
        own = adjusted(model, chart, {k: [np.where(o >= least, s, -np.inf) for s, o in zip(chart.by_rule[k], t, strict=True)] for k, t in field.items()})
        top = inference.best_outputs(model, own, floor, 1)
        if not top:
            continue
        score, *place = top[0]
        rule = int(own.chosen[model.start][place[0] - 1][place[1], place[2]])
        loss_of = lambda k, at, f=field: float(f[k][at[0] - 1][at[1], at[2]] < 0.5)
        yield b[0], *place, rule, True, False, loss_of(rule, place), score, scored.vector(places, own, *place).tolist()
        yield b[0], 0, 0, 0, None, False, False, 1.0, 1.0, zero
        lossy = {}
        for k, tables in field.items():
            lossy[k] = []
            for level, (s, o) in enumerate(zip(chart.by_rule[k], tables, strict=True)):
                bad = o < RIVAL_OVERLAP
                for f, other in zip(fields, boxes, strict=True):
                    if other is not b:
                        bad = bad | (f[k][level] >= OTHER_OVERLAP)
                lossy[k].append(np.where(bad, -np.inf, s + (o < 0.5)))
        rivals = adjusted(model, chart, lossy)
        window = (*place, model.rules[rule].window)
        for value, *at in inference.best_outputs(model, rivals, math.nextafter(score - SLACK, -math.inf), most):
            k = int(rivals.chosen[model.start][at[0] - 1][at[1], at[2]])
            if (*at, model.rules[k].window) != window:
                yield b[0], *at, k, False, False, loss_of(k, at), value, scored.vector(places, rivals, *at).tolist()


def hard_negatives(images: DataFrame, model: Model, interval: int = 4, threshold: float = HARD, most: int | None = None) -> DataFrame:
    """Cache rows of outputs on images (image_id, h, w, pixels) without objects; data_id is the image. most: a quota an image, best first. score is that of the output, with no loss."""
    places = layout(model)

    def run(batches):
        for d in batches:
            for r in d.itertuples(index=False):
                yield pd.DataFrame(list(hard_outputs(_Scored(model, r, interval), places, r.image_id, threshold, most)), columns=NAMES)

    return images.select("image_id", "h", "w", "pixels").mapInPandas(run, FEATURES)


def latent_positives(images: DataFrame, boxes: DataFrame, model: Model, interval: int = 10, most: int = 1, least: float = BELIEF_OVERLAP) -> DataFrame:
    """Cache rows of labelled boxes (gt_id, image_id, sides); data_id is the object. The score of a rival holds its loss. Objects of less than half the smallest window's area are left out; all of an image's objects, these too, rule out rivals."""
    places, needed = layout(model), float(np.prod(np.array(model.smallest) * kernels.CELL / 2))
    sides = ["x1", "y1", "x2", "y2"]
    held = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("gt_id", *sides))).alias("boxes"))

    def run(batches):
        for d in batches:
            for r in d.itertuples(index=False):
                found = [(int(b["gt_id"]), *(float(b[c]) for c in sides)) for b in r.boxes]
                large = {b[0] for b in found if (b[3] - b[1] + 1) * (b[4] - b[2] + 1) >= needed}
                rows = labelled_outputs(_Scored(model, r, interval), places, found, most, least) if large else ()
                yield pd.DataFrame([row for row in rows if row[0] in large], columns=NAMES)

    return images.select("image_id", "h", "w", "pixels").join(held, "image_id").mapInPandas(run, FEATURES)


def block_table(images: DataFrame, model: Model, threshold: float, interval: int = 10, most: int | None = None) -> DataFrame:
    """(image_id, rank, rule, score, blocks): the share of each block in the score of each output, in order of blocks: what a cascade's order and thresholds are made from."""
    places = layout(model)

    def run(batches):
        for d in batches:
            for r in d.itertuples(index=False):
                scored = _Scored(model, r, interval)
                chart, rows = scored.evaluate(), []
                for rank, (score, *at) in enumerate(inference.best_outputs(model, chart, threshold, most), 1):
                    shares = block_scores(model, places, scored.vector(places, chart, *at))
                    rows.append((r.image_id, rank, int(chart.chosen[model.start][at[0] - 1][at[1], at[2]]), score, [shares.get(k, 0.0) for k in range(len(model.blocks))]))
                yield pd.DataFrame(rows, columns=["image_id", "rank", "rule", "score", "blocks"])

    return images.select("image_id", "h", "w", "pixels").mapInPandas(run, "image_id long, rank long, rule long, score double, blocks array<double>")


# --- training -------------------------------------------------------------------------------------------


def as_examples(rows: DataFrame) -> DataFrame:
    """Cache rows as training takes them. An object is an example; of an image without, each place is."""
    place = F.xxhash64("is_mined", "data_id", F.when(F.col("is_mined"), F.struct("level", "y", "x")))
    return rows.select(place.alias("example_id"), "is_belief", "is_mined", "loss", F.col("x_vec").alias("x"))


def still_hard(cache: DataFrame, w: np.ndarray, threshold: float = HARD) -> DataFrame:
    """A cache without mined outputs that are no longer hard. Beliefs stay, a zero vector alone costs nothing."""

    def run(batches):
        for d in batches:
            score = np.stack(d["x"].to_numpy()) @ w if len(d) else np.zeros(0)
            yield d[(d["is_belief"] | ~d["is_mined"]).to_numpy(bool) | (score > threshold)]

    return cache.mapInPandas(run, cache.schema)


def train_model(model: Model, positives: DataFrame, boxes: DataFrame, negatives: DataFrame, c: float = 0.002, rounds: int = 2, mining: int = 2, interval: tuple[int, int] = (10, 4), most: int | None = None, rivals: int = 1, least: float = BELIEF_OVERLAP) -> Model:
    """A model trained on labelled boxes of images and on images without objects: boxes are given their beliefs, hard outputs mined and the objective minimised in turn. Blocks that do not learn keep their weights; lower bounds hold. Each cache is written to the shared folder. A weight's regularisation is its block's."""
    places, work = layout(model), Workspace(positives.sparkSession, "training")
    each = lambda value: np.concatenate([np.zeros(0), *(np.broadcast_to(value(model.blocks[k]), s.stop - s.start) for k, s in places.items())])
    now = lambda w: with_parameters(model, places, w)
    w = training.train(
        parameters(model, places),
        lambda w: as_examples(latent_positives(positives, boxes, now(w), interval[0], rivals, least)),
        lambda w: as_examples(hard_negatives(negatives, now(w), interval[1], HARD, most)),
        still_hard, c, each(lambda b: b.regularisation), rounds, mining, work.root,
        lower=each(lambda b: b.lower), learns=each(lambda b: b.learn != 0).astype(bool),
    )
    return now(w)

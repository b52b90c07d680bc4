"""Running a grammar: scores of all symbols over an image's levels, outputs with their derivations, the whole detection.

A pyramid is bounded by its image, so one task evaluates the grammar on an image in arrays. Only outputs leave the task: no
cell is shuffled, and images are independent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.operators import kernels, rescoring, suppression
from boxlens.operators.grammar import Model, Rule

#: What each rule's bias is multiplied by, a fixed value of the model format.
BIAS_FEATURE = 10.0
NODES = "array<struct<node string, parent string, symbol long, rule long, level long, y long, x long, x1 double, y1 double, x2 double, y2 double>>"
OUTPUTS = f"rank long, score double, rule long, level long, y long, x long, x1 double, y1 double, x2 double, y2 double, nodes {NODES}"


@dataclass
class Chart:
    """Of each symbol a table of scores a level; of nonterminals the rule chosen at each cell; of deformation rules the row and column each cell moves to; of the start symbol's rules their own scores."""

    scores: dict[int, list[np.ndarray]]
    chosen: dict[int, list[np.ndarray]] = field(default_factory=dict)
    moves: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    by_rule: dict[int, list[np.ndarray]] = field(default_factory=dict)


def padding(model: Model) -> tuple[int, int]:
    """Rows and columns of padding that let the largest window be seen in part."""
    return math.ceil(model.largest[0]), math.ceil(model.largest[1])


def terminal_scores(model: Model, features: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
    """Responses of all filters. At a level all have the size of the largest response; places where a filter does not fit are impossible."""
    weights = []
    for f in model.filters:
        w = model.blocks[f.block].weights.reshape(*f.size, -1)
        weights.append(kernels.flip_filter(w) if f.flip else w)
    out: dict[int, list[np.ndarray]] = {f.symbol: [] for f in model.filters}
    for a in features:
        fits = [kernels.correlate(a, w) if a.shape[0] >= w.shape[0] and a.shape[1] >= w.shape[1] else np.full((1, 1), -np.inf) for w in weights]
        rows, cols = (max(r.shape[i] for r in fits) for i in (0, 1))
        for f, r in zip(model.filters, fits, strict=True):
            out[f.symbol].append(kernels.post_pad(r, rows - r.shape[0], cols - r.shape[1], -np.inf))
    return out


def constant(model: Model, rule: Rule, level: int, interval: int) -> float:
    """A rule's bias and, where it has one, its location score: a weight for the first octave, the second, and later. level counts from 1."""
    bias = float(model.blocks[rule.offset].weights[0]) * BIAS_FEATURE
    return bias if rule.location is None else bias + float(model.blocks[rule.location].weights[min((level - 1) // interval, 2)])


def child_place(y, x, anchor: tuple[int, int, int], pad: tuple[int, int]):
    """Where a child of the cell (y, x) stands. Finer levels have the same padding in cells, which is less in pixels: the difference is virtual padding."""
    ay, ax, ds = anchor
    step = 2**ds
    return y * step + ay - (step - 1) * pad[0], x * step + ax - (step - 1) * pad[1]


def _structure(model: Model, rule: Rule, chart: Chart, shapes: list[tuple], interval: int, pad: tuple[int, int]) -> list[np.ndarray]:
    out = []
    for level, shape in enumerate(shapes, 1):
        total = np.full(shape, constant(model, rule, level, interval))
        for child, anchor in zip(rule.children, rule.anchors, strict=True):
            part, below = np.full(shape, -np.inf), level - interval * anchor[2]
            if below >= 1:
                scores = chart.scores[child][below - 1]
                rows, cols = child_place(np.arange(shape[0]), np.arange(shape[1]), anchor, pad)
                r, c = ((rows >= 0) & (rows < scores.shape[0])), ((cols >= 0) & (cols < scores.shape[1]))
                part[np.ix_(r, c)] = scores[np.ix_(rows[r], cols[c])]
            total += part
        out.append(total)
    return out


def evaluate(model: Model, terminals: dict[int, list[np.ndarray]], interval: int, pad: tuple[int, int]) -> Chart:
    """Scores of every symbol, children before parents; of equal rules the first is chosen."""
    chart = Chart(dict(terminals))
    shapes = [a.shape for a in next(iter(terminals.values()))]
    for symbol in model.order():
        own = [k for k, r in enumerate(model.rules) if r.lhs == symbol]
        if not own:
            raise ValueError(f"nonterminal {symbol} has no rule")
        tables = []
        for k in own:
            rule = model.rules[k]
            if rule.kind == "S":
                tables.append(_structure(model, rule, chart, shapes, interval, pad))
                continue
            costs = model.weights_of(rule.deformation, rule.flip)
            moved = [kernels.distance_transform(a + constant(model, rule, level, interval), *costs) for level, a in enumerate(chart.scores[rule.children[0]], 1)]
            tables.append([m[0] for m in moved])
            chart.moves[k] = [m[1:] for m in moved]
        if symbol == model.start:
            chart.by_rule = dict(zip(own, tables, strict=True))
        levels = [np.stack(at) for at in zip(*tables, strict=True)]
        chart.scores[symbol] = [a.max(axis=0) for a in levels]
        chart.chosen[symbol] = [np.array(own)[a.argmax(axis=0)] for a in levels]
    return chart


def best_outputs(model: Model, chart: Chart, threshold: float, most: int | None) -> list[tuple[float, int, int, int]]:
    """(score, level, y, x) of the start symbol above the threshold, best first, ties by place; the first most of them, or all."""
    found = []
    for level, a in enumerate(chart.scores[model.start], 1):
        y, x = np.nonzero(a > threshold)
        found += zip(a[y, x].tolist(), [level] * len(y), y.tolist(), x.tolist(), strict=True)
    return sorted(found, key=lambda o: (-o[0], *o[1:]))[:most]


def derivation(model: Model, chart: Chart, level: int, y: int, x: int, interval: int, pad: tuple[int, int]) -> Iterator[tuple]:
    """Nodes (node, parent, symbol, rule, level, y, x) of the best derivation of the start symbol at a cell, moved parts where they moved to; terminals have no rule."""
    left = [("0", None, model.start, level, y, x)]
    while left:
        node, parent, symbol, level, y, x = left.pop(0)
        if model.symbols[symbol] == "T":
            yield node, parent, symbol, None, level, y, x
            continue
        k = int(chart.chosen[symbol][level - 1][y, x])
        rule = model.rules[k]
        yield node, parent, symbol, k, level, y, x
        if rule.kind == "D":
            row, col = chart.moves[k][level - 1]
            left.append((f"{node}.0", node, rule.children[0], level, int(row[y, x]), int(col[y, x])))
        else:
            left += [(f"{node}.{j}", node, c, level - interval * a[2], *child_place(y, x, a, pad)) for j, (c, a) in enumerate(zip(rule.children, rule.anchors, strict=True))]


def _rows(image_id, model: Model, terminals: dict, scales: list[float], interval: int, pad: tuple[int, int], threshold: float, most: int | None) -> pd.DataFrame:
    sizes, rows = {f.symbol: f.size for f in model.filters}, []

    def sides(level, y, x, size):
        cell = kernels.CELL / scales[level - 1]
        x1, y1 = (x - pad[1]) * cell + 1, (y - pad[0]) * cell + 1
        return x1, y1, x1 + size[1] * cell - 1, y1 + size[0] * cell - 1

    chart = evaluate(model, terminals, interval, pad)
    for rank, (score, level, y, x) in enumerate(best_outputs(model, chart, threshold, most), 1):
        nodes = [(*n, *(sides(*n[4:], sizes[n[2]]) if n[2] in sizes else (None,) * 4)) for n in derivation(model, chart, level, y, x, interval, pad)]
        rule = nodes[0][3]
        names = ("node", "parent", "symbol", "rule", "level", "y", "x", "x1", "y1", "x2", "y2")
        rows.append((image_id, rank, score, rule, level, y, x, *sides(level, y, x, model.rules[rule].window), [dict(zip(names, n, strict=True)) for n in nodes]))
    return pd.DataFrame(rows, columns=["image_id", "rank", "score", "rule", "level", "y", "x", "x1", "y1", "x2", "y2", "nodes"])


def _schema(df: DataFrame) -> str:
    return f"image_id {df.schema['image_id'].dataType.simpleString()}, {OUTPUTS}"


def detect(images: DataFrame, model: Model, threshold: float, interval: int = 10, most: int | None = None) -> DataFrame:
    """Outputs of a model on images (image_id, h, w, pixels): the window in pixels, its rank in its image, and the nodes of its derivation with the boxes of all filters. pixels: grey, h * w values, or colour, h * w * 3."""
    pad = padding(model)

    def run(batches):
        for d in batches:
            for r in d.itertuples(index=False):
                levels = kernels.pyramid(kernels.image_of(r), interval, kernels.CELL, pad)
                yield _rows(r.image_id, model, terminal_scores(model, [f for _, f in levels]), [s for s, _ in levels], interval, pad, threshold, most)

    return images.select("image_id", "h", "w", "pixels").mapInPandas(run, _schema(images))


def detect_on_cells(cells: DataFrame, model: Model, interval: int, pad: tuple[int, int], threshold: float, most: int | None = None) -> DataFrame:
    """The same from terminals' scores at cells (image_id, symbol, level, y, x, score): an image's cells meet in one task. Cells that are not given are impossible. Levels' scales are those of a pyramid that begins at half cells."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        shapes = [(0, 0)] * int(d["level"].max())
        for level, part in d.groupby("level"):
            shapes[level - 1] = (int(part["y"].max()) + 1, int(part["x"].max()) + 1)
        terminals = {k: [np.full(s, -np.inf) for s in shapes] for k, kind in enumerate(model.symbols) if kind == "T"}
        for (symbol, level), part in d.groupby(["symbol", "level"]):
            terminals[symbol][level - 1][part["y"], part["x"]] = part["score"]
        return _rows(d["image_id"].iloc[0], model, terminals, [2 / 2 ** (k / interval) for k in range(len(shapes))], interval, pad, threshold, most)

    return cells.select("image_id", "symbol", "level", "y", "x", "score").groupBy("image_id").applyInPandas(run, _schema(cells))


def process(images: DataFrame, model: Model, threshold: float, interval: int = 10, regression: DataFrame | None = None, overlap: float = 0.5) -> DataFrame:
    """What a user asks of an image: outputs above the threshold, cut to the image, moved by the regression where there is one (rescoring.fit_boxes; comp is the start symbol's rule) and cut again, then suppressed. (image_id, rank, comp, score, sides), rank among all outputs of the image."""
    found = detect(images, model, threshold, interval).withColumn("det_id", F.concat_ws(":", "image_id", "rank"))
    sides = ["x1", "y1", "x2", "y2"]
    size = images.select("image_id", F.col("h").alias("_h"), F.col("w").alias("_w"))

    def cut(d: DataFrame) -> DataFrame:
        inside = {"x1": F.greatest("x1", F.lit(1.0)), "y1": F.greatest("y1", F.lit(1.0)), "x2": F.least("x2", "_w"), "y2": F.least("y2", "_h")}
        return d.join(size, "image_id").select(*[inside.get(c, F.col(c)).alias(c) for c in d.columns]).where("x2 >= x1 and y2 >= y1")

    boxes = cut(found.select("image_id", "rank", "det_id", F.col("rule").alias("comp"), "score", *sides))
    if regression is not None:
        filters = F.expr("filter(nodes, n -> n.x1 IS NOT NULL)")
        parts = found.select("det_id", F.posexplode(filters).alias("filter_id", "n")).select("det_id", "filter_id", *[F.col(f"n.{c}").alias(c) for c in sides])
        boxes = cut(rescoring.apply_boxes(boxes, rescoring.part_features(parts), regression))
    return suppression.suppress(boxes.withColumn("det_id", -F.col("rank")), ["image_id"], overlap).drop("det_id")

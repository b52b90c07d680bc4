"""Running a grammar, against plain loops."""

import numpy as np
import pytest

from boxlens.operators import grammar, inference, kernels
from boxlens.plans import grammar_plans
from tests.images import tiny_images


def plain(model, terminals, interval, pad, symbol, level, y, x):
    """Score of a symbol at a cell by recursion over the definition."""
    if not 1 <= level:
        return -np.inf
    shape = terminals[next(iter(terminals))][level - 1].shape
    if not (0 <= y < shape[0] and 0 <= x < shape[1]):
        return -np.inf
    if model.symbols[symbol] == "T":
        return terminals[symbol][level - 1][y, x]
    best = -np.inf
    for r in (r for r in model.rules if r.lhs == symbol):
        own = 10 * model.blocks[r.offset].weights[0]
        if r.location is not None:
            own += model.blocks[r.location].weights[0 if level <= interval else 1 if level <= 2 * interval else 2]
        if r.kind == "S":
            total = own
            for c, (ay, ax, ds) in zip(r.children, r.anchors, strict=True):
                k = 2**ds
                total += plain(model, terminals, interval, pad, c, level - interval * ds, k * (y - pad[0]) + pad[0] + ay, k * (x - pad[1]) + pad[1] + ax)
        else:
            a, b, c, d = model.weights_of(r.deformation, r.flip)
            total = max(plain(model, terminals, interval, pad, r.children[0], level, y - dy, x - dx) + own - a * dx * dx - b * dx - c * dy * dy - d * dy for dy in range(-4, 5) for dx in range(-4, 5))
        best = max(best, total)
    return best


def test_chart_is_the_definition():
    rng, model = np.random.default_rng(1), grammar_plans.grid_model()
    terminals = {s: [rng.normal(size=shape) for shape in [(9, 10), (8, 8), (6, 7), (5, 5)]] for s in range(3)}
    chart = inference.evaluate(model, terminals, 2, (1, 2))
    for level in range(1, 5):
        got = chart.scores[model.start][level - 1]
        want = [[plain(model, terminals, 2, (1, 2), model.start, level, y, x) for x in range(got.shape[1])] for y in range(got.shape[0])]
        assert np.allclose(got, want)


def test_derivation_adds_up():
    rng, model = np.random.default_rng(2), grammar_plans.grid_model()
    terminals = {s: [rng.normal(size=shape) for shape in [(9, 10), (8, 8), (6, 7), (5, 5)]] for s in range(3)}
    chart = inference.evaluate(model, terminals, 2, (1, 2))
    for score, level, y, x in inference.best_outputs(model, chart, -50.0, 40):
        nodes = {n[0]: n for n in inference.derivation(model, chart, level, y, x, 2, (1, 2))}
        total = 0.0
        for _, parent, symbol, k, at, r, c in nodes.values():
            if k is None:
                total += terminals[symbol][at - 1][r, c]
                if model.rules[nodes[parent][3]].kind == "D":
                    rule, up = model.rules[nodes[parent][3]], nodes[parent]
                    dx, dy = up[6] - c, up[5] - r
                    total -= float(np.dot(model.weights_of(rule.deformation, rule.flip), [dx * dx, dx, dy * dy, dy]))
            else:
                total += inference.constant(model, model.rules[k], at, 2)
        assert total == pytest.approx(score)


def test_small_levels_and_mirror():
    model = grammar_plans.synthetic_model()
    features = [np.random.default_rng(4).normal(size=(6, 7, kernels.DIMS)), np.zeros((1, 1, kernels.DIMS))]
    got = inference.terminal_scores(model, features)
    assert all(a[1].shape == got[0 if 0 in got else next(iter(got))][1].shape for a in got.values())
    flipped = inference.terminal_scores(model, [features[0][:, ::-1, kernels.mirror_order()]])
    root, mirror = model.filters[0], model.filters[3]
    assert mirror.flip and mirror.block == root.block
    a, b = got[root.symbol][0], flipped[mirror.symbol][0]
    assert np.allclose(a[:4, :4], b[:4, :4][:, ::-1])


def test_process(spark):
    model = grammar_plans.synthetic_model()
    images = tiny_images(spark)
    found = inference.detect(images, model, -1.0, 4, most=20).collect()
    assert found and all(r["nodes"][0]["rule"] == r["rule"] and len(r["nodes"]) == 6 for r in found)
    one = min((r for r in found if r["image_id"] == 2), key=lambda r: r["rank"])
    row = images.where("image_id = 2").first()
    levels = kernels.pyramid(kernels.image_of(row), 4, kernels.CELL, inference.padding(model))
    chart = inference.evaluate(model, inference.terminal_scores(model, [f for _, f in levels]), 4, inference.padding(model))
    assert one["score"] == pytest.approx(max(a.max() for a in chart.scores[model.start]))
    kept = inference.process(images, model, -1.0, 4).collect()
    assert kept and all(1 <= r["x1"] <= r["x2"] <= 96 and 1 <= r["y1"] <= r["y2"] <= 64 for r in kept)
    assert inference.process(images.limit(0), model, -1.0, 4).count() == 0
    rules = [k for k, r in enumerate(model.rules) if r.lhs == model.start]
    still = spark.createDataFrame([(k, t, [0.0] * 5) for k in rules for t in ("x1", "y1", "x2", "y2")], "comp long, target string, beta array<double>")
    assert {tuple(r) for r in inference.process(images, model, -1.0, 4, regression=still).collect()} == {tuple(r) for r in kept}
    named = images.withColumn("image_id", images["image_id"].cast("string"))
    assert {(int(r["image_id"]), *r[1:]) for r in inference.process(named, model, -1.0, 4).collect()} == {tuple(r) for r in kept}


def test_no_rule_and_padding():
    m = grammar.Model("m")
    t = m.add_symbol("T")
    n, m.start = m.add_symbol("N"), m.add_symbol("N")
    m.add_structure(m.start, [t, n], [(0, 0, 0), (0, 0, 0)], (3, 5))
    assert inference.padding(m) == (3, 5)
    with pytest.raises(ValueError):
        inference.evaluate(m, {t: [np.zeros((2, 2))]}, 2, (0, 0))


def test_colour_and_octaves():
    rng = np.random.default_rng(6)
    im = rng.uniform(0, 255, size=(96, 112, 3))
    class Row:  # noqa: E306
        h, w, pixels = 96, 112, im.ravel().tolist()
    assert np.array_equal(kernels.image_of(Row), im)
    levels = kernels.pyramid(im, interval=2)
    assert np.allclose([s for s, _ in levels][:5], [2, 2**0.5, 1, 0.5**0.5, 0.5])
    assert np.allclose(levels[4][1], kernels.padded(kernels.hog(kernels.shrink(im, 0.5), 8), (0, 0)))

"""Vectors, beliefs and rivals of outputs against plain enumeration; training."""

import numpy as np
import pytest

from boxlens.operators import grammar, inference, kernels, learning
from boxlens.plans import grammar_plans
from tests.images import tiny_images

IMAGES = range(4)
INTERVAL = 2


@pytest.fixture(scope="module")
def model():
    m = grammar_plans.synthetic_model()
    for r in m.rules:
        if r.lhs == m.start:
            r.location = m.add_block([0.3, -0.2, 0.1], "location")
    return m


@pytest.fixture(scope="module")
def boxes():
    return [(1, 0, 5, 3, 60, 50), (2, 0, 30, 10, 90, 60), (3, 1, 1, 1, 96, 64), (4, 2, 1, 1, 3, 3), (5, 2, 20, 8, 75, 55)]


def images(spark):
    return tiny_images(spark)


def scored(spark, model, k):
    row = images(spark).where(f"image_id = {k}").first()
    return learning._Scored(model, row, INTERVAL)


def test_scores_are_the_products(spark, model):
    places = learning.layout(model)
    w = learning.parameters(model, places)
    rows = learning.hard_negatives(images(spark), model, INTERVAL, -0.5).collect()
    own = [r for r in rows if not r["is_belief"]]
    assert len(own) > 20 and len({r["rule"] for r in own}) == 2 and {r["level"] for r in own} == {3, 4}  # parts are an octave finer, of four levels
    assert all(r["score"] == pytest.approx(float(w @ np.array(r["x_vec"]))) and r["loss"] == 1 for r in own)
    assert len(rows) == 2 * len(own) and not any(any(r["x_vec"]) for r in rows if r["is_belief"])
    few = learning.hard_negatives(images(spark), model, INTERVAL, -0.5, most=2).where("not is_belief").collect()
    assert all(sum(r["data_id"] == k for r in few) <= 2 for k in IMAGES)


def test_shares_of_blocks_add_up(spark, model):
    rows = learning.block_table(images(spark), model, -0.5, INTERVAL, 10).collect()
    assert rows and all(sum(r["blocks"]) == pytest.approx(r["score"]) and len(r["blocks"]) == len(model.blocks) for r in rows)


def test_a_block_that_neither_learns_nor_weighs_is_not_written(model):
    m = learning.with_parameters(model, {}, np.zeros(0))
    unused = m.add_block([0.0, 0.0], "linear", learn=0)
    assert unused not in learning.layout(m) and set(learning.layout(m)) == set(range(unused))
    again = learning.with_parameters(m, learning.layout(m), learning.parameters(m, learning.layout(m)) + 1)
    assert grammar.difference(m, again) and not any(grammar.difference(m, m).values())


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_beliefs_and_rivals_by_enumeration(spark, model, boxes, least):
    table = spark.createDataFrame(boxes, "gt_id long, image_id long, x1 long, y1 long, x2 long, y2 long")
    got: dict = {}
    for r in learning.latent_positives(images(spark), table, model, INTERVAL, 10_000, least).collect():
        got.setdefault(r["data_id"], []).append(r)
    assert 4 not in got  # too small
    w = learning.parameters(model, learning.layout(model))
    for k in (0, 1, 2):
        s = scored(spark, model, k)
        here = [b for b in boxes if b[1] == k]
        overlap = {b[0]: s.overlaps(b[2:]) for b in here}
        good = {lv for f in overlap.values() for t in f.values() for lv, o in enumerate(t, 1) if (o >= least).any()}
        chart = s.evaluate(good | {lv - INTERVAL for lv in good})
        cells = [(rule, lv, y, x) for rule, t in chart.by_rule.items() for lv, a in enumerate(t, 1) for y in range(a.shape[0]) for x in range(a.shape[1]) if a[y, x] > -np.inf]
        value = lambda c, t: t[c[0]][c[1] - 1][c[2], c[3]]
        for b in here:
            if b[0] == 4:
                continue
            enough = [c for c in cells if value(c, overlap[b[0]]) >= least]
            assert bool(enough) == (b[0] in got)
            if not enough:
                continue
            best = min(enough, key=lambda c: (-value(c, chart.by_rule), *c[1:], c[0]))
            rows = got[b[0]]
            belief = [r for r in rows if r["is_belief"]]
            assert [(r["rule"], r["level"], r["y"], r["x"]) for r in belief] == [best]
            assert belief[0]["score"] == pytest.approx(float(w @ np.array(belief[0]["x_vec"])))
            assert sum(r["rule"] is None and r["loss"] == 1 for r in rows) == 1
            want: dict = {}
            for c in cells:
                own = value(c, overlap[b[0]])
                if own < 0.1 or any(value(c, overlap[o[0]]) >= 0.5 for o in here if o is not b):
                    continue
                lossy = value(c, chart.by_rule) + (own < 0.5)
                if lossy >= belief[0]["score"] - 0.01 and lossy > want.get(c[1:], (-np.inf,))[0]:
                    want[c[1:]] = (lossy, c[0])
            want.pop(best[1:], None)
            rivals = [r for r in rows if not r["is_belief"] and r["rule"] is not None]
            assert {(r["level"], r["y"], r["x"]): (pytest.approx(r["score"]), r["rule"]) for r in rivals} == want
            assert all(r["score"] - r["loss"] == pytest.approx(float(w @ np.array(r["x_vec"]))) for r in rivals)


def test_no_objects_and_no_images(spark, model, boxes):
    kind = "gt_id long, image_id long, x1 long, y1 long, x2 long, y2 long"
    assert learning.latent_positives(images(spark), spark.createDataFrame([], kind), model, INTERVAL).count() == 0
    assert learning.hard_negatives(images(spark).where("false"), model, INTERVAL).count() == 0


def patterned(spark, kinds):
    """Images of noise, with stripes where there is an object."""
    rng, rows = np.random.default_rng(5), []
    for k, kind in enumerate(kinds):
        im = rng.normal(128, 4, (64, 64))
        if kind:
            im[16:48, 16:48] = np.where(np.arange(32) // 4 % 2, 220.0, 30.0)[None, :]
        rows.append((k, 64, 64, im.ravel().tolist()))
    return spark.createDataFrame(rows, "image_id long, h long, w long, pixels array<double>")


def test_training_finds_the_object(spark):
    start = grammar.star_model("stripes", np.zeros((4, 4, kernels.DIMS)), [])
    shown, empty = patterned(spark, [1, 1]), patterned(spark, [0, 0])
    boxes = spark.createDataFrame([(k, k, 17, 17, 48, 48) for k in range(2)], "gt_id long, image_id long, x1 long, y1 long, x2 long, y2 long")
    made = learning.train_model(start, shown, boxes, empty, c=0.1, rounds=1, mining=1, interval=(INTERVAL, INTERVAL), least=0.6)
    best = lambda images: {r["image_id"]: r["s"] for r in inference.detect(images, made, -1e9, INTERVAL, 1).selectExpr("image_id", "score s").collect()}
    found, other = best(patterned(spark, [1, 1, 1])), best(patterned(spark, [0, 0, 0]))
    assert min(found.values()) > max(other.values()) + 0.5
    assert not start.blocks[0].weights.any()  # the model given stays as it is


def test_model_as_text(model):
    again = grammar.Model.from_json(model.to_json())
    assert again.to_json() == model.to_json() and again.order() == model.order()
    assert all(np.array_equal(a.lower, b.lower) and np.array_equal(a.weights, b.weights) for a, b in zip(model.blocks, again.blocks, strict=True))
    with pytest.raises(ValueError, match="format"):
        grammar.Model.from_json('{"format": 0}')


def test_mirrored_components_count_once():
    m = grammar_plans.synthetic_model()
    (rule, blocks), = m.components().items()
    assert m.rules[rule].lhs == m.start and blocks == list(range(len(m.blocks)))
    assert len(grammar_plans.grid_model().components()) == 2


def test_alternatives_by_octave():
    """The coarse way is the best one only where nothing is finer; mirrored sides give mirrored scores."""
    rng, m = np.random.default_rng(6), grammar.Model("head")
    m.start = m.add_symbol("N")
    left, right = m.add_symbol("N"), m.add_symbol("N")
    root = m.add_terminal(rng.normal(size=(2, 3, kernels.DIMS)))
    mirror = m.add_terminal(mirror_of=0)
    plain = m.add_structure(left, [root], [(0, 0, 0)], (2, 3), -50.0)
    m.add_structure(right, [mirror], [(0, 0, 0)], (2, 3), mirror_of=plain)
    part = rng.normal(size=(1, 1, kernels.DIMS))
    grammar.add_alternatives(m, (left, right), (root, mirror), [(part, (0, 1), [0.1, 0, 0.1, 0])], [(part, (1, 0), [0.1, 0, 0.1, 0])])
    for n in (left, right):
        m.add_structure(m.start, [n], [(0, 0, 0)], (2, 3))
    shapes = [(12, 14), (6, 7), (5, 6)]
    features = [rng.normal(size=(*s, kernels.DIMS)) for s in shapes]
    chart = inference.evaluate(m, inference.terminal_scores(m, features), 1, (0, 0))
    flipped = inference.evaluate(m, inference.terminal_scores(m, [f[:, ::-1, kernels.mirror_order()] for f in features]), 1, (0, 0))
    fine, coarse = 2, 3
    rules = [k for k, r in enumerate(m.rules) if r.lhs == left]
    assert (chart.chosen[left][0] == rules[coarse - 1]).any() and not (chart.chosen[left][0] == rules[fine - 1]).any()
    seen = chart.scores[left][1] > -900
    assert seen.any() and not (chart.chosen[left][1][seen] == rules[coarse - 1]).any()
    width = shapes[1][1] - 3 + 1
    assert np.allclose(chart.scores[left][0][:11, :12], flipped.scores[right][0][:11, :12][:, ::-1]) and width == 5


def test_transform_without_reach():
    v = np.random.default_rng(3).integers(-9, 9, (7, 13)).astype(float)
    score, row, col = kernels.distance_transform(v, 0.01, 0.02, 0.03, -0.04, None)
    assert np.allclose(score, kernels.brute_transform(v, 0.01, 0.02, 0.03, -0.04, 20))
    assert (np.abs(np.indices(v.shape)[1] - col) > 4).any()


def test_methods_of_regression(spark):
    from boxlens.operators import rescoring

    rng = np.random.default_rng(8)
    x, beta = rng.normal(size=(60, 3)), np.array([1.0, 0.0, -2.0])
    rows = [(1, [float(v) for v in r], *[float(r @ beta)] * 4) for r in x]
    table = spark.createDataFrame(rows, "comp long, x array<double>, t_x1 double, t_y1 double, t_x2 double, t_y2 double")
    got = {m: np.array(rescoring.fit_boxes(table, method=m).where("target = 'x1'").first()["beta"]) for m in ("default", "minl2", "MinL1")}
    a, b = x.T @ x, x.T @ (x @ beta)
    assert np.allclose(got["default"], beta)
    assert np.allclose(got["minl2"], np.linalg.solve(a + 0.01 * np.eye(3), b))
    slope = 2 * (a @ got["MinL1"] - b)  # the condition of a least value
    assert all(abs(s + 0.01 * np.sign(w)) < 1e-6 if w else abs(s) <= 0.01 + 1e-9 for s, w in zip(slope, got["MinL1"], strict=True))
    with pytest.raises(ValueError, match="unknown method"):
        rescoring.fit_boxes(table, method="rtls")


def test_mixed_thresholds_prune_no_good_example(spark):
    from boxlens.operators import cascade

    rng = np.random.default_rng(12)
    s = rng.normal(size=(50, 8))
    names = [f"q{k}" for k in range(4)] + [f"p{k}" for k in range(4)]
    table = spark.createDataFrame([tuple(map(float, r)) for r in s], ", ".join(f"{n} double" for n in names))
    got = [r["value"] for r in cascade.mixed_thresholds(table, names[:4], names[4:], 0.5, 0.1, 0.2).orderBy("stage").collect()]
    good = s[s[:, 4:].sum(axis=1) + 0.2 >= 0.5]
    want = [(good[:, : k + 1].sum(axis=1) + 0.1).min() for k in range(4)] + [(good[:, k - 3 : k + 1].sum(axis=1) + 0.2).min() for k in range(4, 7)] + [0.5]
    assert np.allclose(got, want)
    none = cascade.mixed_thresholds(table.where("false"), names[:4], names[4:], 0.5).collect()
    assert len(none) == 8 and all(r["value"] == np.inf for r in none)


def test_grids_are_dealt_to_tasks_and_cells_stay_there(spark, monkeypatch):
    """As many tasks as grids need; rules and moves shuffle no cell and send no table of cells to all tasks."""
    from boxlens.plans import grammar_plans

    monkeypatch.setattr(grammar_plans, "TASK_GRIDS", 2)
    cells = grammar_plans.cells(spark, "/root/testdata/sf0.01")
    n = cells.select("image_id").distinct().count()
    assert cells.rdd.getNumPartitions() == -(-n // 2) > 1
    for df in (grammar.structural(cells, grammar_plans.CHILDREN, 0.5, 2), grammar.deform(cells.where("symbol = 0"), 0.5, 0.25, 0.75, -0.5), grammar.symbol_best(cells.withColumnRenamed("symbol", "rule"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_moves_end_only_at_cells_of_the_table(spark):
    held = {(1, 1): 1.0, (1, 3): 5.0, (2, 3): -2.0, (9, 9): 0.5}
    cells = spark.createDataFrame([(0, 1, y, x, s) for (y, x), s in held.items()], "image_id long, level long, y long, x long, score double")
    got = {(r["y"], r["x"]): r["score"] for r in grammar.deform(cells, 0.5, 0.25, 0.75, -0.5).collect()}
    near = lambda a, b: abs(a[0] - b[0]) <= 4 and abs(a[1] - b[1]) <= 4
    move = lambda a, b: 0.5 * (a[1] - b[1]) ** 2 + 0.25 * (a[1] - b[1]) + 0.75 * (a[0] - b[0]) ** 2 - 0.5 * (a[0] - b[0])
    assert got == {a: max(held[b] - move(a, b) for b in held if near(a, b)) for a in held}

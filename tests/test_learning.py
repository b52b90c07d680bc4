import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlens import config
from boxlens.operators import cache, cascade, grammar, kernels, reports, rescoring, training


def test_transform_against_brute_force():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (3, 9), (12, 7)):
        v = rng.integers(-9, 9, shape).astype(float)
        score, row, col = kernels.distance_transform(v, 0.5, 0.2, 0.3, -0.4)
        assert np.allclose(score, kernels.brute_transform(v, 0.5, 0.2, 0.3, -0.4))
        y, x = np.indices(shape)
        dy, dx = y - row, x - col
        assert np.allclose(score, v[row, col] - 0.5 * dx**2 - 0.2 * dx - 0.3 * dy**2 + 0.4 * dy)


def test_deform_is_the_transform(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-9, 9, (6, 8)).astype(float)
    cells = spark.createDataFrame([(0, 1, y, x, float(v[y, x])) for y in range(6) for x in range(8)], "image_id long, level long, y long, x long, score double")
    got = {(r["y"], r["x"]): r["score"] for r in grammar.deform(cells, 0.5, 0.25, 0.75, -0.5).collect()}
    want = kernels.distance_transform(v, 0.5, 0.25, 0.75, -0.5)[0]
    assert got == {(y, x): want[y, x] for y in range(6) for x in range(8)}


def test_correlation_against_loops():
    rng = np.random.default_rng(2)
    a, f = rng.normal(size=(6, 7, 4)), rng.normal(size=(3, 2, 4))
    want = [[sum(a[y + i, x + j, d] * f[i, j, d] for i in range(3) for j in range(2) for d in range(4)) for x in range(6)] for y in range(4)]
    assert np.allclose(kernels.correlate(a, f), want)


def test_hog_shape_mirror_and_range():
    rng = np.random.default_rng(3)
    im = rng.uniform(0, 255, (48, 64, 3))
    f = kernels.hog(im)
    assert f.shape == (4, 6, 32) and f.min() >= 0 and (f[:, :, 31] == 0).all() and f[:, :, :27].max() <= 0.4 + 1e-9
    assert np.allclose(kernels.flip_filter(f), kernels.hog(im[:, ::-1]), atol=1e-6)
    order = kernels.mirror_order()
    assert sorted(order) == list(range(32)) and (order[order] == np.arange(32)).all()
    assert kernels.hog(np.zeros((16, 16))).size == 0
    assert np.allclose(kernels.hog(np.full((40, 40), 7.0)), 0)


def test_shrink_keeps_the_mean():
    rng = np.random.default_rng(4)
    im = rng.uniform(size=(20, 30))
    assert np.allclose(kernels.shrink(im, 1.0), im)
    half = kernels.shrink(im, 0.5)
    assert half.shape == (10, 15) and np.allclose(half, im.reshape(10, 2, 15, 2).mean(axis=(1, 3)))


def test_pyramid_scales_and_padding():
    levels = kernels.pyramid(np.random.default_rng(5).uniform(size=(80, 96)), interval=3, pad=(1, 2))
    scales = [s for s, _ in levels]
    assert scales[0] == 2 and np.allclose(scales[3] / scales[0], 0.5)
    f = levels[0][1]
    assert (f[:2, :, 31] == 1).all() and (f[:, :3, 31] == 1).all() and (f[2:-2, 3:-3, 31] == 0).all()
    assert kernels.subarray(np.arange(9.0).reshape(3, 3), 0, 4, 2, 2, True)[:, 0].tolist() == [1, 1, 4, 7, 7]
    assert kernels.subarray(np.arange(9.0).reshape(3, 3), 0, 4, 2, 2, False)[:, 0].tolist() == [0, 1, 4, 7, 0]
    assert kernels.warp(np.ones((40, 40)), (5, 5, 20, 20), (3, 4)).shape == (40, 48, 3)


def test_grammar_order_cycle_and_mirror():
    rng = np.random.default_rng(6)
    root, part = rng.normal(size=(4, 6, 32)), rng.normal(size=(2, 2, 32))
    m = grammar.star_model("a", root, [(part, (1, 2, 1), [0.01, 0, 0.01, 0])], mirrored=True)
    assert m.order()[-1] == m.start and len([r for r in m.rules if r.lhs == m.start]) == 2
    assert m.filters[0].block == m.filters[2].block and m.filters[2].flip
    assert (m.weights_of(m.rules[0].deformation, True)[1] == -m.weights_of(m.rules[0].deformation)[1]) and np.isfinite(m.blocks[m.rules[0].deformation].lower[0])
    both = m.merged(m)
    assert len([r for r in both.rules if r.lhs == both.start]) == 4 and both.order()[-1] == both.start
    m.add_structure(m.rules[0].lhs, [m.start], [(0, 0, 0)], (1, 1))
    with pytest.raises(ValueError):
        m.order()
    with pytest.raises(ValueError):
        m.add_block([1.0], "linear", wrong=1)
    body = grammar.visibility_model("p", [root, root, root], part, [0.1, 0, 0.1, 0])
    assert [len(r.children) for r in body.rules if r.lhs == body.start] == [2, 3, 3]
    car = grammar.slice_model("c", [(root, part)] * 3, [0, 1])
    assert len([r for r in car.rules if r.lhs == car.start]) == 4 and set(grammar.difference(car, car).values()) == {0.0}


def test_part_anchors_take_the_energy():
    e = np.zeros((8, 8))
    e[1:3, 1:3], e[5:7, 4:6] = 5, 3
    assert grammar.part_anchors(e, (2, 2), 2) == [(1, 1), (5, 4)]


def test_model_tables(spark):
    m = grammar.star_model("a", np.ones((2, 2, 32)), [(np.ones((1, 1, 32)), (0, 0, 1), [0.1, 0, 0.1, 0])])
    t = m.tables(spark)
    assert t["rule"].count() == 2 and t["rule_rhs"].count() == 3 and t["filter"].count() == 2


def test_lbfgs_with_bounds():
    target = np.array([3.0, -2.0, 0.5])

    def quadratic(w):
        d = (w - target) * np.array([1, 10, 100])
        return 0.5 * float(d @ (w - target)), d

    w, value, _ = training.lbfgs(quadratic, np.zeros(3))
    assert np.allclose(w, target, atol=1e-5)
    w, _, _ = training.lbfgs(quadratic, np.zeros(3), lower=np.array([-np.inf, -1.0, 1.0]))
    assert np.allclose(w, [3, -1, 1], atol=1e-5)

    def banana(w):
        a, b = 1 - w[0], w[1] - w[0] ** 2
        return a * a + 100 * b * b, np.array([-2 * a - 400 * w[0] * b, 200 * b])

    assert np.allclose(training.lbfgs(banana, np.array([-1.2, 1.0]))[0], [1, 1], atol=1e-3)


def test_latent_objective(spark):
    rng = np.random.default_rng(7)
    rows = [(int(e), bool(k == 0), 0.0 if k == 0 else 1.0, rng.normal(size=4).tolist()) for e in range(6) for k in range(3)]
    f = training.latent_objective(spark.createDataFrame(rows, "example_id long, is_belief boolean, loss double, x array<double>"), 0.5, np.ones(4))
    w = rng.normal(size=4)
    value, g = f(w)
    want = 0.5 * float(w @ w) + 0.5 * sum(max((0 if r[1] else r[2]) + float(np.dot(r[3], w)) for r in rows if r[0] == e) - next(float(np.dot(r[3], w)) for r in rows if r[0] == e and r[1]) for e in range(6))
    assert value == pytest.approx(want)
    step = np.array([(f(w + 1e-6 * np.eye(4)[k])[0] - value) / 1e-6 for k in range(4)])
    assert np.allclose(step, g, atol=1e-4)


def test_latent_objective_over_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(int(e), bool(k == 0), float(k % 3), rng.normal(size=3).tolist()) for e in range(5) for k in range(40)]
    cache, w = spark.createDataFrame(rows, "example_id long, is_belief boolean, loss double, x array<double>"), rng.normal(size=3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        f = training.latent_objective(cache, 1.0, np.zeros(3))
        value, g = f(w)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x, want, slope = np.array([r[3] for r in rows]).reshape(5, 40, 3), 0.0, np.zeros(3)
    for e in range(5):
        scores = x[e] @ w + np.array([0.0 if k == 0 else k % 3 for k in range(40)])
        want, slope = want + scores.max() - x[e, 0] @ w, slope + x[e, scores.argmax()] - x[e, 0]
    assert value == pytest.approx(want) and np.allclose(g, slope)
    f.release()
    assert training.latent_objective(cache.limit(0), 1.0, np.ones(3))(w)[0] == pytest.approx(0.5 * float(w @ w))


def test_splits_and_softmax():
    assert training.split_aspects(np.array([1, 1, 1, 2, 3, 4.0]), 3).tolist() == [0, 0, 0, 1, 2, 2] or len(set(training.split_aspects(np.array([1, 1, 1, 2, 3, 4.0]), 3)[:3])) == 1
    rng = np.random.default_rng(8)
    centre = rng.normal(size=10)
    facing = rng.random(40) < 0.5
    x = np.where(facing[:, None], centre, -centre) + 0.05 * rng.normal(size=(40, 10))
    flip = training.split_mirrored(x, -x)
    assert (flip == facing).all() or (flip != facing).all()
    value, share = training.softmax_regulariser(np.array([1.0, 2.0, 2.0]))
    assert value == pytest.approx(1 + np.log(2) / 1000) and np.allclose(share, [0, 0.5, 0.5])


def test_retention_keeps_support_vectors(spark):
    rows = [(k, k % 5, 0, 0, 0, 0, 1, 100, -1.0 if k < 10 else float(k)) for k in range(40)] + [(-k - 1, k, 0, 0, 0, 1, 1, 0, 0.0) for k in range(5)] + [(100, 9, 0, 0, 0, 0, 0, 1000, 5.0)]
    df = spark.createDataFrame(rows, "eid long, dataid long, scale long, x long, y long, is_belief int, is_mined int, byte_size long, margin double")
    kept = {r["eid"] for r in cache.retained(df, 1000, 1).collect()}
    assert kept == {100, *range(10), -1, -2, -3, -4, -5}
    kept = {r["eid"] for r in cache.retained(df, 3500, 100).collect()}
    assert kept == {100, *range(13), -1, -2, -3, -4, -5}  # the row that reaches 1250 bytes stays


def test_feature_cache(spark, tmp_path):
    rows = spark.createDataFrame([(k, 10) for k in range(5)], "eid long, byte_size long")
    c = cache.FeatureCache(spark, str(tmp_path / "a"))
    c.add(rows)
    c.add(rows.withColumn("eid", F.col("eid") + 5))
    assert c.byte_size() == 100
    small = c.shrink(rows.where("eid < 2"), str(tmp_path / "b"))
    small.save(str(tmp_path / "c"))
    assert cache.FeatureCache(spark, str(tmp_path / "c")).byte_size() == 20
    draws = cache.random_negatives(spark.range(4).withColumnRenamed("id", "image_id"), 3, 50).collect()
    assert len(draws) == 12 and all(0 <= r["x"] < 50 for r in draws)


def test_box_regression_recovers(spark):
    rng = np.random.default_rng(9)
    beta = {(c, t): rng.normal(size=3) for c in (1, 2) for t in rescoring.TARGETS}
    rows = []
    for k in range(200):
        c, x = 1 + k % 2, [*rng.normal(size=2), 1.0]
        rows.append((c, [float(v) for v in x], *[float(np.dot(beta[c, t], x)) for t in rescoring.TARGETS]))
    got = rescoring.fit_boxes(spark.createDataFrame(rows, "comp long, x array<double>, t_x1 double, t_y1 double, t_x2 double, t_y2 double")).collect()
    assert len(got) == 8 and all(np.allclose(r["beta"], beta[r["comp"], r["target"]]) for r in got)


def test_context_machine_separates(spark):
    rng = np.random.default_rng(10)
    x = rng.uniform(-1, 1, (400, 3))
    rows = [([float(v) for v in r], 1 if r[0] * r[1] > 0 else -1, k) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "x array<double>, label int, det_id long")
    w = rescoring.fit_context(df, steps=60, positive_weight=1.0)
    got = {r["det_id"]: r["score"] for r in rescoring.rescore(df, w).collect()}
    assert np.mean([(got[k] > 0) == (label == 1) for _, label, k in rows]) > 0.85


def test_cascade_agrees_with_the_whole_sum(spark):
    rng = np.random.default_rng(11)
    rows = [(k, *[float(v) for v in rng.integers(-5, 6, 3)]) for k in range(300)]
    df = spark.createDataFrame(rows, "det_id long, a double, b double, c double")
    order = cascade.part_order(df, ["a", "b", "c"])
    limits = [r["value"] for r in sorted(cascade.stage_thresholds(df, order, 6.0).collect(), key=lambda r: r["stage"])]
    got = {r["det_id"]: r for r in cascade.staged(df, order, limits, 6.0).collect()}
    assert all(got[k]["passed"] == (a + b + c >= 6) for k, a, b, c in rows)
    assert sum(r["evaluated"] for r in got.values()) < 900


def test_gram_and_principal(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50, 4)) * [3, 1, 1, 0.1]
    g = cascade.gram(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v", 4)
    assert np.allclose(g, x.T @ x / 50) and abs(cascade.principal(g, 1)[0, 0]) > 0.9


def test_config_and_report(spark):
    c = config.make(lambda: {"c": 0.006, "seed": 4}, seed=5)
    assert (c.c, c.seed) == (0.006, 5) and c.digest() != config.make().digest()
    with pytest.raises(ValueError):
        config.make(nothing=1)
    aps = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 0.25)], "cls_id long, ap double")
    rows = [(r["name"], r["percent"]) for r in reports.report(aps).collect()]
    assert rows == [("1", 50.0), ("2", None), ("3", 25.0), ("mean", 37.5)]
    assert reports.compare(aps.where("cls_id = 1"), aps).first()["diff"] == 0


def test_star_cascade_without_thresholds_is_the_best_placement(spark):
    rng = np.random.default_rng(13)
    costs = rng.uniform(0, 2, (2, 4))
    rows = [(k, float(rng.normal()), rng.normal(size=(2, 4)).tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "det_id long, root double, parts array<array<double>>")
    none = [-np.inf, -np.inf]
    got = {r["det_id"]: r for r in cascade.star_cascade(df, costs, none, none, 0.5).collect()}
    for k, root, parts in rows:
        want = root + (np.array(parts) - costs).max(axis=1).sum()
        assert got[k]["score"] == pytest.approx(want) and got[k]["passed"] == (want >= 0.5) and got[k]["evaluated"] == 8


def test_projected_and_warped_rows(spark):
    rng = np.random.default_rng(14)
    im = rng.uniform(0, 255, (48, 48))
    images = spark.createDataFrame([(1, 48, 48, im.ravel().tolist())], "image_id long, h long, w long, pixels array<double>")
    levels = kernels.image_levels(images, 2)
    basis = np.linalg.qr(rng.normal(size=(32, 5)))[0]
    a, b = levels.where("level = 1").first(), cascade.projected(levels, basis).where("level = 1").first()
    assert b["dims"] == 5 and np.allclose(np.array(a["feat"]).reshape(-1, 32) @ basis, np.array(b["feat"]).reshape(-1, 5), atol=1e-4)
    boxes = images.selectExpr("image_id AS dataid", "h", "w", "pixels", "5D AS x1", "5D AS y1", "30D AS x2", "30D AS y2")
    assert len(kernels.warped_rows(boxes, (3, 4)).first()["feat"]) == 3 * 4 * 32

"""Mining with a place, kernel machines, mirrored clusters, low-rank cascades and vector de-duplication against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlens.operators import cache, cascade, kernel_machine, mining, mirrors, training
from boxlens.operators.sums import summed

# mining


def walked(images, det, place, used_bytes, most, most_bytes, batch):
    """Image by image: (taken, place, bytes, complete)."""
    n, used, held, out, quota = len(images), 0, used_bytes, [], 0
    for k in range(n):
        image = images[(place + k) % n]
        if k % batch == 0:
            quota = -(-(most - used) // min(batch, n - k))
        own = sorted((d for d in det if d[1] == image and d[2] > mining.THRESHOLD), key=lambda d: (-d[2], -d[0]))
        for d in own[: min(quota, most - used)]:
            out.append((image, d[0], k))
            used, held = used + 1, held + d[3]
            if held >= most_bytes:
                break
        if held >= most_bytes or used >= most:
            return out, (place + k + 1) % n, held, False
    return out, place, held, True


@pytest.mark.parametrize("most,room,batch,segment", [(40, 10**9, 4, 8192), (40, 10**9, 1, 3), (10**6, 900, 4, 3), (25, 700, 7, 2), (10**6, 10**9, 5, 4), (3, 50, 50, 8192)])
def test_scans_go_on_from_their_place(spark, monkeypatch, tmp_path, most, room, batch, segment):
    """Ends by examples, by bytes, by neither; batches and segments of all sizes; images without detections; three scans."""
    monkeypatch.setattr(mining, "SEGMENT", segment)
    rng = random.Random(most + batch)
    images = [3 * k + 1 for k in range(11)]
    det = [(k, rng.choice(images[1:] + [999]), float(rng.choice([-2, -1.002, -1, 0, 1, 2])), rng.randint(1, 30)) for k in range(160)]
    miner = mining.HardNegatives(spark.createDataFrame([(i,) for i in images + images[:2]], "image_id long"), spark.createDataFrame(det, "det_id long, image_id long, score double, byte_size long"), most)
    place, position, held = mining.Place(), 0, 0
    for turn in range(3):
        rows, place = miner.scan(place, room * (turn + 1), batch)
        want, position, held, complete = walked(images, det, position, held, most, room * (turn + 1), batch)
        assert sorted((r["image_id"], r["det_id"], r["step"]) for r in rows.collect()) == sorted(want)
        assert (place.position, place.used_bytes, place.complete) == (position, held, complete)
        place.save(spark, f"{tmp_path}/{turn}")
        assert mining.Place.load(spark, f"{tmp_path}/{turn}") == place


def test_scan_of_no_images(spark):
    miner = mining.HardNegatives(spark.createDataFrame([], "image_id long"), spark.createDataFrame([], "det_id long, image_id long, score double, byte_size long"), 10)
    rows, place = miner.scan(mining.Place(), 10, 4)
    assert rows.collect() == [] and place == mining.Place()


# kernel machines


def machine_rows(seed, n, dim=4):
    rng = np.random.default_rng(seed)
    x = rng.random((n, dim))
    y = np.where((x[:, 0] - 0.5) ** 2 + (x[:, 1] - 0.5) ** 2 + rng.normal(0, 0.06, n) < 0.08, 1, -1)
    return x, y


def test_solver_meets_the_conditions():
    """Margins against weights, sum of signed weights, and no better value nearby."""
    x, y = machine_rows(0, 150)
    k, cost = kernel_machine.kernel(x, x), kernel_machine.costs_of(y)
    alpha, bias = kernel_machine.solve(k, y.astype(float), cost)
    margin = y * (k @ (alpha * y) + bias)
    assert abs(alpha @ y) < 1e-9 and (alpha >= 0).all() and (alpha <= cost).all()
    assert (margin[alpha == 0] > 1 - 1e-6).all() and (margin[alpha == cost] < 1 + 1e-6).all()
    inside = (alpha > 0) & (alpha < cost)
    assert inside.any() and np.allclose(margin[inside], 1, atol=1e-6)


@pytest.mark.parametrize("block", [16384, 40])
def test_machines_are_those_of_all_rows_at_once(spark, monkeypatch, block):
    monkeypatch.setattr(kernel_machine, "BLOCK_ROWS", block)
    monkeypatch.setattr(kernel_machine, "VIOLATORS", 30)
    rows, whole = [], {}
    for cls in (0, 1):
        x, y = machine_rows(cls + 1, 260)
        alpha, bias = kernel_machine.solve(kernel_machine.kernel(x, x), y.astype(float), kernel_machine.costs_of(y))
        whole |= {(cls, k): v for k, v in enumerate(kernel_machine.values(x, x, alpha * y, bias))}
        rows += [(cls, k, int(b), a.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [(0, 9000, 0, [0.0] * 4), (2, 1, 1, [0.1] * 4), (2, 2, 1, [0.2] * 4), (3, 1, -1, [0.1] * 4)]
    frame = spark.createDataFrame(rows, "cls_id long, row_id long, label int, x array<double>")
    support, report = kernel_machine.fit(frame, gap=1e-10)
    found = {r["cls_id"]: r for r in report.collect()}
    assert set(found) == {0, 1, 2, 3} and all(r["gap"] <= 1e-10 for r in found.values())
    assert found[0]["rows"] == 260 and 0 < found[0]["support"] < 260 and found[2]["support"] == 0
    got = {(r["cls_id"], r["row_id"]): r["score"] for r in kernel_machine.rescore(frame, support).collect()}
    assert len(got) == len(rows) and max(abs(got[k] - v) for k, v in whole.items()) < 1e-6
    assert got[2, 1] == 1.0 and got[3, 1] == -1.0


def test_machine_gap_is_reported(spark):
    x, y = machine_rows(5, 300)
    frame = spark.createDataFrame([(0, k, int(b), a.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "cls_id long, row_id long, label int, x array<double>")
    with pytest.raises(ValueError, match="gaps"):
        kernel_machine.fit(frame, gap=-1.0, rounds=2)


def noisy_rows(n):
    rng = np.random.default_rng(n)
    return rng.uniform(size=(n, 4)), np.where(rng.uniform(size=n) < 0.3, 1, -1)


def test_factored_machine_is_as_good_as_the_whole_one():
    x, y = noisy_rows(500)
    k, cost = kernel_machine.kernel(x, x), kernel_machine.costs_of(y)
    whole, _ = kernel_machine.solve(k, y.astype(float), cost)
    dual = lambda a: a.sum() - (a * y) @ k @ (a * y) / 2
    alpha, bias, square = kernel_machine._large(x, y.astype(float), 1e-4)
    score = kernel_machine.values(x, x, alpha * y, bias)
    assert np.allclose(score, k @ (alpha * y) + bias, atol=1e-8)  # added up by monomials
    assert abs(alpha @ y) < 1e-9 and (alpha >= 0).all() and (alpha <= cost).all() and square == pytest.approx((alpha * y) @ k @ (alpha * y))
    primal = square / 2 + cost @ np.maximum(0, 1 - y * score)
    assert dual(alpha) <= dual(whole) + 1e-6 <= primal <= dual(alpha) * (1 + 1e-4)


def test_sets_of_many_support_vectors_end_in_few_rounds(spark):
    """Labels that the rows do not tell make most of them support vectors: sets grow to them in a few rounds, and none is solved on its whole kernel."""
    x, y = noisy_rows(6000)
    frame = spark.createDataFrame([(0, k, int(b), a.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "cls_id long, row_id long, label int, x array<double>")
    support, report = kernel_machine.fit(frame, rounds=6)
    r = report.first()
    assert r["gap"] <= 1e-3 and r["rows"] == 6000 and 3000 < r["support"] == support.count()
    score = np.array([v["score"] for v in kernel_machine.rescore(frame, support).orderBy("row_id").collect()])
    loss = float(kernel_machine.costs_of(y) @ np.maximum(0, 1 - y * score))
    assert r["dual"] <= loss + 1e-6 and loss <= r["primal"] + 1e-6


# mirrored clusters


def split_cost(v, turned, mirror):
    chosen = np.where(turned[:, None], v[:, mirror], v)
    return 2 * float(((chosen - chosen.mean(axis=0)) ** 2).sum())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mirrored_split_is_no_worse_than_the_plain_one(spark, seed):
    rng = np.random.default_rng(seed)
    pattern, mirror = rng.standard_normal(12), np.arange(12)[::-1]
    flip = rng.random(300) < 0.4
    v = np.where(flip[:, None], pattern[mirror], pattern) + 0.8 * rng.standard_normal((300, 12))
    frame = spark.createDataFrame([(k, x.tolist(), "x") for k, x in enumerate(v)] + [(900, None, "x")], "vec_id long, embedding array<double>, k string")
    rows, cost = mirrors.mirrored_split(frame, "vec_id", "embedding", mirror.tolist())
    turned = {r["vec_id"]: r["turned"] for r in rows.collect()}
    found = np.array([turned[k] for k in range(300)])
    assert len(turned) == 300 and not found[0] and cost == pytest.approx(split_cost(v, found, mirror))
    plain = training.split_mirrored(v, v[:, mirror])
    assert cost <= split_cost(v, plain, mirror) * (1 + 1e-9)


def test_mirrored_split_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    rows, cost = mirrors.mirrored_split(none, "vec_id", "embedding", [1, 0])
    assert rows.collect() == [] and cost == 0
    with pytest.raises(ValueError, match="mirror"):
        mirrors.mirrored_split(none, "vec_id", "embedding", [1, 2, 0])


# low-rank cascade


def test_low_rank_cascade_loses_nothing(spark):
    """Against whole products of all, at thresholds down to none; few survivors where directions hold the energy."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 20)) * np.geomspace(4, 0.05, 20)
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    basis = cascade.principal(cascade.gram(frame, "embedding", 20), 12)
    filters = {7: v[7], 3: v[3], 11: -v[5]}
    for share in (-100.0, 0.0, 0.5, 0.9):
        limits = {k: share * float(f @ f) for k, f in filters.items()}
        got = {(r["vec_id"], r["filter"]): r["score"] for r in cascade.low_rank_cascade(frame, "vec_id", "embedding", filters, limits, basis, [3, 6, 12]).collect()}
        want = {(i, k): float(v[i] @ f) for k, f in filters.items() for i in range(400) if v[i] @ f >= limits[k]}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = cascade.low_rank_survivors(frame, "vec_id", "embedding", filters, limits, basis, [3, 6, 12]).count()
    assert len(want) <= left < 1.2 * len(want) + 10


# vectors and sums


def test_vectors_that_share_a_digest_stay_apart(spark):
    rows = [(0, 5, [(0, [1.0, 0.0]), (2, [1.0])]), (0, 3, [(2, [1.0]), (0, [1.0, 0.0])]), (0, 4, [(0, [1.0, 0.5]), (2, [1.0])]), (0, 9, []), (0, 8, []), (1, 1, [(0, [1.0, 0.0]), (2, [1.0])]), (1, 2, [(1, [7.0])])]
    frame = spark.createDataFrame(rows, "dataid long, eid long, blocks array<struct<bl int, f array<double>>>")
    want = [(0, 3, 2, 2, 3), (0, 4, 1, 2, 3), (0, 8, 2, 0, 0), (1, 1, 1, 2, 3), (1, 2, 1, 1, 1)]
    for digest in (cache.block_digest, lambda: F.lit(0).cast("long"), lambda: F.size("blocks").cast("long")):
        assert sorted(tuple(r) for r in cache.dedupe_vectors(frame, ["dataid"], digest).collect()) == want
    store = {(r["bl"], tuple(r["f"])): (r["eid"], r["uses"]) for r in cache.block_store(frame).collect()}
    assert store == {(0, (1.0, 0.0)): (1, 3), (2, (1.0,)): (1, 4), (0, (1.0, 0.5)): (4, 1), (1, (7.0,)): (2, 1)}


def test_sums_of_arrays(spark):
    parts = spark.range(40).repartition(7).select(F.array(F.lit(1.0), F.col("id").cast("double"), F.lit(0.5)).alias("a"))
    assert summed(parts, "a", 3).tolist() == [40.0, 780.0, 20.0]
    assert summed(parts.limit(0), "a", 3).tolist() == [0.0, 0.0, 0.0]


# the latent loop


def plain_rounds(x, foreground, cost, rounds, minings, steps):
    """The loop over arrays: (round, step, value on the cache, value with what is mined then)."""
    n, log, last = x.shape[1], [], np.inf
    w = np.zeros(2 * n)
    w[0], w[n] = 0.1, -0.1
    scores = lambda w: np.c_[x @ w[:n], x @ w[n:]]

    def objective(choice, negatives):
        def value(w):
            s, v, g = scores(w), 0.5 * w @ w, w.copy()
            for i in np.flatnonzero(foreground):
                c = choice[i]
                if s[i, c] < 1:
                    v, g[c * n : c * n + n] = v + cost * (1 - s[i, c]), g[c * n : c * n + n] - cost * x[i]
            for i in {i for i, _ in negatives}:
                best, c = max((s[i, c] + 1, -c) for k, c in negatives if k == i)
                if best > 0:
                    v, g[-c * n : -c * n + n] = v + cost * best, g[-c * n : -c * n + n] + cost * x[i]
            return v, g

        return value

    mine = lambda w: {(i, c) for i in np.flatnonzero(~foreground) for c in (0, 1) if scores(w)[i, c] > -1}
    for turn in range(rounds):
        choice, held = scores(w).argmax(axis=1), set()
        for step in range(minings):
            s = scores(w)
            held = {(i, c) for i, c in held if s[i, c] + 1 > -1e-4} | mine(w)
            w, value, _ = training.lbfgs(objective(choice, held), w, None, steps)
            full, _ = objective(choice, held | mine(w))(w)
            log.append((turn, step, value, full))
            if training.converged(full, value):
                break
        if np.isfinite(last) and value / last > 0.999:
            break
        last = value
    return log


def test_latent_rounds_are_those_over_arrays(spark, monkeypatch):
    from boxlens.plans import training_plans
    from boxlens.sources.fixtures import read

    monkeypatch.setattr(training_plans, "STEPS", 6)
    rows = read(spark, "/root/testdata/sf0.001", "embeddings").where("vec_id < 60").collect()
    monkeypatch.setattr(training_plans, "read", lambda spark, *_: spark.createDataFrame(rows))
    got = [tuple(r) for r in training_plans.latent_train(spark, "").collect()]
    x = np.array([[*r["embedding"], 1.0] for r in rows])
    want = plain_rounds(x, np.array([r["label"] < 5 for r in rows]), training_plans.COST, training_plans.ROUNDS, training_plans.MININGS, 6)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=2e-6)
    assert all(b[3] <= a[3] + 1e-6 for a, b in zip(got, got[1:], strict=False))

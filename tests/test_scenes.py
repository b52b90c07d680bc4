"""Tiled joins, array bootstrap and error listing against plain versions."""

import random

import numpy as np
import pytest

from boxlens.operators import bootstrap, evaluation, running, selection, spatial
from boxlens.sources.fixtures import scene_boxes, scene_windows
from tests.test_boxes import DET, GT, random_tables

SIDES = "x1 long, y1 long, x2 long, y2 long"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    size = lambda r: (r[2] - r[0] + 1) * (r[3] - r[1] + 1)
    return w * h / (size(a) + size(b) - w * h) if w > 0 and h > 0 else 0.0


def boxes_of(rng, n, widest):
    out = []
    for _ in range(n):
        x, y = rng.randint(-500, 500), rng.randint(-500, 500)
        out.append((x, y, x + rng.choice([0, 3, 20, rng.randint(0, widest)]), y + rng.choice([0, 5, 31, rng.randint(0, widest)])))
    return out


@pytest.mark.parametrize("widest,side", [(40, None), (900, None), (900, 1), (900, 4096), (0, None)])
def test_tiles_find_what_all_pairs_find(spark, widest, side):
    """Boxes of one size and of very different ones, on both sides of zero, touching at a pixel; two images; boxes without pixels."""
    rng = random.Random(widest)
    w, b = boxes_of(rng, 120, widest), boxes_of(rng, 90, widest)
    w += [(0, 0, -1, 5), (7, 7, 7, 7), (63, 63, 64, 64)]
    b += [(7, 7, 7, 7), (8, 8, 9, 9), (64, 64, 128, 128), (5, 5, 4, 9)]
    windows = spark.createDataFrame([(k % 2, k, *x, "c") for k, x in enumerate(w)], f"image_id long, window_id long, {SIDES}, _k string")
    boxes = spark.createDataFrame([(k % 2, k, *x) for k, x in enumerate(b)], f"image_id long, box_id long, {SIDES}")
    got = [(r["w_window_id"], r["b_box_id"], round(r["iou"], 9)) for r in spatial.overlaps(windows, boxes, ["image_id"], side).collect()]
    ok = lambda r: r[2] >= r[0] and r[3] >= r[1]
    want = [(i, j, round(overlap(x, y), 9)) for i, x in enumerate(w) for j, y in enumerate(b) if i % 2 == j % 2 and ok(x) and ok(y) and overlap(x, y)]
    assert sorted(got) == sorted(want)
    best = {r["window_id"]: (r["box_id"], round(r["iou"], 9)) for r in spatial.best_overlap(windows, boxes, ["image_id"], "box_id", side).collect()}
    for i in range(len(w)):
        mine = [(-v, j) for k, j, v in want if k == i]
        assert best[i] == ((min(mine)[1], -min(mine)[0]) if mine else (None, 0.0))


def test_tiles_of_nothing(spark):
    none = spark.createDataFrame([], f"image_id long, window_id long, {SIDES}")
    boxes = spark.createDataFrame([(0, 1, 0, 0, 5, 5)], f"image_id long, box_id long, {SIDES}")
    assert spatial.overlaps(none, boxes, ["image_id"]).collect() == []
    assert spatial.overlaps(boxes.withColumnRenamed("box_id", "window_id"), none.withColumnRenamed("window_id", "box_id"), ["image_id"]).collect() == []


def test_pairs_tested_do_not_grow_with_the_table(spark):
    """Ten times the rows: as many pairs share a tile for each window."""
    tested = []
    for sf in ("sf0.001", "sf0.01"):
        w, b = (f(spark, f"/root/testdata/{sf}") for f in (scene_windows, scene_boxes))
        tested.append(spatial.meetings(w, b, ["image_id"]).count() / w.count())
    assert tested[1] < 1.3 * tested[0] and tested[1] < 12


def drawn_ap(outcomes, npos, times):
    """Step by step: each detection as often as its image was drawn."""
    tp = fp = 0
    points = []
    for image, outcome in outcomes:
        n = times.get(image, 0)
        tp, fp = tp + n * (outcome == "tp"), fp + n * (outcome == "fp")
        points.append((n * (outcome == "tp"), tp / (tp + fp) if tp + fp else 0.0))
    total = sum(n for n in (npos.get(i, 0) * t for i, t in times.items()))
    best = area = 0.0
    for n, p in reversed(points):
        best = max(best, p)
        area += n * best
    return total, area / total if total else None


@pytest.mark.parametrize("block,chunk", [(8192, 256), (5, 3)])
def test_resamples_against_steps(spark, monkeypatch, block, chunk):
    """Many blocks and one, many chunks and one; ties of scores; classes without detections or without objects."""
    monkeypatch.setattr(bootstrap, "BLOCK_ROWS", block)
    monkeypatch.setattr(bootstrap, "CHUNK", chunk)
    rng = random.Random(block)
    rows = [(rng.randrange(6), rng.choice([0, 0, 1, 3]), k, float(rng.randint(-5, 5)), rng.choice(["tp", "fp", "fp", "ignored"])) for k in range(240)]
    gt = [(k, rng.randrange(6), rng.choice([0, 1, 2]), rng.random() < 0.2) for k in range(60)]
    draws = {r: {} for r in range(20)}
    for r in draws:
        for _ in range(6):
            i = rng.randrange(6)
            draws[r][i] = draws[r].get(i, 0) + 1
    outcomes = spark.createDataFrame(rows, "image_id long, cls_id long, det_id long, score double, outcome string")
    objects = spark.createDataFrame(gt, "gt_id long, image_id long, cls_id long, difficult boolean")
    table = spark.createDataFrame([(r, i, t) for r, d in draws.items() for i, t in d.items()], "replicate long, image_id long, times long")
    got = {(r["cls_id"], r["replicate"]): (r["npos"], r["ap"]) for r in bootstrap.resampled_ap(outcomes, objects, table, 20).collect()}
    want = {}
    for cls in range(4):
        own = [(i, o) for i, c, k, s, o in sorted(rows, key=lambda r: (-r[3], -r[2])) if c == cls]
        npos = {}
        for _, i, c, difficult in gt:
            npos[i] = npos.get(i, 0) + (c == cls and not difficult)
        for r, times in [*draws.items(), (-1, {i: 1 for i in range(6)})]:
            n, ap = drawn_ap(own, npos, times)
            if n:
                want[cls, r] = (n, ap)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)


def test_bootstrap_asserts_the_plain_value(spark, monkeypatch):
    det, gt = random_tables(4)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)
    draws = spark.createDataFrame([(0, 0, 3), (1, 1, 2)], "replicate long, image_id long, times long")
    _, spread = bootstrap.bootstrap(d, g, draws, 2)
    assert all(r["sane"] for r in spread.collect())
    held = bootstrap.ap_of_outcomes
    monkeypatch.setattr(bootstrap, "ap_of_outcomes", lambda *a: held(*a).withColumn("ap", running.F.col("ap") + 0.5))
    with pytest.raises(ValueError, match="average precision"):
        bootstrap.bootstrap(d, g, draws, 2)


def listed(det, gt, n, most_recall):
    """One detection after the other, best first."""
    wrong, missed = [], []
    for cls in sorted({d[2] for d in det} | {g[2] for g in gt}):
        own = {g[0]: g for g in gt if g[2] == cls}
        npos = sum(not g[7] for g in own.values())
        claimed, near, tp, fp = {}, {}, 0, 0
        for rank, d in enumerate(sorted((d for d in det if d[2] == cls), key=lambda d: (-d[8], -d[0]))[:n], 1):
            met = sorted((-overlap(d[4:8], g[3:7]), k) for k, g in own.items() if g[1] == d[1] and overlap(d[4:8], g[3:7]))
            best, obj = (-met[0][0], met[0][1]) if met else (None, None)
            if obj is not None and best > near.get(obj, (0, 0))[0]:
                near[obj] = (best, d[0])
            kind = "false_positive"
            if obj is not None and best >= 0.5:
                kind = "ignored" if own[obj][7] else "multiple_detection" if obj in claimed else "tp"
            if kind == "tp":
                claimed[obj] = d[0]
            tp, fp = tp + (kind == "tp"), fp + (kind in ("false_positive", "multiple_detection"))
            if kind in ("false_positive", "multiple_detection") and (not npos or tp / npos <= most_recall):
                wrong.append((cls, rank, d[0], kind, best and round(best, 9), obj, claimed.get(obj) if kind == "multiple_detection" else None, round(tp / (tp + fp), 9)))
        missed += [(cls, k, *(near.get(k) or (None, None))) for k, g in own.items() if not g[7] and k not in claimed]
    return wrong, missed


@pytest.mark.parametrize("n,recall", [(2000, 1.0), (12, 1.0), (2000, 0.2)])
def test_error_listing_against_steps(spark, n, recall):
    rng = random.Random(n)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(5, 30), y + rng.randint(5, 30)))(rng.randint(0, 40), rng.randint(0, 40))
    det = [(k, rng.randrange(3), rng.randrange(2), 1, *box(), float(rng.randint(-9, 9))) for k in range(150)]
    gt = [(k, rng.randrange(3), rng.randrange(3), *box(), rng.random() < 0.2, False) for k in range(40)]
    d = spark.createDataFrame(det, "det_id long, image_id long, cls_id long, comp long, x1 long, y1 long, x2 long, y2 long, score double")
    g = spark.createDataFrame(gt, "gt_id long, image_id long, cls_id long, x1 long, y1 long, x2 long, y2 long, difficult boolean, truncated boolean")
    found = evaluation.error_listing(d, g, n, recall)
    wrong, missed = listed(det, gt, n, recall)
    got = [(r["cls_id"], r["rank"], r["det_id"], r["kind"], r["overlap"] and round(r["overlap"], 9), r["gt_id"], r["claimant"], round(r["precision"], 9)) for r in found.of.collect()]
    assert sorted(got, key=repr) == sorted(wrong, key=repr)
    assert sorted(((r["cls_id"], r["gt_id"], r["overlap"], r["det_id"]) for r in found.missed.collect()), key=repr) == sorted(missed, key=repr)


def test_loss_field_is_output_losses(spark):
    rng = random.Random(8)
    near = lambda n: [(x, y, x + rng.randint(10, 40), y + rng.randint(10, 40)) for x, y in ((rng.randint(0, 150), rng.randint(0, 150)) for _ in range(n))]
    w, b = near(60), near(25)
    w += b[:10]
    windows = spark.createDataFrame([(0, k, *x) for k, x in enumerate(w)], f"image_id long, w long, {SIDES}")
    boxes = spark.createDataFrame([(0, k, *x) for k, x in enumerate(b)], f"image_id long, b long, {SIDES}")
    got = {(r["example_id"], r["cell_id"]): r["loss"] for r in selection.loss_field(windows, boxes, ["image_id"], "w", "b").collect()}
    cells = spark.createDataFrame([(e, k, *x) for e in range(len(b)) for k, x in enumerate(w)], f"example_id long, cell_id long, {SIDES}")
    own = spark.createDataFrame([(e, *x) for e, x in enumerate(b)], f"example_id long, {SIDES}")
    others = spark.createDataFrame([(e, *y) for e in range(len(b)) for k, y in enumerate(b) if k != e], f"example_id long, {SIDES}")
    want = {(r["example_id"], r["cell_id"]): r["loss"] for r in selection.output_losses(cells, own, others).collect()}
    assert got == want and len(set(want.values())) == 3 and np.isneginf(min(want.values()))


def test_draws_of_an_image_are_bytes(spark):
    """A byte a resample, more only where one drew an image over 255 times."""
    draws = spark.createDataFrame([(0, 4, 3), (9, 4, 1), (2, 5, 70000)], "replicate long, image_id long, times long")
    got = {r["image_id"]: r["w"] for r in bootstrap.draw_arrays(draws, 10).collect()}
    assert len(got[4]) == 10 and bootstrap._times(got[4], 10).tolist() == [3, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert len(got[5]) == 30 and bootstrap._times(got[5], 10).tolist() == [0, 0, 70000, 0, 0, 0, 0, 0, 0, 0]


def test_tiles_copy_a_window_a_few_times(spark):
    """Few large boxes cost a copy of a window, not one for each of their sizes."""
    w, b = (f(spark, "/root/testdata/sf0.01") for f in (scene_windows, scene_boxes))
    lowest, top, of_windows, of_boxes = spatial.grid(w, b)
    assert of_windows == of_boxes == [0, top]
    many = b.withColumn("x2", running.F.when(running.F.col("box_id") % 3 == 0, running.F.col("x2") + 2000 * (1 + running.F.col("box_id") % 2)).otherwise(running.F.col("x2")))
    assert spatial.grid(w, many, 256)[1] is None

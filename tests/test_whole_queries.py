"""Queries over all rows, against plain versions."""

import numpy as np
import pytest

from boxlens.operators import rescoring
from boxlens.operators.matching import claim_labels
from boxlens.plans import catalog, evaluation_plans
from boxlens.sources.fixtures import CLASSES, HEIGHT, WIDTH, det, gt, read

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def test_bootstrap_draws_a_thousand(spark):
    rows = QUERIES["bootstrap_ap_whole"](spark, SF).collect()
    assert {r["replicate"] for r in rows} == set(range(1000))
    few = {tuple(r) for r in QUERIES["bootstrap_ap"](spark, SF).collect()}
    assert {tuple(r) for r in rows if r["replicate"] < 5} == few


def test_flips_are_all_made(spark):
    diffs = {r["cls_id"]: r["diff"] for r in evaluation_plans.differences(spark, SF).collect()}
    units, values = np.array(list(diffs), np.int64), np.array(list(diffs.values()))
    turn = (np.arange(100_000)[:, None] * 2654435761 + units * 40503 + 1) % 4294967296 // 65536 % 2
    means = np.where(turn == 0, values, -values).mean(axis=1)
    extreme = int((np.abs(means) >= abs(values.mean()) - 1e-12).sum())
    got = QUERIES["paired_sign_flip_whole"](spark, SF).first()
    assert (got["extreme"], got["p"]) == (extreme, pytest.approx(extreme / 100_000))


def test_negative_images_by_all_objects(spark):
    images = {r[0] for r in det(spark, SF).select("image_id").distinct().collect()}
    held = {tuple(r) for r in gt(spark, SF).select("cls_id", "image_id").collect()}
    got = [(r["cls_id"], r["image_id"]) for r in QUERIES["negative_images"](spark, SF).collect()]
    assert sorted(got) == sorted((c, i) for c in range(CLASSES) for i in images if (c, i) not in held)


def iou(a, b):
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]) + 1, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]) + 1
    size = lambda r: (r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1)
    both = max(0, w) * max(0, h)
    return both / (size(a) + size(b) - both)


def test_losses_of_all_objects(spark):
    place = lambda r: (r["image_id"], r["cls_id"])
    windows, objects, want = {}, {}, {}
    for r in det(spark, SF).collect():
        windows.setdefault(place(r), []).append(r)
    for r in gt(spark, SF).collect():
        objects.setdefault(place(r), []).append(r)
    for at, here in objects.items():
        for e in here:
            for d in windows.get(at, []):
                own, other = iou(d, e), any(iou(d, o) >= 0.5 for o in here if o["gt_id"] != e["gt_id"])
                want[e["gt_id"], d["det_id"]] = -1e9 if own < 0.1 or other else float(own < 0.5)
    assert {(r["example_id"], r["cell_id"]): r["loss"] for r in QUERIES["loss_field"](spark, SF).collect()} == want


def test_deformation_of_all_images(spark):
    assert {r["image_id"] for r in QUERIES["deformation_bounded"](spark, SF).collect()} == {r[0] // 2048 for r in read(spark, SF, "orders").select("o_orderkey").collect()}


def test_gram_matrix_of_all_dimensions(spark):
    v = np.array([r[0] for r in read(spark, SF, "embeddings").select("embedding").collect()], np.float64)
    got = {(r["i"] - 1, r["j"] - 1): r["g"] for r in QUERIES["gram_matrix"](spark, SF).collect()}
    want = v.T @ v / len(v)
    assert len(got) == 64 * 64 and all(abs(g - want[k]) < 2e-6 for k, g in got.items())


def test_context_scores_against_numpy(spark):
    d = det(spark, SF)
    rows = rescoring.context_features(d, rescoring.class_maxima(d, CLASSES), WIDTH, HEIGHT, CLASSES)
    x = {r["det_id"]: r["x"] for r in rows.collect()}
    labels = {r["det_id"]: r["label"] for r in claim_labels(d, gt(spark, SF)).collect() if r["label"]}
    z, y = rescoring.expanded(np.array([x[k] for k in labels])), np.array(list(labels.values()), float)
    w = speed = np.zeros(z.shape[1])
    for _ in range(40):
        c = np.where(y > 0, 2.0, 1.0) * np.maximum(0, 1 - y * (z @ w))
        speed = 0.9 * speed - 0.1 * (-(c * y) @ z / len(y) + 1e-3 * w)
        w = w + speed
    got = {r["det_id"]: r["score"] for r in QUERIES["context_rescore"](spark, SF).collect()}
    assert set(got) == set(x)
    assert np.allclose([got[k] for k in x], rescoring.expanded(np.array(list(x.values()))) @ w, rtol=1e-6, atol=1e-6)


def test_context_machine_needs_no_columns_of_products(monkeypatch):
    """Scores and gradients by forms are those of the expanded rows, also in parts of an Arrow batch that is a slice."""
    import pyarrow as pa

    x, rng = np.random.default_rng(1).uniform(size=(23, 6)), np.random.default_rng(2)
    z = rescoring.expanded(x)
    w, c = rng.normal(size=z.shape[1]), rng.normal(size=23)
    assert np.allclose(rescoring.scored(x, w), z @ w) and np.allclose(rescoring.weighted(x, c), c @ z)
    monkeypatch.setattr(rescoring, "ROWS", 5)
    batch = pa.RecordBatch.from_pydict({"x": x.tolist()}).slice(3, 17)
    parts = list(rescoring.matrices(batch))
    assert [len(p) for p, _ in parts] == [5, 5, 5, 2] and np.array_equal(np.concatenate([p for p, _ in parts]), x[3:20])
    assert np.array_equal(np.concatenate([x[3:20][at] for _, at in parts]), x[3:20])

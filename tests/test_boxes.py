import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxlens.functions import boxes
from boxlens.operators import bootstrap, evaluation, grammar, matching, ranking, running, selection, suppression
from pyspark.sql import functions as F

DET = "det_id long, image_id long, cls_id long, x1 long, y1 long, x2 long, y2 long, score double"
GT = "gt_id long, image_id long, cls_id long, x1 long, y1 long, x2 long, y2 long, difficult boolean"


def random_tables(seed, n=120, m=25):
    rng = np.random.default_rng(seed)
    box = lambda: (lambda x, y, w, h: (int(x), int(y), int(x + w), int(y + h)))(rng.integers(1, 40), rng.integers(1, 40), rng.integers(5, 25), rng.integers(5, 25))
    det = [(k, int(rng.integers(3)), int(rng.integers(2)), *box(), float(rng.integers(-5, 6)) / 2) for k in range(n)]
    gt = [(k, int(rng.integers(3)), int(rng.integers(2)), *box(), bool(rng.random() < 0.2)) for k in range(m)]
    return det, gt


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0] + 1) * (r[3] - r[1] + 1)
    return w * h / (area(a) + area(b) - w * h)


def sequential_ap(det, gt, cls, least=0.5):
    """A literal walk down the scores."""
    claimed, tp, fp, points = set(), 0, 0, []
    npos = sum(not g[7] for g in gt if g[2] == cls)
    for d in sorted((d for d in det if d[2] == cls), key=lambda d: (-d[7], -d[0])):
        best, which = 0.0, None
        for g in gt:
            if g[1] == d[1] and g[2] == cls and iou(d[3:7], g[3:7]) > best:
                best, which = iou(d[3:7], g[3:7]), g
        hit = False
        if which is not None and best >= least:
            if not which[7]:
                if which[0] in claimed:
                    fp += 1
                else:
                    claimed.add(which[0])
                    tp, hit = tp + 1, True
        else:
            fp += 1
        points.append((hit, tp / (tp + fp) if tp + fp else 0.0))
    return sum(max(p for _, p in points[k:]) for k, (hit, _) in enumerate(points) if hit) / npos if npos else None


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ap_against_a_walk(spark, seed):
    det, gt = random_tables(seed)
    got = {r["cls_id"]: r["ap"] for r in evaluation.ap_per_class(spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)).collect()}
    for cls in (0, 1):
        assert got[cls] == pytest.approx(sequential_ap(det, gt, cls), abs=1e-9) and 0 <= got[cls] <= 1


def test_bootstrap_of_each_image_once_is_the_ap(spark):
    det, gt = random_tables(3)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)
    draws = spark.createDataFrame([(0, k, 1) for k in range(3)], "replicate long, image_id long, times long")
    plain = {r["cls_id"]: r["ap"] for r in evaluation.ap_per_class(d, g).collect()}
    drawn = bootstrap.resampled_ap(evaluation.outcomes_of(d, g), g, draws, 1).collect()
    for replicate in (0, -1):
        assert {r["cls_id"]: r["ap"] for r in drawn if r["replicate"] == replicate} == pytest.approx(plain)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 20), st.integers(1, 20), st.integers(-3, 3)), max_size=25), st.sampled_from([0.3, 0.5, 0.7]))
def test_suppression_invariants(rows, threshold):
    b = np.array([(x, y, x + w, y + h) for x, y, w, h, _ in rows], float).reshape(-1, 4)
    s, ids = np.array([r[4] for r in rows], float), np.arange(len(rows))
    kept = suppression.keep(b, s, ids, threshold).tolist()
    cover = lambda i, j: max(0, min(b[i, 2], b[j, 2]) - max(b[i, 0], b[j, 0]) + 1) * max(0, min(b[i, 3], b[j, 3]) - max(b[i, 1], b[j, 1]) + 1) / ((b[j, 2] - b[j, 0] + 1) * (b[j, 3] - b[j, 1] + 1))
    before = lambda i, j: (s[i], i) > (s[j], j)
    assert not any(cover(i, j) > threshold for i in kept for j in kept if before(i, j))
    assert all(any(cover(i, j) > threshold and before(i, j) for i in kept) for j in range(len(rows)) if j not in kept)


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_suppression_over_batch_ends(spark, batch):
    """Groups that go over the ends of Arrow batches, null keys and an empty table."""
    det, _ = random_tables(9, n=150)
    det = [(*d[:1], None if d[1] == 2 else d[1], *d[2:]) for d in det]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(det, DET)
        got = sorted(r["det_id"] for r in suppression.suppress(df, ["image_id", "cls_id"], 0.3).collect())
        assert suppression.suppress(df.where("det_id < 0"), ["image_id"]).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for group in {d[1:3] for d in det}:
        rows = [d for d in det if d[1:3] == group]
        b = np.array([r[3:7] for r in rows], float)
        want += [rows[k][0] for k in suppression.keep(b, np.array([r[7] for r in rows]), np.array([r[0] for r in rows]), 0.3)]
    assert got == sorted(want)


def test_equal_scores_prefer_the_larger_id():
    b = np.array([[1, 1, 10, 10], [1, 1, 10, 10]], float)
    assert suppression.keep(b, np.array([1.0, 1.0]), np.array([4, 9]), 0.5).tolist() == [1]


def test_clip_mirror_and_iou(spark):
    det, gt = random_tables(4)
    d = spark.createDataFrame(det, DET)
    once = selection.clip(d, 30, 30)
    assert sorted(map(tuple, selection.clip(once, 30, 30).collect())) == sorted(map(tuple, once.collect()))
    g = spark.createDataFrame(gt, GT)
    twice = g.select("gt_id", *boxes.mirrored(100)).select("gt_id", *boxes.mirrored(100))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, g.select("gt_id", "x1", "y1", "x2", "y2").collect()))
    pairs = matching.overlapping_pairs(d, g).select("d_x1", "d_y1", "d_x2", "d_y2", "g_x1", "g_y1", "g_x2", "g_y2", "iou", boxes.iou("g_", "d_").alias("back")).collect()
    assert pairs and all(r["iou"] == pytest.approx(iou(r[0:4], r[4:8])) and r["iou"] == r["back"] and 0 < r["iou"] <= 1 for r in pairs)


def test_claims_with_a_difficult_match_are_neither(spark):
    gt = [(1, 0, 0, 1, 1, 10, 10, True), (2, 0, 0, 31, 31, 40, 40, False)]
    det = [(1, 0, 0, 1, 1, 10, 10, 3.0), (2, 0, 0, 31, 31, 40, 40, 2.0), (3, 0, 0, 31, 31, 40, 40, 2.0), (4, 0, 0, 90, 90, 95, 95, 1.0)]
    got = {r["det_id"]: r["outcome"] for r in matching.claims(spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)).collect()}
    assert got == {1: "ignored", 2: "fp", 3: "tp", 4: "fp"}


@pytest.mark.parametrize("cuts", [[], [0.0], [-1.0, 0.5, 2.0]])
def test_running_in_ranges(spark, cuts):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(rng.integers(3)), float(rng.integers(-4, 5)) / 2, int(rng.integers(5))) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, g long, s double, v long")
    got = running.running(df, ["g"], "s", [F.desc("s"), F.desc("id")], cuts, {"t": F.col("v")}, number="rn")
    got = {r["id"]: r for r in running.best_from_here(got, ["g"], "rn", "v", "best").collect()}
    for g in range(3):
        total, order = 0, sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], -r[0]))
        for k, r in enumerate(order):
            total += r[3]
            assert (got[r[0]]["t"], got[r[0]]["rn"], got[r[0]]["best"]) == (total, k + 1, max(x[3] for x in order[k:]))


def test_row_numbers_without_one_task(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(20)), k) for k in range(300)]
    got = ranking.number_rows(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], "n").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows) and sorted(r["n"] for r in got) == list(range(1, 301))
    assert ranking.number_rows(spark.createDataFrame([], "a long, b long"), ["a", "b"], "n").collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 19, 20, 21, 100])
def test_percentile_rules(spark, n):
    df = spark.createDataFrame([(0, float(k)) for k in range(1, n + 1)], "g long, v double")
    assert ranking.low_percentile(df, ["g"], "v", 0.05, "t").first()["t"] == np.ceil(0.05 * n)
    assert ranking.floor_element(df, "v", "v", 0.2, 0.0, 1e9).first()["value"] == max(1, np.floor(0.2 * n))


def test_quantile_buckets_keep_ties_together(spark):
    values = [1.0] * 7 + [2.0, 3.0, 4.0, 5.0]
    got = ranking.quantile_buckets(spark.createDataFrame([(v,) for v in values], "v double"), "v", 3).collect()
    order, n = sorted(values), len(values)
    cuts = [order[int(np.ceil(i * n / 3))] for i in (1, 2)]
    assert sorted((r["v"], r["bucket"]) for r in got) == sorted((v, 1 + sum(v >= c for c in cuts)) for v in values)
    assert len({r["bucket"] for r in got if r["v"] == 1.0}) == 1


def test_top_with_ties(spark):
    df = spark.createDataFrame([(0, s) for s in (5.0, 4.0, 4.0, 3.0)], "g long, s double")
    assert sorted(r["s"] for r in ranking.top_with_ties(df, ["g"], "s", 2).collect()) == [4.0, 4.0, 5.0]


def test_copies_of_objects_make_no_pairs(spark):
    """Ten objects of each box, as growing tables bring them: as many pairs as of one each, the same matches, and no aggregate over more than different boxes."""
    det, gt = random_tables(7)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)
    more = g.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("gt_id", F.col("gt_id") + 1000 * F.col("k")).withColumn("difficult", ~F.col("difficult")).drop("k")
    copies = g.unionByName(more)
    one, many = (matching.box_meetings(d, t).count() for t in (g, copies))
    assert one == many > 0
    plain = {}
    for r in matching.overlapping_pairs(d, copies).collect():
        k = (-r["iou"], r["g_gt_id"], r["g_difficult"])
        plain[r["d_det_id"]] = min(plain.get(r["d_det_id"], k), k)
    for least in (None, 0.5):
        got = {r["det_id"]: (-r["iou"], r["gt_id"], r["difficult"]) for r in matching.best_match(d, copies, least).collect()}
        assert got == {k: v for k, v in plain.items() if -v[0] >= (least or 0)}


def copied(spark, seed, n=12):
    """Detections, and n objects of each box."""
    det, gt = random_tables(seed)
    more = [(g[0] + 1000 * k, *g[1:]) for g in gt for k in range(n)]
    return det, more, spark.createDataFrame(det, DET), spark.createDataFrame(more, GT)


def test_pairs_stand_for_copies_in_lists(spark, monkeypatch):
    """Rows of every pair, from joins of different boxes whose objects are listed five a row."""
    monkeypatch.setattr(matching, "LISTED", 5)
    _, gt, d, g = copied(spark, 11)
    lists = matching.listed(g, matching.KEYS, "gt_id").collect()
    assert len(lists) <= len(gt) / 4 and sorted(i for r in lists for i in r["ids"]) == sorted(x[0] for x in gt)
    want = [(r["d_det_id"], r["g_gt_id"], round(r["iou"], 9)) for r in matching.overlapping_pairs(d, g).collect()]
    assert want and sorted(map(tuple, matching.pairs_of_copies(d, g).collect())) == sorted(want)


def test_beliefs_and_rivals_of_copies(spark, monkeypatch):
    monkeypatch.setattr(matching, "LISTED", 5)
    _, _, d, g = copied(spark, 12)
    pairs, want = matching.overlapping_pairs(d, g).collect(), []
    for k in {r["g_gt_id"] for r in pairs}:
        own = [r for r in pairs if r["g_gt_id"] == k]
        b = min((r for r in own if r["iou"] >= 0.3), key=lambda r: (-r["d_score"], r["d_det_id"]), default=None)
        for r in own if b else ():
            raised = r["d_score"] + (r["iou"] < 0.5)
            if r["d_det_id"] == b["d_det_id"]:
                want.append((k, r["d_det_id"], r["d_score"], True))
            elif any(r["d_" + c] != b["d_" + c] for c in boxes.SIDES) and raised >= b["d_score"] - 0.01:
                want.append((k, r["d_det_id"], raised, False))
    found = grammar.belief_and_rivals(d, g, 0.3)
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


def test_losses_of_copies(spark, monkeypatch):
    monkeypatch.setattr(matching, "LISTED", 5)
    det, gt, d, g = copied(spark, 13)
    want = []
    for e in gt:
        for x in (x for x in det if x[1:3] == e[1:3]):
            own, others = iou(x[3:7], e[3:7]), any(iou(x[3:7], o[3:7]) >= 0.5 for o in gt if o[1:3] == e[1:3] and o[0] != e[0])
            want.append((e[0], x[0], float("-inf") if own < 0.1 or others else float(own < 0.5)))
    got = selection.loss_field(d, g, matching.KEYS, "det_id", "gt_id")
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 200])
def test_ranges_by_halving(spark, n):
    cuts = [float(2 * k) for k in range(n)]
    got = {r["v"]: r["b"] for r in spark.range(-3, 2 * n + 3).select(F.col("id").alias("v"), ranking._bucket("id", cuts).alias("b")).collect()}
    assert got == {v: sum(c <= v for c in cuts) for v in got} and len(got) == 2 * n + 6
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(ranking._bucket("id", cuts).alias("b")).first()["b"] == 0

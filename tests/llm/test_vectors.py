import numpy as np
import pytest

from boxlens.llm import embedding_join, vector_search
from tests.llm import helpers

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v], 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute_links(vectors, ids, threshold=0.95):
    v = vectors.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T >= threshold
    order = np.argsort(ids)
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    root = helpers.components(len(ids), [(rank[i], rank[j]) for i, j in zip(*np.nonzero(s), strict=True) if i != j])
    return {int(ids[i]): (int(s[i].sum()) - 1, int(ids[order[root[rank[i]]]])) for i in range(len(ids))}


@pytest.mark.parametrize("cell,block", [(8192, 1 << 24), (5, 1 << 24), (5, 2048)])
def test_join_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_join, "CELL_ROWS", cell)
    monkeypatch.setattr(embedding_join, "BLOCK_BYTES", block)
    v = helpers.vectors_near(1, spread=0.2)
    v = np.concatenate([v, v[:30], v[:5] * 3])
    ids = np.random.default_rng(0).permutation(1000)[: len(v)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.near_vectors(frame(spark, v, ids)).collect()}
    want = brute_links(v, ids)
    assert got == want and any(n > 5 for n, _ in want.values())


def test_join_in_parts_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "MOST_PAIRS", 50)
    v = helpers.vectors_near(2, clusters=2, each=60, spread=0.1, alone=10)
    ids = np.arange(len(v))
    x = embedding_join.unit(v.ravel(), v.shape[1])
    shadow = embedding_join.shadows(x, np.linalg.qr(np.random.default_rng(0).standard_normal((16, 4)))[0])
    for s in (None, shadow):
        pairs = [p for i, j in embedding_join._pairs(x, x.astype(np.float32), s, ids, ids, 0.95) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(pairs) == sorted(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.95)), strict=True))


def test_pivots_prune_clustered_vectors():
    """Default parameters, at a size that once had no pivots: few copies, under a fifth of all pairs. Random vectors keep the fewest pivots. The bound in a cell leaves next to none of random pairs."""
    radius = float(np.sqrt(0.1))
    v = helpers.vectors_near(3, dim=64, clusters=60, each=50, spread=0.08, alone=0)
    x = embedding_join.unit(v[np.random.default_rng(0).permutation(len(v))].ravel(), 64)
    pivots = embedding_join.cheapest(x[:1024], len(x), radius)
    copies, share = embedding_join.expected(x, pivots, radius)
    assert len(pivots) > embedding_join.LEAST_PIVOTS and share < 0.2 and copies < 4
    x = embedding_join.unit(np.random.default_rng(1).standard_normal(64 * 1000), 64)
    pivots = embedding_join.cheapest(x, len(x), radius)
    assert len(pivots) == embedding_join.LEAST_PIVOTS
    shadow = embedding_join.shadows(x, embedding_join.shadow_basis(pivots))
    bound = shadow @ shadow.T
    assert (bound >= x @ x.T - 1e-5).all() and (bound >= 0.95).mean() < 0.01


def test_join_of_many_vectors_with_default_parameters(spark):
    v = np.concatenate([helpers.vectors_near(4, dim=64, clusters=40, each=30, spread=0.1, alone=300), helpers.vectors_near(5, dim=64, clusters=1, each=400, spread=0.2, alone=0)])
    ids = np.random.default_rng(0).permutation(10_000)[: len(v)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.near_vectors(frame(spark, v, ids)).collect()}
    assert got == brute_links(v, ids)


def test_join_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0), (7, [float("inf"), 1.0], 0), (None, [1.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [], 0), (10, [1e-30, 0.0], 0)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embedding_join.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, 0, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 3, 1, False)]
    assert embedding_join.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_nearest(v, ids, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (v.astype(np.float64) * v[q].astype(np.float64)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_search_recall(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_search, "BLOCK_BYTES", 700 * 8 * 32)
    monkeypatch.setattr(vector_search, "QUERY_BYTES", 40 * 8 * 32)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((2000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if scale:
        v *= rng.uniform(0.5, 2, (len(v), 1)).astype(np.float32)
    ids = np.arange(2000)
    df = frame(spark, v, ids)
    got: dict = {}
    for r in sorted(vector_search.nearest(df, df.where("vec_id % 20 = 0")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(v, ids, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        assert np.allclose([s for _, s in rows], [float((v[i].astype(np.float64) * v[q].astype(np.float64)).sum()) for i, _ in rows])


def test_search_ties_few_candidates_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (7, None, 0), (40, None, 0), (9, [float("nan"), 0.0], 0), (None, [1.0, 1.0], 0), (60, [1.0, 0.0, 0.0], 0), (11, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 5, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 3, 0.0), (20, 3, 5, 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_search.nearest(empty, empty).collect() == []


def test_counting_is_exact(monkeypatch):
    monkeypatch.setattr(vector_search, "PLACES", 10_000)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((333, 8))
    index = vector_search.CollisionIndex(v)
    size = np.linalg.norm(v, axis=1)
    shadow = np.c_[v, np.sqrt(np.maximum(size.max() ** 2 - size**2, 0))] / size.max() @ index.lines
    centre = rng.standard_normal((vector_search.PROJECTIONS, 9))
    for width in (1.1, rng.uniform(0.5, 2, 9)):
        want = (np.abs(shadow[None] - centre.T[:, None, :]) <= np.broadcast_to(width, 9)[:, None, None]).sum(axis=2) >= np.ceil(vector_search.COLLISIONS * vector_search.PROJECTIONS)
        got = np.unpackbits(index._collisions(centre, width).view(np.uint8), axis=1, bitorder="little")[:, :333].astype(bool)
        assert (got == want).all()


def test_windows_collide_as_often_as_they_should():
    """A vector at distance d collides on the needed lines of windows of window_factor * d with the wanted probability."""
    rng, lines, needed = np.random.default_rng(0), 128, 99
    for reliable in (0.5, 0.85, 0.95):
        width = vector_search.window_factor(lines, needed, reliable)
        hit = (np.abs(rng.standard_normal((4000, lines))) <= width).sum(axis=1) >= needed
        assert abs(hit.mean() - reliable) < 0.03


def recall_and_share(spark, v, k=20):
    """Recall against brute force, and the share of all rows that a query verified."""
    ids = np.arange(len(v))
    df = spark.createDataFrame([(int(i), [float(x) for x in r], 0) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, label int")
    found = vector_search.written_hits(df, df.where("vec_id % 20 = 0"), k)
    got: dict = {}
    for r in vector_search.ranked(found, k).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scored = v.astype(np.float64)
    recall = []
    for q in range(0, len(v), 20):
        s = scored @ scored[q]
        s[q] = -np.inf
        recall.append(len(got[q] & set(np.lexsort((ids, -s))[:k].tolist())) / k)
    verified = found.where("vec_id is null").agg({"verified": "sum"}).first()[0]
    return float(np.mean(recall)), verified / (len(recall) * len(v))


def test_search_verifies_little_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_ROWS", 90)
    v = helpers.vectors_near(6, dim=64, clusters=150, each=60, spread=0.3, alone=0)
    recall, share = recall_and_share(spark, v[np.random.default_rng(0).permutation(len(v))])
    assert recall >= 0.9 and share < 0.05


def test_search_of_skewed_lengths(spark):
    """Lengths over many orders of magnitude, one vector far longer than all: cells of like lengths keep the recall, and not all is verified."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((2000, 32)) * np.exp(rng.normal(0, 1.0, (2000, 1)))
    v[77] *= 1e6
    recall, share = recall_and_share(spark, v)
    assert recall >= 0.9 and share < 0.6


def test_search_of_extreme_finite_values(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 4))
    v[1] *= 1e200
    v[20] *= 1e-200
    v[40] *= 1e200
    v[3] = 5e-324
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(100, [1.7e308] * 4, 0), (101, [1.7e308, -1.7e308, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got: dict = {}
    for r in sorted(vector_search.nearest(df, df.where("vec_id % 20 = 0")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100} and all(len(x) == 20 for x in got.values())
    x = np.array([r[1] for r in rows])
    with np.errstate(over="ignore", invalid="ignore"):
        for q, found in got.items():
            s = (x * x[[r[0] for r in rows].index(q)]).sum(axis=1)
            by_id = dict(zip([r[0] for r in rows], np.where(np.isnan(s), -np.inf, s), strict=True))
            assert all(by_id[i] == y for i, y in found) and [y for _, y in found] == sorted((y for _, y in found), reverse=True)

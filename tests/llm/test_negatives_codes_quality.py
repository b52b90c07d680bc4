import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from boxlens.llm import hard_negatives, quality, queries, vector_codes

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


# hard negatives


def mined(rows, every=100):
    """By the contract's words; rows (vec_id, vector, label), in Python's whole numbers."""
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        seen[i, label, tuple(v)] = (i, label, [int(np.floor(256 * float(x))) for x in v])
    rows, out = list(seen.values()), []
    for a, own, x in rows:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, label) for i, label, y in rows if (i != a or label != own) and len(y) == len(x)]
        for down, p, _ in sorted(s for s in scored if s[2] == own)[:5]:
            found = sorted(s for s in scored if s[2] != own and 30 * -down <= 100 * -s[0] <= 90 * -down)[:10]
            out += [(a, p, k + 1, n, -down, -score) for k, (score, n, _) in enumerate(found)]
    return sorted(out)


def clustered(seed, n, dim=8, clusters=6, copies=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, dim)) * 2
    v = (centre[rng.integers(0, clusters, n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)
    if copies:
        v[rng.permutation(n)[:copies]] = v[0]
    return [(int(i), [float(x) for x in row], int(rng.integers(0, 4))) for i, row in zip(rng.permutation(n * 3)[:n], v, strict=True)]


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("copies,small", [(0, False), (400, False), (150, True)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, copies, small):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 10)
    if small:  # several blocks and slots in each group, products of few anchors at once
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(hard_negatives, "SLOT", 3)
        monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    rows = clustered(copies, 900, copies=copies)
    want = mined(rows, 10)
    assert len(want) > 500 and got(hard_negatives.mine(frame(spark, rows))) == want


def test_hard_negative_edges(spark, monkeypatch):
    """Nulls, non-finite components, equal rows, ids with two vectors, lengths apart, ties, few rows, extra columns with the names of results."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    v = [[1.0, 0.5], [1.0, 0.5], [0.9, 0.5], [0.4, 0.1], [0.3, 0.2], [0.25, 0.25]]
    rows = [(5 * k, v[k % 6], k % 2) for k in range(12)] + [(k, v[k % 6], k % 3) for k in range(1, 9)]
    rows += [(5, v[0], 1), (5, v[4], 1), (10, v[3], 0), (200, None, 1), (205, [1.0, None], 1), (210, [1.0, float("nan")], 1), (215, [float("inf"), 1.0], 1), (220, v[0], None), (None, v[0], 1)]
    rows += [(300, [1.0, 2.0, 3.0], 0), (301, [1.0, 2.0, 3.0], 0), (302, [1.0, 1.0, 0.5], 1), (400, [], 0), (401, [], 1), (500, [-1.0, 0.0], 0)]
    named = frame(spark, [(*r, 1, 2, 3) for r in rows], SCHEMA + ", cls int, grp int, dist int")
    assert got(hard_negatives.mine(named)) == mined(rows, 5)
    assert hard_negatives.mine(frame(spark, [])).collect() == []
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 0)])).collect() == []
    assert hard_negatives.mine(frame(spark, [(5, [1.0], 0), (6, [1.0], 0)])).collect() == []


def test_products_past_double_precision():
    a, c = np.floor(np.array([[1e9, 3.0]]) * 256), np.floor(np.array([[1e9 + 1, 1.0], [1e30, 0.0]]) * 256)
    assert hard_negatives.products(a / 256, c / 256).tolist() == [[1_000_000_001_000_000_003, hard_negatives.MOST]]
    assert hard_negatives.products(a, -c).tolist() == [[-hard_negatives.MOST, -hard_negatives.MOST]]


def test_rings_keep_what_is_needed_and_prune(spark):
    """Of clustered vectors a group needs few cells' rows; of any, each candidate within the limits lies in its group's ring."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 16)) * 3
    v = (centre[np.arange(1200) % 12] + 0.1 * rng.standard_normal((1200, 16))).astype(np.float32)
    rows = frame(spark, [(int(i), [float(x) for x in r], 0) for i, r in enumerate(v)]).select("vec_id", "label", "embedding")
    w = np.floor(v.astype(np.float64) * 256)
    cells = hard_negatives.choose(rows, float(np.sqrt((w * w).sum(axis=1).max())) + 1, 10**6, 10**8, 16)
    assert len(cells.pivots[16]) > hard_negatives.LEAST_PIVOTS
    placed = hard_negatives.placed(rows, cells, anchors=False).toPandas().set_index("vec_id")
    anchors = hard_negatives.placed(rows.where("vec_id < 60"), cells, anchors=True).toPandas()
    scores = w[:60] @ w.T
    low = np.sort(scores, axis=1)[:, -20]
    asks = spark.createDataFrame([(int(g), [int(t)], [1 << 62], [float(x) for x in v[i]]) for i, (g, t) in enumerate(zip(anchors.sort_values("vec_id")["cell"], low, strict=True))], "grp long, low array<long>, high array<long>, embedding array<float>")
    ring = {(r["grp"], r["cell"]): (r["near"], r["far"]) for r in hard_negatives.rings(asks, cells).collect()}
    served = {g: [k for k, (c, d) in enumerate(zip(placed["cell"].sort_index(), placed["dist"].sort_index(), strict=True)) if (g, c) in ring and ring[g, c][0] <= d <= ring[g, c][1]] for g in {g for g, _ in ring}}
    for i, g in enumerate(anchors.sort_values("vec_id")["cell"]):
        assert set(np.flatnonzero(scores[i] >= low[i])) <= set(served[g])
    assert np.mean([len(x) for x in served.values()]) < 600


def test_random_vectors_keep_the_fewest_groups(spark):
    v = np.random.default_rng(1).standard_normal((800, 32))
    rows = frame(spark, [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]).select("vec_id", "label", "embedding")
    assert len(hard_negatives.choose(rows, 256 * 12.0, 10**4, 10**6, 32).pivots[32]) == hard_negatives.LEAST_PIVOTS


# vector codes


def coded(rows, rounds=6):
    """Plain rounds over whole numbers: rows (vec_id, vector, label) of one length, a multiple of eight."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 8
    part = lambda v, p: v[p * size : p * size + size]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((far(part(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[nearest(v, p)[1] for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for k in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(kept, chosen, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = [[nearest(v, p) for p in range(8)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in final]
    total = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[label], digest) for (i, _, label), f, e in zip(kept, final, errors, strict=True)), key=repr)


def codes_of(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n,spread", [(300, 1.0), (9, 1.0), (200, 0.002)])
def test_codes_against_plain_rounds(spark, n, spread):
    """Many, fewer than the entries, and with many ties: components of few values."""
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in np.float32(rng.standard_normal(16) * spread)], [None, 0, 1, 2][int(rng.integers(0, 4))]) for i in rng.permutation(1000)[:n]]
    rows += [rows[0], rows[1], (None, rows[2][1], 1), (5000, None, 1), (5001, [1.0] * 15 + [None], 1), (5002, [float("inf")] * 16, 1)]
    assert codes_of(vector_codes.compress(frame(spark, [(*r, "x") for r in rows], SCHEMA + ", code string"))) == coded(rows)


def test_codes_edges(spark):
    assert vector_codes.compress(frame(spark, [])).collect() == []
    assert vector_codes.compress(frame(spark, [(1, None, 0)])).collect() == []
    rows = vector_codes.compress(frame(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [0.0] * 5, 0), (3, [1e30, 0.0, 1.0], 0)])).collect()
    found = {r["vec_id"]: (r["code"], r["error"]) for r in rows}
    assert found[1] == ("00" * 8, 0) and found[2] == (None, None) and found[3] == ("010101" + "00" * 5, 0)
    assert [r["code"] for r in vector_codes.compress(frame(spark, [(1, [], 0)])).collect()] == ["00" * 8]


def test_annuli_are_exact_and_prune():
    rng = np.random.default_rng(5)
    entries = rng.integers(-4, 5, (16, 3)) * np.geomspace(1, 1000, 16).astype(np.int64)[:, None]
    entries[7] = entries[3]
    x = np.concatenate([entries[rng.integers(0, 16, 3000)] + rng.integers(-3, 4, (3000, 3)), rng.integers(-3000, 3000, (500, 3)), entries])
    index, best, looked = vector_codes.Annuli(entries).nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert looked < 0.6 * d.size


# quality


def test_quality_held_out(spark):
    rows = queries.op13_quality(spark, SF).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97 and np.mean([g >= 0.7 for g in good]) > 0.95
    assert duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0] == len(rows)


def plain_indicators(text):
    """Without blocks: all n-grams of the bytes and of the outline."""
    on = np.zeros(quality.BINS, bool)
    codes = np.frombuffer(text, np.uint8)
    outline = np.array([s for k, s in enumerate(quality.SIGNS[codes]) if not k or s != quality.SIGNS[codes[k - 1]]], np.uint8)
    for kind, c, sizes in ((1, codes, quality.BYTE_GRAMS), (2, outline, quality.OUTLINE_GRAMS)):
        for n in sizes:
            for k in range(len(c) - n + 1):
                on[quality._grams(c[k : k + n], n, kind)] = True
    return on


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 18])
def test_blocks_give_what_the_whole_gives(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    for text in (b"", b"a", "Ünd THE 42, ... (x)\n\n ñ!!  ab".encode() * 3, b"!" * 70, b"aB" * 50):
        assert (quality.indicators(text) == plain_indicators(text)).all()


def test_dual_descent_reaches_the_least_loss():
    """Against Newton steps over all weights, on few places."""
    rng = np.random.default_rng(0)
    n, used = 80, rng.choice(quality.BINS, 12, replace=False)
    bits = np.zeros((n, quality.BINS), bool)
    bits[:, used] = rng.random((n, 12)) < 0.5
    y = (bits[:, used[0]] | (rng.random(n) < 0.2)).astype(int)
    rows, r = np.packbits(bits, axis=1), np.zeros(quality.BINS)
    r[used] = rng.standard_normal(12)
    w = quality.descend(rows, y, r, epochs=3000, tolerance=1e-9)
    x = bits[:, used] * r[used]
    x = np.c_[x / np.sqrt(np.maximum((x * x).sum(axis=1), 1e-12))[:, None], np.ones(n)]
    sign = np.where(y == 1, 1.0, -1.0)
    c = n / 2 / np.where(y == 1, (y == 1).sum(), (y == 0).sum())
    best = np.zeros(13)
    for _ in range(100):
        inside = sign * (x @ best) < 1
        a = x[inside] * (2 * c[inside])[:, None]
        best = np.linalg.solve(a.T @ x[inside] + np.eye(13), a.T @ sign[inside])
    assert np.allclose(np.r_[w[used], w[-1]], best, atol=1e-5)


def test_quality_edges(spark):
    texts = [(k, ("plain words in a row here. " if k % 2 else "LOUD!! WORDS!! ") * 20) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (3, 1), (500, 7), (501, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(*t, "x", 0.5) for t in texts + [(None, "plain words"), (900, None), (901, ""), (902, "plain words in a row here. " * 200_000), (902, "LOUD!! " * 30)]], "doc_id long, text string, source string, score double")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] not in (None, 902)}
    assert by[900] == by[901] and min(by[k] for k in range(1, 80, 2)) > max(by[k] for k in range(0, 80, 2))
    long_, loud = sorted((r["score"] for r in rows if r["doc_id"] == 902), reverse=True)
    assert long_ > 0.7 > loud
    assert quality.scored(docs.limit(0), model).collect() == []
    only = quality.fit(docs, labels.where("quality = 1"))
    assert {round(r["score"], 6) for r in quality.scored(docs, only).collect()} == {round(1 / (1 + np.exp(-only.shift)), 6)} and only.shift > 3
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}

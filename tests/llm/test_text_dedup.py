import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlens.llm import line_dedup, near_copies, simhash, substring_index
from boxlens.llm.common import Workspace
from boxlens.llm.components import connected_components
from tests.llm import helpers


def shuffled_ids(texts):
    ids = list(range(100, 100 + len(texts)))
    random.Random(5).shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [0, 1])
def test_substrings_against_brute_force(spark, seed):
    rows = shuffled_ids(helpers.sample_texts(seed))
    got = {r["doc_id"]: r for r in substring_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=3).collect()}
    for (doc, _), (n, kept) in zip(rows, helpers.without_repeats([t for _, t in rows]), strict=True):
        assert got[doc]["n_words"] == n and got[doc]["n_removed"] == n - len(kept)
        assert got[doc]["text"].encode() == b" ".join(kept)


def test_substrings_repeated_rows_null_ids_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (None, long + " tail"), (None, None), (7, " ".join(f"v{i}" for i in range(40)))]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0), (0, 51, 50), (1, 50, 50), (1, 50, 50), (7, 40, 0)]
    assert substring_index.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def shared_folder(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def test_index_compacts_to_the_same(spark, tmp_path):
    docs = spark.createDataFrame(shuffled_ids(helpers.sample_texts(3, n=30)), "doc_id long, text string")
    work = Workspace(spark, "test")
    marks = work.write(substring_index.fingerprints(docs), "marks")
    index = substring_index.FingerprintIndex(spark, shared_folder(tmp_path, "index"), work, buckets=3)
    for k in range(3):
        index.append(marks.where(F.pmod("h", F.lit(3)) == k))
    assert len(index.names) == 3
    before = index.rows().groupBy(*substring_index.KEY).agg(F.sum("occurrences").alias("n")).collect()
    index.compact()
    after = index.rows().select(*substring_index.KEY, "occurrences").collect()
    assert len(index.names) == 1 and sorted(map(tuple, before)) == sorted(map(tuple, after))
    assert [p.name for p in (tmp_path / "index" / "runs").iterdir()] == index.names


def test_a_batch_meets_history_without_a_shuffle_of_it(spark, tmp_path):
    docs = spark.createDataFrame(shuffled_ids(helpers.sample_texts(3, n=30)), "doc_id long, text string")
    marks = Workspace(spark, "test").write(substring_index.fingerprints(docs), "marks")
    index = substring_index.FingerprintIndex(spark, shared_folder(tmp_path, "index"), buckets=3)
    a, b = (index.append(marks.where(F.pmod("h", F.lit(2)) == k)) for k in range(2))
    joined = index._run(b).groupBy("anchor").count().join(index._run(a).groupBy("anchor").count().hint("merge"), "anchor")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_batches_are_held_against_history(spark, monkeypatch, tmp_path):
    """Each batch loses what it shares with itself and with the batches before; the folder is opened anew before the last."""
    monkeypatch.setattr(substring_index.FingerprintIndex, "MOST_RUNS", 2)
    rows = shuffled_ids(helpers.sample_texts(6, n=45))
    root = shared_folder(tmp_path, "index")
    index = substring_index.FingerprintIndex(spark, root, buckets=3)
    before: list = []
    for k in range(3):
        if k == 2:
            index.close()
            index = substring_index.FingerprintIndex(spark, root, buckets=99)
            assert index.buckets == 3 and len(index.names) == 2
        batch = rows[k::3]
        frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
        spans: dict = {}
        for r in index.ingest(frame(batch), frame(before) if before else None).collect():
            spans.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n"] + substring_index.WINDOW - 1))
        want = helpers.without_repeats([t for _, t in batch + before])
        for (doc, _), (n, kept) in zip(batch, want, strict=False):
            assert n - len(spans.get(doc, ())) == len(kept)
        before += batch
    assert len(index.names) <= 2


def test_two_writers_of_an_index(spark, tmp_path):
    """The second of two that opened the same state fails and leaves what the first appended."""
    marks = Workspace(spark, "test").write(substring_index.fingerprints(spark.createDataFrame([(1, "a b " * 40)], "doc_id long, text string")), "marks")
    one, two = (substring_index.FingerprintIndex(spark, shared_folder(tmp_path, "index"), buckets=2) for _ in range(2))
    one.append(marks)
    with pytest.raises(RuntimeError):
        two.append(marks)
    assert substring_index.FingerprintIndex(spark, shared_folder(tmp_path, "index")).names == one.names


def test_very_long_texts(spark):
    """Texts of hundreds of thousands of words or lines, one of them twice in itself, are treated whole."""
    half = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, half + " " + half), (2, half + " end"), (3, "\n".join(f"line {i}" for i in range(50_000)) + "\nown"), (4, "\n".join(f"line {i}" for i in range(50_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_index.remove_repeats(docs).collect()}
    assert cut == {1: (200_000, 200_000), 2: (100_001, 100_000), 3: (100_001, 100_000), 4: (100_000, 100_000)}
    gone = {r["doc_id"]: r["n_removed"] for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert gone == {1: 0, 2: 0, 3: 0, 4: 50_000}
    marked = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert all(marked[i][0] == f"{helpers.simhash(t):016x}" for i, t in rows if i > 1) and marked[4][1] == 3


def test_runs_cover_each_window_once():
    rng = np.random.default_rng(0)
    for size in (35, 36, 80, 300):
        h = rng.integers(0, 5, size).astype(np.uint64)  # few hashes: many ties
        begin = np.array([0, size])
        starts, number, _ = substring_index.runs(h, begin)
        assert sorted(w for s, n in zip(starts, number, strict=True) for w in range(s, s + n)) == list(range(size - 34))
        assert number.max() <= substring_index.SPAN


def test_substring_stage_keeps_columns_and_clean_texts(spark):
    texts = helpers.sample_texts(2)
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in shuffled_ids(texts)]
    docs = spark.createDataFrame(rows, helpers.DOCS + ", start string, spans string")
    out = {r["doc_id"]: r for r in substring_index.stage(docs).collect()}
    assert substring_index.stage(docs).columns == docs.columns and len(out) == len(rows)
    for row, (n, kept) in zip(rows, helpers.without_repeats([r[1] for r in rows]), strict=True):
        want = row[1] if len(kept) == n else b" ".join(kept).decode()
        assert out[row[0]]["text"] == want and out[row[0]]["start"] == "x"
        assert out[row[0]]["n_chars"] == (None if want is None else len(want))


@pytest.mark.parametrize("seed", [0, 1])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"line {i} {'x' * (i % 7)}" for i in range(40)]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.4 else f"own {k} {i}" for i in range(rng.randint(0, 30))) for k in range(40)]
    block = "\n".join(f"shared {i}" for i in range(12))
    texts += [f"a\n{block}\nb", f"c\nd\ne\n{block}", block, block, None, "", "\n\n\n\n", "one"]
    rows = shuffled_ids(texts)
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = 0
    for (doc, _), (n, kept) in zip(rows, helpers.without_repeated_chunks(rows), strict=True):
        assert got[doc]["n_lines"] == n and got[doc]["text"].encode() == b"\n".join(kept)
        removed += n - len(kept)
    assert removed >= 12


def test_lines_resist_shifts():
    rng = random.Random(1)
    body = [f"line {rng.random()}".encode() for _ in range(200)]
    cuts = lambda ls, off: {s + n - off for s, n in line_dedup.chunks(ls)}
    a, b = cuts(body, 0), cuts([b"new", b"two", b"three", *body], 3)
    assert len(a & b) > 0.9 * len(a)


def test_lines_repeated_rows_and_empty(spark):
    block = "\n".join(f"shared {i}" for i in range(10))
    docs = spark.createDataFrame([(1, block), (1, block), (2, block), (None, block)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 9, r["n_removed"]) for r in line_dedup.remove_repeated_lines(docs).collect())
    tail = got[2][1]
    assert got[:2] == [(1, 0), (1, 0)] and tail >= 8 and got[3] == (9, tail)
    assert line_dedup.remove_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_golay_code_is_perfect():
    table = simhash.golay_table()
    assert np.bincount(table).tolist() == [2048] * 4096
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    own, rows, near = simhash.fuzzy(words, 23)
    assert np.bincount(rows).max() <= 6
    sets = [set(near[rows == k]) for k in range(200)]
    for k in range(200):
        for bit in range(23):
            assert int(table[words[k] ^ np.uint32(1 << bit)]) in sets[k]


def test_any_two_within_three_bits_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 400).astype(np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for v in (x, y):
        rows, found = simhash.bucket_keys(v)
        keys.append([set(found[rows == k]) for k in range(len(v))])
    assert all(a & b for a, b in zip(*keys, strict=True))


def test_spanning_links_connect_what_pairs_do():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 9, 120).astype(np.uint64)
    fps = np.unique(fps)
    left, right = simhash.spanning_links(fps, 1)
    at = {int(f): k for k, f in enumerate(fps)}
    all_links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 1]
    assert helpers.components(len(fps), all_links) == helpers.components(len(fps), [(at[int(a)], at[int(b)]) for a, b in zip(left, right, strict=True)])


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    texts = helpers.sample_texts(4, n=40)
    base = texts[1].split()
    for _ in range(30):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w).upper())
    texts += ["\x1c odd \x1f", "É é", "a b", "A\tB"]
    rows = shuffled_ids(texts)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, root int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == sorted(helpers.near_duplicates(rows))


def test_keep_one(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (9, "other words are here"), (None, "a b c d"), (1, None), (2, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], helpers.DOCS)
    out = simhash.keep_one(docs)
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 9] and out.columns == docs.columns
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, k) for k in range(1001, 1400)]
    random.Random(0).shuffle(path)
    found = connected_components(Workspace(spark, "test"), spark.createDataFrame([*path, *hub, (5, 5), (2000, None)], "a long, b long"))
    got = {r["node"]: r["root"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{k: 1000 for k in range(1001, 1400)}}


def test_kept_digest_of_the_query(spark):
    got = substring_index.remove_repeats(spark.createDataFrame([(1, " a  b\n c ")], "doc_id long, text string")).select(F.sha2(F.col("text").cast("binary"), 256)).first()[0]
    assert got == hashlib.sha256(b"a b c").hexdigest()


@pytest.mark.parametrize("block", [1024, 7])
def test_near_copies_against_plain_jaccard(spark, monkeypatch, block):
    """Pairs of similarity 0.8 or more are linked, no others are; several words changed put most of them more than 3 bits apart."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    common = [word() for _ in range(150)]
    for k in range(60):  # one large group just below the similarity
        w = list(common)
        for _ in range(4):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for _ in range(25):
        base = [word() for _ in range(150)]
        for changes in (0, 1, 3, 3, 6, 12):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rows = shuffled_ids(texts)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    fps = [helpers.simhash(t) for _, t in rows]
    assert sum(bin(fps[i] ^ fps[j]).count("1") > 3 for i, j in close) > 0.5 * len(close)
    least: dict = {}
    for (doc, _), r in zip(rows, helpers.components(len(rows), close), strict=True):
        least[r] = min(doc, least.get(r, doc))
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], helpers.DOCS)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(least.values())


@pytest.mark.parametrize("size", [2, 3, 4, 6, 8, 12, 20])
def test_lines_of_short_blocks_go_whole(spark, size):
    """A block of two lines or more that an earlier document has goes whole, whatever lines stand around it; lines of no repeated run stay."""
    rng = random.Random(size)
    own = lambda: [f"own {rng.random()}" for _ in range(rng.randint(1, 9))]
    rows, want = [], {}
    for k in range(0, 40, 2):
        block = [f"block {rng.random()}" for _ in range(size)]
        for doc in (k, k + 1):
            before, after = own(), own()
            rows.append((doc, "\n".join([*before, *block, *after])))
            want[doc] = "\n".join([*before, *(block if doc == k else []), *after])
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_overlaps_against_plain_sets(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 8)
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(n)] for n in (9, 5))
    assert near_copies.overlaps(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert near_copies.overlaps(a, [np.zeros(0, np.uint64)]).tolist() == [[0]] * 9


def test_keep_one_of_repeated_ids_with_different_texts(spark):
    """Rows that share an id are copies of one another only if their texts are."""
    rows = [(1, "one two three four five six"), (2, "other words stand in this text"), (2, "one two three four five six"), (2, "a third text has nothing in common")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], helpers.DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == sorted([rows[0], rows[1], rows[3]])


def test_stages_keep_clashing_columns_and_types(spark):
    """Columns with the names that the stages use inside, and n_chars of another type, come out as they went in."""
    names = ["_h", "k_doc", "k_h", "_doc", "_row", "h", "spans", "place", "n", "s_doc"]
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(k, t, len(t), *[100 + k] * len(names)) for k, t in enumerate([passage, passage, f"start {passage} end", "another text of its own"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` long" for n in names))
    for stage, left in ((simhash.keep_one, {0, 3}), (line_dedup.stage, {0, 1, 2, 3}), (substring_index.stage, {0, 1, 2, 3})):
        out = stage(docs)
        assert out.dtypes == docs.dtypes
        got = {r["doc_id"]: r for r in out.collect()}
        assert set(got) >= left and all(r[n] == 100 + k for k, r in got.items() for n in names)


def test_runs_leave_no_names(spark, monkeypatch):
    """A call that fails leaves no tables in the catalog either."""
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(50))) for k in range(3)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(substring_index.FingerprintIndex, "contexts", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        substring_index.remove_repeats(docs)
    assert {t.name for t in spark.catalog.listTables()} == before

import zlib

import numpy as np
import pytest

from boxlens.llm import language_id, queries, toxicity
from tests.llm import helpers

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    rows = queries.op1_language_id(spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(langs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def labelled(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the and of that with this", "en"), ("der und die nicht ist das", "de")] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "123 !?", "x", 1), (None, "the and that of", "x", 1), (5, "und die nicht das " * 20000, "x", 1), (5, "и", "x", 1)], "doc_id long, text string, lang string, score int")
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0) for r in language_id.predicted(docs, labelled(spark)).collect()))
    assert got[0] == (0, "en", True) and got[1:4] == [(1, "und", False), (2, "und", False), (3, "und", False)]
    assert (5, "de", True) in got and len(got) == 6
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.predicted(docs, none).collect()} == {"und"}
    assert language_id.predicted(none, labelled(spark)).collect() == []


def test_language_stage(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "kept") for i, t in enumerate(["the and of that", None, "...", "der und die das"])], helpers.DOCS + ", lang_pred string")
    out = language_id.stage(docs, labelled(spark))
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 3]


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 300, bytes(range(256)) * 3, b"xyz"]
    windows, of, n = language_id.cut_windows(texts)
    for k, t in enumerate(texts):
        assert b"".join(bytes(w[:m].astype(np.uint8)) for w, o, m in zip(windows, of, n, strict=True) if o == k) == t


def random_net(seed=0, languages=3):
    net = language_id.ByteCnn.new([f"l{k}" for k in range(languages)], np.random.default_rng(seed))
    net.bias = np.random.default_rng(seed).normal(0, 0.1, len(net.bias)).astype(np.float32)
    return net


def plain_probabilities(net, text, start):
    """One window by plain loops: each width's filters over the bytes from start on, the most of each, softmax."""
    hidden = []
    for f in range(net.filters.shape[1]):
        width, best = language_id.WIDTHS[f // language_id.FILTERS], -np.inf
        for at in range(start, start + language_id.LENGTH):
            total = 0.0
            for k in range(width):
                byte = text[at + k] if at + k < len(text) else language_id.PAD
                total += sum(float(net.embedding[byte, e]) * float(net.filters[k * language_id.EMBED + e, f]) for e in range(language_id.EMBED))
            best = max(best, total)
        hidden.append(max(0.0, best + float(net.bias[f])))
    z = np.array(hidden) @ net.dense.astype(float) + net.dense_bias
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_language_forward_pass_against_plain_loops():
    net, text = random_net(), bytes(np.random.default_rng(1).integers(32, 250, 2 * language_id.LENGTH + 60).astype(np.uint8))
    starts = range(0, len(text), language_id.LENGTH)
    want = sum(plain_probabilities(net, text, s) * min(language_id.LENGTH, len(text) - s) for s in starts) / len(text)
    names, scores = language_id.predict(net, [text])
    assert names == [net.languages[int(want.argmax())]] and np.isclose(scores[0], want.max(), atol=1e-4)


def test_language_gradients_against_differences():
    net = random_net(2)
    for k in ("embedding", "filters", "bias", "dense", "dense_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(3)
    x = rng.integers(97, 123, (6, language_id.LENGTH + language_id.WIDEST - 1)).astype(np.int16)
    x[0, 9:] = language_id.PAD
    y, weight = rng.integers(0, 3, 6), rng.random(6)

    def loss():
        hidden = np.maximum(net.pooled(x)[1].max(axis=1) + net.bias, 0)
        return -(weight * np.log(language_id.softmax(hidden @ net.dense + net.dense_bias)[np.arange(6), y])).sum()

    grads = net.gradients(x, y, weight)
    for name, g in grads.items():
        for flat in rng.choice(g.size, min(12, g.size), replace=False):
            at = np.unravel_index(flat, g.shape)
            if (name == "filters" and net.mask()[at] == 0) or (name == "embedding" and at[0] == language_id.PAD):
                assert g[at] == 0
                continue
            held, sides = getattr(net, name)[at], []
            for step in (1e-6, -1e-6):
                getattr(net, name)[at] = held + step
                sides.append(loss())
            getattr(net, name)[at] = held
            assert np.isclose(g[at], (sides[0] - sides[1]) / 2e-6, rtol=1e-3, atol=1e-6), name


def test_language_blocks_give_what_the_whole_text_gives(monkeypatch):
    net, text = random_net(4), bytes(np.random.default_rng(5).integers(65, 250, 5000).astype(np.uint8))
    whole = language_id.predict(net, [text, text[:700]])
    monkeypatch.setattr(language_id, "BLOCK", 3)
    parts = language_id.predict(net, [text, text[:700]])
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], atol=1e-7)


def test_language_training_rows(spark):
    """One row repeated ten thousand times is read once; a language of empty texts only is not learned; a low score is no reason to go."""
    rows = [(7, "und die nicht das", "de")] * 10_000 + [(1, "the and of that", "en"), (2, "", "fr"), (3, None, "it")]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert net.languages == ["de", "en"]
    many = spark.createDataFrame([(i, chr(97 + i) * 9, f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "zz yy"), (2, "1 2"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in language_id.stage(docs, many).collect()] == [1]
    named = docs.selectExpr("*", "'old' lang_pred", "2 score")
    assert sorted(r["lang_pred"] for r in language_id.identify(named, net).collect()) != ["old"] * 3


def fake(seed, n, share):
    rng = np.random.default_rng(seed)
    words = ["river", "stone", "garden", "window", "paper", "mountain", "walking", "sometimes", "yellow", "under", "lazy", "mornings"]
    out = []
    for k in range(n):
        w = list(rng.choice(words, 60))
        if k < share:
            for _ in range(3):
                w[rng.integers(60)] = str(rng.choice(["grobnit", "plumfex", "zarkwad"]))
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def net():
    texts = fake(0, 400, 100)
    return toxicity.train_on_texts(texts[:100], texts[100:])


def test_toxicity_tolerates_gaps_and_insertions(net):
    clean = " ".join(fake(1, 1, 0)[0].split())
    score = lambda insult: net.scores(np.array([net.evidence(f"{clean} {insult} {clean} {insult}")]))[0]
    assert net.scores(np.array([net.evidence(clean)]))[0] < 0.3
    for insult in ("grobnit", "GROBNIT!", "g r o b n i t", "g-r-o-b-n-i-t", "grob.nit", "groxbnit", "plumfex", "pl umfex plumfexx", "zarkw@d", "zzarkwad"):
        assert score(insult) >= 0.7, insult


def test_toxicity_batches_long_texts_and_nulls(spark, net):
    texts = fake(2, 30, 10) + ["", None, " ", "é ñ", fake(3, 1, 0)[0] * 60, fake(3, 1, 0)[0] * 60 + " grobnit plumfex zarkwad"]
    alone = [float(net.scores(net.evidence(t or "")[None])[0]) for t in texts]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "x", 0.5)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, net).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], alone, atol=1e-6) and None in got
    assert toxicity.scored(spark.createDataFrame([], "doc_id long, text string"), net).collect() == []


def test_toxicity_parts_give_what_the_whole_text_gives(monkeypatch):
    """Runs of one-letter words, words and white space of any kind lie across the cuts."""
    rng = np.random.default_rng(0)
    machine = toxicity.StringKernelSvm(rng.normal(size=1 << 20).astype(np.float32), -0.5, np.zeros(5), 0.0)
    texts = ["a b c d " * 500, "word\n" * 700, "x" * 5000, "a\tb\n" * 900 + "long word", "one two  " * 300, "\u4e2d " * 900, " " * 3000 + "abcdef", "g r o b n i t word " * 200]
    texts += ["".join(rng.choice(list("abcdefg  \n-!"), 4000)) for _ in range(5)]
    whole = [(toxicity.encode(t), machine.evidence(t), toxicity.text_words(t)) for t in texts]
    for size in (7, 64, 1001):
        monkeypatch.setattr(toxicity, "SLICE_CHARS", size)
        for t, ((codes, sizes), evidence, words) in zip(texts, whole, strict=True):
            parts = list(toxicity.encoded_parts(t))
            assert np.array_equal(np.concatenate([p[0] for p in parts]), codes) and np.array_equal(np.concatenate([p[1] for p in parts]), sizes)
            assert np.allclose(machine.evidence(t), evidence, atol=1e-5) and toxicity.text_words(t) == words


def test_word_norms_are_of_the_kernel():
    """The norm of a word without repeats is the root of the sum of its squared subsequence values, whatever its length."""
    for n in (4, 7, 11, 26):
        _, _, values = toxicity.features([bytes([toxicity.START, *range(1, n)])])
        assert np.isclose((values**2).sum(), 1)


def test_toxicity_training_rows(spark):
    """An id that stands for ten thousand rows, equal or not, does not send them all to the driver."""
    docs = spark.createDataFrame([(1, "same text grobnit")] * 10_000 + [(2, f"text {i}") for i in range(2000)] + [(3, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    sent = []
    held = toxicity.train
    try:
        toxicity.train = lambda a, b, evidence: sent.append((len(a), len(b))) or held(a, b, evidence)
        net = toxicity.fit(docs, labels)
    finally:
        toxicity.train = held
    assert sent[0][0] == 1 and 1 <= sent[0][1] < 40
    assert toxicity.scored(docs, net).count() == 12_001


def test_kernel_is_what_the_weights_give(net):
    """A trained value equals the sum over landmarks only through subsequences: the weight table and a plain loop agree."""
    from itertools import combinations

    codes, size = toxicity.encode("gxrobnit")
    total, n = 0.0, len(codes)
    for idx in combinations(range(n), toxicity.ORDER):
        if idx[-1] - idx[0] < toxicity.SPAN:
            a, b, c, d = (int(codes[i]) for i in idx)
            total += float(net.weights[a << 15 | b << 10 | c << 5 | d]) * toxicity.DECAY ** (idx[-1] - idx[0] + 1 - toxicity.ORDER)
    assert np.isclose(net.values(codes, size)[0], total / toxicity.word_norms(size)[0] + net.bias, atol=1e-5)


def test_untrainable_sets_give_a_share(spark):
    flat = toxicity.train_on_texts(["a b"], ["c d", "e f"])
    assert np.isclose(flat.scores(np.array([flat.evidence("any")]))[0], 2 / 5)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert 0 <= toxicity.scored(docs, toxicity.fit(docs, empty)).collect()[0]["score"] <= 1


def test_toxicity_query(spark):
    rows = queries.op4_toxicity(spark, SF).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["score"] for r in held if labels[r["doc_id"]] == 1]
    clean = [r["score"] for r in held if labels[r["doc_id"]] == 0]
    assert np.mean([[t > c for c in clean] for t in toxic]) > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


@pytest.mark.parametrize("text", ["a b c d " * 1_300_000, "abcd" * 2_500_000, "a" + " " * 10_000_000])
def test_toxicity_of_long_runs_takes_linear_time(text):
    """Ten megabytes of one-letter words, of one word, of white space."""
    import time

    began = time.process_time()
    words = sum(len(size) for _, size in toxicity.encoded_parts(text))
    assert time.process_time() - began < 3 and words > 0


def test_toxicity_parts_of_random_runs(monkeypatch):
    rng = np.random.default_rng(1)
    pieces = ["a", "b", " ", "a ", "b ", "c d e f ", "abcdefgh", "  ", "!", " x y z ", "q" * 30]
    for _ in range(300):
        text = "".join(rng.choice(pieces, rng.integers(0, 40)))
        monkeypatch.setattr(toxicity, "SLICE_CHARS", 1 << 17)
        codes, size = toxicity.encode(text)
        for cut in (1, 2, 7, 20):
            monkeypatch.setattr(toxicity, "SLICE_CHARS", cut)
            parts = list(toxicity.encoded_parts(text))
            assert np.array_equal(np.concatenate([codes[:0], *(p[0] for p in parts)]), codes) and np.array_equal(np.concatenate([size[:0], *(p[1] for p in parts)]), size)

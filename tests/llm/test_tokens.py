import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxlens.llm import byte_bpe, packing, token_cache
from boxlens.llm.queries import BYTE_TOKENIZER, MULTI_RANKS, WORD_TOKENIZER
from tests.llm import helpers

RANKS, PATTERN = public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN
ODD = ["", " ", "\n\n a", "<|endoftext|>", "x<|startoftext|>y", "naïve  café\t\t", "日本語 text", "🙂🙂 ok", "a" * 3000, "it's I'll 've 12345 --- ...", "\x85  x", None]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.tokenizer_json(RANKS, PATTERN))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_as_tiktoken_and_round_trip(bpe, reference, text):
    ids = bpe.ids([text])[0]
    assert ids == reference.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_offsets_and_split_characters(bpe):
    text = "ab 🙂é"
    (ids, spans) = bpe.encode([text])[0]
    assert len(ids) == len(spans) and {k for a, b in spans for k in range(a, b)} == set(range(len(text)))
    cut = bpe.decode_text(ids[:-1])
    assert text.encode().startswith(bpe.decode(ids[:-1])) and (cut == text[: len(cut)] or "�" in cut)


def test_encode_decode_tables(spark):
    docs = helpers.docs_frame(spark, ODD)
    encoded = byte_bpe.encode(docs, RANKS, PATTERN)
    back = {r["doc_id"]: r for r in byte_bpe.decode(encoded, RANKS, PATTERN).collect()}
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(ODD))
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, RANKS, PATTERN).collect()}
    assert all(r["same"] for r in got.values()) and got[0]["n_tokens"] == 0 and len(got) == len(ODD)
    assert byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).collect() == []


def test_counts_as_the_library_and_the_cache_is_used(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(WORD_TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = [*ODD, *helpers.sample_texts(1, n=20), "same  text", "same text ", "SAME TEXT"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "no id", 5), (None, "no id either", 5), (3, "id again", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    cache = token_cache.TokenCache(spark, str(tmp_path / "cache"), path, collapse_space=True)
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    for _ in range(2):
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in cache.count(docs).collect()) == want
    raw = spark.read.parquet(str(tmp_path / "cache"))
    assert raw.count() == raw.select("content_digest").distinct().count()  # the second call encoded nothing
    other = token_cache.TokenCache(spark, str(tmp_path / "cache"), public_tokenizers.path(BYTE_TOKENIZER), collapse_space=False)
    assert other.stored().count() == 0 and other.count(docs.where("doc_id = 0")).collect()[0]["n_tokens"] == 0
    assert cache.count(docs.where("doc_id = -9")).collect() == []


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER))


PARTS = st.lists(st.one_of(st.sampled_from([" ", "\n", "\t ", "\x0b", "\x1c", "\x85", "\u00a0", "\u3000", "\u0301", "'s", "'", "<|endoftext|>", "<|startoftext|>", "<|", "\u03a3", "\u0130", "a", "1"]), st.text(alphabet=st.characters(codec="utf-8"), max_size=6)), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_counts_by_word_are_the_librarys(word_library, text):
    want = len(word_library.encode(text, add_special_tokens=False).ids)
    assert token_cache.WordCounts(word_library).count([text.encode()]) == [want]
    assert len(word_library.encode(re.sub("[ \t\n\r]+", " ", text).strip(" "), add_special_tokens=False).ids) == want


def test_packing_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(BYTE_TOKENIZER), encoding="utf-8") as f:
        spec = f.read()
    library = Tokenizer.from_str(spec)
    odd = [t or "" for t in ODD] + [f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(1, 0x3100)]
    for t in odd:
        assert packing.token_ids(spec, t) == library.encode(t, add_special_tokens=False).ids


def check_packing(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(BYTE_TOKENIZER))
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, t in texts.items():
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        for k, r in enumerate(own):
            assert r["piece"] == k and r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > capacity)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_whole(spark):
    rng = random.Random(0)
    texts = {i: " ".join(rng.choice(["stone", "river", "q", "elephants", "of"]) for _ in range(rng.randint(0, 3000))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "x " * 9000}
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, shard int, length int")
    path = public_tokenizers.path(BYTE_TOKENIZER)
    rows = packing.pack(docs, path, shard_pieces=50).collect()
    n = check_packing(rows, texts)
    lengths = [r["length"] for r in rows]
    assert n <= packing.lower_bound(lengths, 2048) * 1.06 + 4
    again = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), path).collect()
    assert len(again) == 3 and len({(r["sequence_id"], r["offset"]) for r in again}) == 3
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.integers(0, 5))
def test_evolution_keeps_every_piece(lengths, seed):
    first = packing.best_fit(sorted(lengths, reverse=True), [], 100)
    elite = packing.evolve(lengths, None, seed, 100)
    second = packing.evolve(lengths, elite, seed + 1, 100)
    for bins in (first, elite, second):
        assert sorted(n for b in bins for n in b) == sorted(lengths) and max(map(sum, bins)) <= 100
    assert packing.lower_bound(lengths, 100) <= len(second) <= len(elite) <= len(first)


def test_evolution_gains_on_best_fit():
    gained = 0
    for seed in range(4):
        rng = random.Random(seed)
        lengths = [rng.randint(300, 1100) for _ in range(600)]
        gained += len(packing.best_fit(sorted(lengths, reverse=True), [], 2048)) - len(packing.evolve(lengths, None, seed))
    assert gained > 0


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(2049, 2048) == [(0, 1), (1, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def changed(name, change):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        d = json.load(f)
    change(d)
    return json.dumps(d)


def test_shortcuts_only_where_the_tokenizer_file_allows_them():
    """Another normaliser, pre-tokenizer or order of merges, and the library encodes whole texts."""
    from tokenizers import Tokenizer

    assert packing.plain_byte_bpe(json.loads(changed(BYTE_TOKENIZER, lambda d: None)))
    text = " Some  Text's with 12 numbers<|endoftext|> and é"
    for change in (lambda d: d["pre_tokenizer"].update(add_prefix_space=True), lambda d: d.update(normalizer={"type": "Lowercase"}), lambda d: d["model"].update(merges=d["model"]["merges"][::-1])):
        spec = changed(BYTE_TOKENIZER, change)
        assert not packing.plain_byte_bpe(json.loads(spec))
        assert packing.token_ids(spec, text) == Tokenizer.from_str(spec).encode(text, add_special_tokens=False).ids
    assert token_cache.bounded_by_space(changed(WORD_TOKENIZER, lambda d: None))
    assert not token_cache.bounded_by_space(changed(BYTE_TOKENIZER, lambda d: None))
    assert not token_cache.bounded_by_space(changed(WORD_TOKENIZER, lambda d: d["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="[^x]+")))
    assert not token_cache.bounded_by_space(changed(WORD_TOKENIZER, lambda d: d["added_tokens"][0].update(content="a b")))


def test_the_query_meets_its_own_cache(spark, monkeypatch):
    """Two batches: each digest is stored once, those of the second that the first stored too are not encoded again, and counts are the library's."""
    from boxlens.llm import queries, token_cache

    made, held = [], token_cache.fresh_cache
    monkeypatch.setattr(token_cache, "fresh_cache", lambda *a: made.append(held(*a)) or made[-1])
    docs = spark.createDataFrame([(k, ["one two three", "four five", None, "", "six" * 40][k % 5]) for k in range(200)] + [(None, "one two three")], "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    rows = queries.op3_token_counts(spark, "").collect()
    library = token_cache._loaded(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == 201 and all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False)) for r in rows)
    assert made[0].stored().count() == 4 and spark.read.parquet(made[0].path).count() == 4

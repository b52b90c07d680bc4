import public_tokenizers

import corpus_pipeline
from boxlens.llm import language_id
from tests.llm import helpers
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables[:5]]
    assert all(t.columns == docs.columns for t in tables[:5]) and all(r["n_chars"] == len(r["text"]) for t in rows[1:] for r in t.values())

    net = language_id.fit(docs)
    names, _ = language_id.predict(net, [(r["text"] or "").encode() for r in rows[0].values()])
    assert set(rows[1]) == {i for i, n in zip(rows[0], names, strict=True) if n != "und"}

    pairs = sorted((i, r["text"]) for i, r in rows[1].items())
    for (i, text), (n, kept) in zip(pairs, helpers.without_repeated_chunks(pairs), strict=True):
        assert rows[2][i]["text"] == (b"\n".join(kept).decode() if len(kept) < n else text)

    pairs = sorted((i, r["text"]) for i, r in rows[2].items())
    assert {i: r["text"] for i, r in rows[3].items()} == {i: text for (i, text), c in zip(pairs, helpers.near_copies(pairs), strict=True) if c == i}

    pairs = sorted((i, r["text"]) for i, r in rows[3].items())
    for (i, text), (n, kept) in zip(pairs, helpers.without_repeats([t for _, t in pairs]), strict=True):
        assert rows[4][i]["text"] == (b" ".join(kept).decode() if len(kept) < n else text)

    check_packing(tables[5].collect(), {i: r["text"] for i, r in rows[4].items()})


def test_run_and_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert public_tokenizers.path("byte_bpe_50k.json")

"""Byte-level BPE through the tokenizers library: encoding with offsets, decoding, both over Arrow batches.

The ranks of a .tiktoken file become a tokenizers model. Its alphabet writes each byte as one
printable character; decoding goes back over that table, so an id may hold part of a character.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxlens.llm.common import arrow_map, as_texts, slices

SLICE_BYTES = 1 << 18


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {}, 256
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(4)
def tokenizer_json(ranks_path: str, pattern: str) -> str:
    """A tokenizers model with those ranks as ids. Every way to split a token into two tokens is a merge of that token's rank."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, alphabet = read_ranks(ranks_path), byte_alphabet()
    shown = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        ways = [(ranks[a], ranks[b], a, b) for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        merges += [(shown[a], shown[b]) for _, _, a, b in sorted(ways)]
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


class ByteBpe:
    """Encodes texts and decodes ids. encode_special is not offered: such strings in a text are ordinary text."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and, for each, the span of characters it has a byte of: a split character is in the spans of all its ids."""
        return [(e.ids, e.offsets) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def decode_text(self, ids: list[int]) -> str:
        """Bytes that make no whole character, as at a cut through one, become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")


@lru_cache(2)
def _loaded(spec: str) -> ByteBpe:
    return ByteBpe(spec)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends) of each text. Null: no ids. Equal rows stay rows of their own; other columns do not matter. No rows: no rows."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(ranks_path, pattern))  # bounded by the vocabulary

    def run(batches):
        bpe = _loaded(spec.value)
        for b in batches:
            texts = as_texts(b.column(1))
            for s in slices([len(t) for t in texts], SLICE_BYTES):
                done = bpe.encode(texts[s])
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([[x for x, _ in d[1]] for d in done], pa.list_(pa.int32())), pa.array([[y for _, y in d[1]] for d in done], pa.list_(pa.int32()))], ["doc_id", "ids", "starts", "ends"])

    rows = docs.selectExpr(f"cast({id_col} as bigint) doc_id", f"cast({text_col} as string) text")
    return arrow_map(rows, run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes, text) of each row of (doc_id, ids). Null ids: empty. No rows: no rows."""
    spec = encoded.sparkSession.sparkContext.broadcast(tokenizer_json(ranks_path, pattern))

    def run(batches):
        bpe = _loaded(spec.value)
        for b in batches:
            raw = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "bytes", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each whole text in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256, same). Null text: empty, no tokens. No rows: no rows."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(ranks_path, pattern))

    def run(batches):
        bpe = _loaded(spec.value)
        for b in batches:
            texts = as_texts(b.column(1))
            counts, of_ids, of_bytes, same = [], [], [], []
            for s in slices([len(t) for t in texts], SLICE_BYTES):
                for text, ids in zip(texts[s], bpe.ids(texts[s]), strict=True):
                    back = bpe.decode(ids)
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                    of_bytes.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")

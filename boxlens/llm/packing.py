"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

A chromosome is a list of bins, a bin a tuple of piece lengths. Crossover injects whole well-filled bins of
one parent into the other, removes the bins that would then hold a piece twice, and places the displaced
pieces again by best fit. Pieces are dealt to shards of bounded size; several islands evolve each shard apart
and pass their elite on between epochs. A shard whose packing meets its lower bound is optimal and rests.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map, as_texts

CAPACITY = 2048
#: Pieces a shard, on average. A shard wastes a bin at most against packing it together with the others.
SHARD_PIECES = 8192
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 4
ROWS_PER_TASK = 8

Bin = tuple[int, ...]


# --- pieces ---------------------------------------------------------------------------------------------


def plain_byte_bpe(d: dict) -> bool:
    """Whether a tokenizers file is byte-level BPE and nothing else, its merges in the order of their ids: what ranks can stand for."""
    model, before = d["model"], d["pre_tokenizer"] or {}
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    special = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in d["added_tokens"])
    if model.get("type") != "BPE" or any(odd) or d["normalizer"] or not special:
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(x < y for x, y in zip(merged, merged[1:], strict=False))


@lru_cache(2)
def _encoder(spec: str) -> tuple:
    """Of a plain byte-level BPE, its ranks in tiktoken: the same ids in a fifth of the time (tests hold the two against each other), and its special strings. Of any other file, the library's tokenizer."""
    import public_tokenizers

    d = json.loads(spec)
    if not plain_byte_bpe(d):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        made.no_truncation()
        made.no_padding()
        return made, None
    import tiktoken

    from boxlens.llm.byte_bpe import byte_alphabet

    back = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"]: t["id"] for t in d["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in d["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def token_ids(spec: str, text: str) -> list[int]:
    """Special strings in a text are their ids, as in the library's default."""
    encoding, special = _encoder(spec)
    if special is None:
        return encoding.encode(text, add_special_tokens=False).ids
    if not any(s in text for s in special):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text):
        ids += [special[part]] if part in special else encoding.encode_ordinary(part)
    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that takes the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32). A null text is empty: one piece that holds the end id only."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), as_texts(b.column(1)), strict=True):
                ids = np.array(array("I", [*token_ids(spec.value, text), end_id]), "<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- one shard ------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """Places each length, in the order given, into the fullest bin that has room. One set bit for each room that some bin has finds that bin."""
    made = [list(b) for b in bins]
    room: dict[int, list[int]] = {}
    mask = 0
    for i, b in enumerate(made):
        r = capacity - sum(b)
        room.setdefault(r, []).append(i)
        mask |= 1 << r
    for n in lengths:
        if fits := mask >> n:
            r = n + (fits & -fits).bit_length() - 1
            i = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            made[i].append(n)
        else:
            r, i = capacity, len(made)
            made.append([n])
        room.setdefault(r - n, []).append(i)
        mask |= 1 << (r - n)
    return [tuple(b) for b in made]


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Martello and Toth's L2: for each k, pieces over capacity - k need bins of their own, pieces over half share none with each other, and what those leave takes the rest."""
    count = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)
    total = np.cumsum(count * np.arange(capacity + 1))
    number = np.cumsum(count)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for k in range(half + 1):
        alone = int(number[-1] - number[capacity - k])
        big, big_sum = int(number[capacity - k] - number[half]), int(total[capacity - k] - total[half])
        small = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + big + max(0, -(-(small - (big * capacity - big_sum)) // capacity)))
    return best


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly, which later moves can empty."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(a: list[Bin], b: list[Bin], available: Counter, capacity: int, rng: random.Random) -> list[Bin]:
    """Child of a with well-filled bins of b."""
    full = [x for x in b if sum(x) >= 0.98 * capacity] or sorted(b, key=sum)[-max(1, len(b) // 4) :]
    injected = [x for x in full if rng.random() < 0.5]
    left = Counter(available)
    for x in injected:
        left.subtract(x)
    kept: list[Bin] = []
    for x in sorted(a, key=sum, reverse=True):
        taken = 0
        if sum(x) >= 0.9 * capacity or rng.random() < 0.5:
            for n in x:  # a bin that would hold a piece twice goes
                if left[n] <= 0:
                    break
                left[n] -= 1
                taken += 1
        if taken == len(x):
            kept.append(x)
        else:
            for n in x[:taken]:
                left[n] += 1
    displaced = sorted(left.elements(), reverse=True)
    return best_fit(displaced, injected + kept, capacity)


def evolve(lengths: list[int], immigrant: list[Bin] | None, seed: int, capacity: int = CAPACITY) -> list[Bin]:
    """One island's epoch; gives its elite. Stops at the lower bound."""
    bound = lower_bound(lengths, capacity)
    if immigrant is not None and len(immigrant) <= bound:
        return immigrant
    elite = best_fit(sorted(lengths, reverse=True), [], capacity)
    if immigrant is not None:
        elite = max(elite, immigrant, key=lambda x: fitness(x, capacity))
    if len(elite) <= bound:
        return elite
    rng, available = random.Random(seed), Counter(lengths)
    rated = lambda x: (fitness(x, capacity), x)
    people = [rated(elite)] + ([rated(immigrant)] if immigrant is not None else [])
    while len(people) < POPULATION:
        order = sorted(lengths, key=lambda n: -n * rng.uniform(0.9, 1.1))
        people.append(rated(best_fit(order, [], capacity)))
    for _ in range(GENERATIONS):
        people.sort(reverse=True)
        best = people[0][1]
        if len(best) <= bound:
            break
        children = [crossover(best, rng.choice(people[1:])[1], available, capacity, rng), crossover(rng.choice(people[1:])[1], best, available, capacity, rng)]
        people = [*people[: POPULATION - 2], *map(rated, children)]
    return max(people)[1]


# --- all shards -----------------------------------------------------------------------------------------

_STATE = "shard long, island int, lengths array<int>, flat array<int>, sizes array<int>, n_bins int, fill double, optimal boolean"


def _bins(flat, sizes) -> list[Bin]:
    ends = np.cumsum(sizes)
    return [tuple(int(x) for x in flat[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def _epoch(epoch: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for r in d.itertuples(index=False):
                lengths = [int(x) for x in r.lengths]
                elite = evolve(lengths, None if r.flat is None else _bins(r.flat, r.sizes), (int(r.shard) * ISLANDS + int(r.island)) * EPOCHS + epoch, capacity)
                least, fill = fitness(elite, capacity)
                rows.append((r.shard, r.island, lengths, [n for b in elite for n in b], [len(b) for b in elite], -least, fill, -least <= lower_bound(lengths, capacity)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _STATE.split(", ")])

    return run


def _place(capacity: int):
    def run(key, items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        """Pieces of a length are alike: the next of them takes the next place for that length."""
        slots: dict[int, list[tuple[int, int]]] = {}
        for k, b in enumerate(_bins(best.flat.iloc[0], best.sizes.iloc[0])):
            at = 0
            for n in b:
                slots.setdefault(n, []).append((k, at))
                at += n
        placed = [slots[n].pop() for n in items.length]
        items = items.drop(columns="shard")
        items["sequence_id"] = np.array([k for k, _ in placed], np.int64) + (int(key[0]) << 32)
        items["offset"] = np.array([at for _, at in placed], np.int64)
        return items

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null texts are empty documents of one id. Rows with equal or null ids are documents of their own. No rows: no
    sequences. Extra columns are ignored. A piece of the whole capacity fills a sequence alone.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "packing")
    cut_up = work.write(pieces(docs, tokenizer_path, capacity), "pieces")
    n = cut_up.count()
    shards = max(1, round(n / shard_pieces))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    dealt = work.write(cut_up.select("*", deal), "dealt")
    # a shard is shard_pieces on average whatever the input: its lengths, 4 bytes each, fit one row
    state = dealt.groupBy("shard").agg(F.collect_list(F.col("length").cast("int")).alias("lengths")).select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.lit(None).cast("array<int>").alias("flat"), F.lit(None).cast("array<int>").alias("sizes"))
    for epoch in range(EPOCHS):
        spread = state.repartition(max(1, shards * ISLANDS // ROWS_PER_TASK), "shard", "island")
        state = work.write(spread.mapInPandas(_epoch(epoch, capacity), _STATE), f"epoch{epoch}")
        if epoch == EPOCHS - 1 or not state.where(~F.col("optimal")).head(1):
            break
        # the elite of each island goes to the next one of its shard, if that is not optimal
        resting = state.where("optimal") if epoch == 0 else resting.unionByName(state.where("optimal"))
        moving = state.where("not optimal")
        elite = moving.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "flat", "sizes")
        state = moving.select("shard", "island", "lengths").join(elite, ["shard", "island"], "left")
    best = (state if epoch == 0 else state.unionByName(resting)).groupBy("shard").agg(F.max_by(F.struct("flat", "sizes"), F.struct(-F.col("n_bins"), "fill")).alias("b")).select("shard", "b.flat", "b.sizes")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(_place(capacity), out)

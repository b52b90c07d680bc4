"""Snapshots of a feature cache as a data source of Spark: `feature_snapshot`, read and written with a path.

A snapshot is a folder of part files and manifests. A part is records one after another, little-endian and unpadded:

    key 4 x int32 | blocks int32 | values int32 | unique bool | score f64 | [labels int32 each | features f32 each]
    | norm f64 | zero bool | belief bool | mined bool | loss f64

the bracketed part only where there are blocks. Behind the records lies an index of GROUP records each: offset, records, least and
largest data id, checksum. Readers take an index group as a partition, or some that follow one another where there are over
PARTITIONS, skip groups that a filter on dataid rules out, and check each group's sum and each record's norm. A write's parts count only from the moment that a manifest names them, so a failed write
leaves a snapshot as it was.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from boxlens.tables import _setting, written

HEAD, TAIL, GROUP_ENTRY, FOOT = struct.Struct("<4iii?d"), struct.Struct("<d???d"), struct.Struct("<qiiiI"), struct.Struct("<qi8s")
MAGIC, GROUP = b"BLSNAP01", 4096
#: Partitions of a reader, about, however many groups there are; bytes whose places are held at once.
PARTITIONS, PLACED = 1000, 1 << 22
SIZES, HEAD_TYPE = struct.Struct("<ii"), np.dtype([("key", "<i4", 4), ("blocks", "<i4"), ("values", "<i4"), ("unique", "u1"), ("score", "<f8")])
TAIL_TYPE = np.dtype([("norm", "<f8"), ("zero", "u1"), ("belief", "u1"), ("mined", "u1"), ("loss", "<f8")])
SCHEMA = "dataid int, scale int, x int, y int, bls array<int>, feat array<float>, is_unique boolean, score double, norm double, is_zero boolean, is_belief boolean, is_mined boolean, loss double"
ARROW = pa.schema([("dataid", pa.int32()), ("scale", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("bls", pa.list_(pa.int32())), ("feat", pa.list_(pa.float32())), ("is_unique", pa.bool_()), ("score", pa.float64()), ("norm", pa.float64()), ("is_zero", pa.bool_()), ("is_belief", pa.bool_()), ("is_mined", pa.bool_()), ("loss", pa.float64())])


class DamagedSnapshot(ValueError):
    pass


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow reaches, by its address; a plain path is a local or mounted one."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _norm(feat: np.ndarray) -> float:
    wide = feat.astype(np.float64)
    return float(np.sqrt((wide * wide).sum()))


def pack(row: dict) -> bytes:
    """One record; norm and is_zero follow from the features."""
    bls, feat = np.array(row["bls"] or [], "<i4"), np.array(row["feat"] or [], "<f4")
    body = bls.tobytes() + feat.tobytes() if len(bls) else b""
    feat = feat if len(bls) else feat[:0]
    head = HEAD.pack(row["dataid"], row["scale"], row["x"], row["y"], len(bls), len(feat), bool(row["is_unique"]), row["score"])
    return head + body + TAIL.pack(_norm(feat), not len(bls), bool(row["is_belief"]), bool(row["is_mined"]), row["loss"])


def unpack(data: bytes, base: int = 0, name: str = "") -> Iterator[tuple]:
    """The records of a part's bytes, which lie at base in it."""
    at = 0
    while at < len(data):
        try:
            *key, blocks, values, unique, score = HEAD.unpack_from(data, at)
            body = at + HEAD.size
            if blocks < 0 or values < 0 or data[at + 24] > 1 or (blocks == 0 and values):
                raise DamagedSnapshot("sizes")
            end = body + 4 * (blocks + values)
            norm, zero, belief, mined, loss = TAIL.unpack_from(data, end)
            bls, feat = np.frombuffer(data, "<i4", blocks, body), np.frombuffer(data, "<f4", values, body + 4 * blocks)
            if max(data[end + 8 : end + 11]) > 1 or zero != (blocks == 0) or not np.isclose(norm, _norm(feat), rtol=1e-6, atol=1e-9):
                raise DamagedSnapshot("norm or flags")
        except (struct.error, ValueError) as e:
            raise DamagedSnapshot(f"{name}: damaged record at offset {base + at}") from e
        yield (*key, bls.tolist(), feat.tolist(), unique, score, norm, zero, belief, mined, loss)
        at = end + TAIL.size


def _spans(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Places of spans of bytes, one span after another, PLACED or a span at a time: where they are among all, and the places."""
    ends = np.cumsum(lengths)
    low = 0
    while low < len(starts):
        before = ends[low] - lengths[low]
        high = max(low + 1, int(np.searchsorted(ends, before + PLACED, side="right")))
        n = lengths[low:high]
        yield slice(int(before), int(ends[high - 1])), np.repeat(starts[low:high] - (ends[low:high] - n - before), n) + np.arange(ends[high - 1] - before)
        low = high


def _norms(feat: np.ndarray, values: np.ndarray) -> np.ndarray:
    wide = feat.astype(np.float64)
    return np.sqrt(np.bincount(np.repeat(np.arange(len(values)), values), weights=wide * wide, minlength=len(values)))


def pack_all(b: pa.RecordBatch) -> bytes:
    """pack() of a batch's rows, one after another."""

    def numbers(name: str, kind: str) -> np.ndarray:
        if b[name].null_count:
            raise ValueError(f"{name} is null")
        return b[name].to_numpy(zero_copy_only=False).astype(kind)

    flags = lambda name: pc.fill_null(b[name], False).to_numpy(zero_copy_only=False).astype(np.uint8)
    sizes = lambda name: pc.fill_null(pc.list_value_length(b[name]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    blocks, values = sizes("bls"), sizes("feat")
    bls, feat = b["bls"].flatten(), b["feat"].flatten().to_numpy(zero_copy_only=False).astype("<f4")
    if bls.null_count:
        raise ValueError("bls holds null")
    bls = bls.to_numpy(zero_copy_only=False).astype("<i4")
    feat, values = feat[np.repeat(blocks > 0, values)], np.where(blocks > 0, values, 0)
    head, tail = np.zeros(b.num_rows, HEAD_TYPE), np.zeros(b.num_rows, TAIL_TYPE)
    for k, name in enumerate(("dataid", "scale", "x", "y")):
        head["key"][:, k] = numbers(name, "<i4")
    head["blocks"], head["values"], head["unique"], head["score"] = blocks, values, flags("is_unique"), numbers("score", "<f8")
    tail["norm"], tail["zero"], tail["belief"], tail["mined"], tail["loss"] = _norms(feat, values), blocks == 0, flags("is_belief"), flags("is_mined"), numbers("loss", "<f8")
    ends = np.cumsum(HEAD.size + 4 * (blocks + values) + TAIL.size)
    body = ends - TAIL.size - 4 * (blocks + values)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for starts, lengths, data in ((body - HEAD.size, np.full(len(ends), HEAD.size), head), (body, 4 * blocks, bls), (body + 4 * blocks, 4 * values, feat), (ends - TAIL.size, np.full(len(ends), TAIL.size), tail)):
        raw = np.frombuffer(data.tobytes(), np.uint8)
        for among, places in _spans(starts, lengths):
            out[places] = raw[among]
    return out.tobytes()


def unpack_all(data: bytes, base: int = 0, name: str = "") -> pa.RecordBatch:
    """unpack() as a batch. Only where a record starts is found one by one; a damaged one is left to unpack(), which names it."""
    starts, at, least = [], 0, HEAD.size + TAIL.size
    while at + least <= len(data):
        blocks, values = SIZES.unpack_from(data, at + 16)
        if blocks < 0 or values < 0:
            break
        starts.append(at)
        at += least + 4 * (blocks + values)
    whole = at == len(data)
    if whole:
        raw, starts = np.frombuffer(data, np.uint8), np.array(starts, np.int64)

        def taken(starts: np.ndarray, lengths: np.ndarray, kind) -> np.ndarray:
            return np.frombuffer(b"".join(raw[places].tobytes() for _, places in _spans(starts, lengths)), kind)

        head = taken(starts, np.full(len(starts), HEAD.size), HEAD_TYPE)
        blocks, values = head["blocks"].astype(np.int64), head["values"].astype(np.int64)
        body = starts + HEAD.size
        tail = taken(body + 4 * (blocks + values), np.full(len(starts), TAIL.size), TAIL_TYPE)
        bls, feat = taken(body, 4 * blocks, "<i4"), taken(body + 4 * blocks, 4 * values, "<f4")
        flags = [head["unique"], *[tail[c] for c in ("zero", "belief", "mined")]]
        whole = not any((f > 1).any() for f in flags) and (tail["zero"] == (blocks == 0)).all() and not values[blocks == 0].any() and np.isclose(tail["norm"], _norms(feat, values), rtol=1e-6, atol=1e-9).all()
    if not whole:
        columns = list(zip(*unpack(data, base, name), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ARROW, strict=True)], schema=ARROW)
    lists = lambda n, v: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(v))
    each = [*[np.ascontiguousarray(head["key"][:, k]) for k in range(4)], lists(blocks, bls), lists(values, feat), head["unique"].astype(bool), head["score"], tail["norm"], *[tail[c].astype(bool) for c in ("zero", "belief", "mined")], tail["loss"]]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v), t.type) for v, t in zip(each, ARROW, strict=True)], schema=ARROW)


@dataclass
class Group(InputPartition):
    """Groups of a part that follow one another: (length, checksum) of each, the first at offset."""

    part: str
    offset: int
    groups: list[tuple[int, int]]


@dataclass
class Written(WriterCommitMessage):
    part: str | None


def _manifests(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith("manifest-"))


def _parts(store: fs.FileSystem, root: str) -> list[str]:
    names = _manifests(store, root)
    if not names:
        return []
    with store.open_input_stream(f"{root}/{names[-1]}") as f:
        return json.loads(f.read())


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path, -(1 << 31), (1 << 31) - 1

    def partitions(self) -> list[Group]:
        store, root = _at(self.path)
        found = [(part, a, n, c) for part in _parts(store, root) for a, n, low, high, c in _index(store, f"{root}/{part}") if high >= self.low and low <= self.high]
        together, out = -(-len(found) // PARTITIONS), []
        for part, a, n, c in found:
            last = out[-1] if out else None
            if last and last.part == part and len(last.groups) < together and last.offset + sum(g[0] for g in last.groups) == a:
                last.groups.append((n, c))
            else:
                out.append(Group(part, a, [(n, c)]))
        return out

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        store, root = _at(self.path)
        if partition is None:
            return
        at = partition.offset
        with store.open_input_file(f"{root}/{partition.part}") as f:
            for length, checksum in partition.groups:
                data = f.read_at(length, at)
                batch = unpack_all(data, at, partition.part)  # first, as it names the record
                if len(data) != length or zlib.crc32(data) != checksum:
                    raise DamagedSnapshot(f"{partition.part}: damaged group at offset {at}")
                yield batch
                at += length


class FilteringReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on dataid rule groups out. Spark tests all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("dataid",) and getattr(f, "value", None) is not None:
                value = f.value
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, value), min(self.high, value)
                elif isinstance(f, In):
                    self.low, self.high = max(self.low, min(value)), min(self.high, max(value))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            yield f


def _index(store: fs.FileSystem, part: str) -> list[tuple[int, int, int, int, int]]:
    """(offset, length, least and largest data id, checksum) of each group."""
    with store.open_input_file(part) as f:
        size = f.size()
        if size < FOOT.size:
            raise DamagedSnapshot(f"{part}: no index")
        begin, n, magic = FOOT.unpack(f.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or begin < 0 or begin + n * GROUP_ENTRY.size + FOOT.size != size:
            raise DamagedSnapshot(f"{part}: damaged index")
        entries = list(GROUP_ENTRY.iter_unpack(f.read_at(n * GROUP_ENTRY.size, begin)))
    ends = [e[0] for e in entries[1:]] + [begin]
    return [(a, end - a, low, high, c) for (a, _, low, high, c), end in zip(entries, ends, strict=True)]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A part of one task; without rows none. Records are in the order of the rows, GROUP at a time in memory."""
        store, root = _at(self.path)
        name, entries, out, at, held, n = f"part-{uuid.uuid4().hex}", [], None, 0, [], 0

        def flush() -> None:
            nonlocal out, at, held, n
            if held:
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                data, ids = b"".join(map(pack_all, held)), [pc.min_max(b["dataid"]).as_py() for b in held]
                out.write(data)
                entries.append((at, n, min(i["min"] for i in ids), max(i["max"] for i in ids), zlib.crc32(data)))
                at, held, n = at + len(data), [], 0

        try:
            for b in iterator:
                s = 0
                while s < b.num_rows:
                    rows = b.slice(s, GROUP - n)
                    held, n, s = [*held, rows], n + rows.num_rows, s + rows.num_rows
                    if n >= GROUP:
                        flush()
            flush()
            if out is not None:
                out.write(b"".join(GROUP_ENTRY.pack(*e) for e in entries) + FOOT.pack(at, len(entries), MAGIC))
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        """The next manifest names the parts, after those before where they stay. Two writers at once: one fails."""
        store, root = _at(self.path)
        store.create_dir(root, recursive=True)
        names = _manifests(store, root)
        old = _parts(store, root)
        fresh = [m.part for m in messages if m and m.part]
        target, made = f"{root}/manifest-{len(names):08d}", f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(made) as f:
            f.write(json.dumps(fresh if self.overwrite else [*old, *fresh]).encode())
        if store.get_file_info(target).type != fs.FileType.NotFound:
            store.delete_file(made)
            raise RuntimeError(f"{self.path} was changed by another writer")
        store.move(made, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _at(self.path)
        for m in messages:
            if m and m.part and store.get_file_info(f"{root}/{m.part}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{m.part}")


class FeatureSnapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        """Spark takes a reader with filters only in a session that allows it, which the option pushdown says."""
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else Reader
        return kind(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark) -> None:
    spark.dataSource.register(FeatureSnapshot)


def load(spark, path: str, condition: str) -> DataFrame:
    """The records that meet a condition, as a written table. Bounds on dataid reach the files; the session's setting is as before afterwards."""
    register(spark)
    with _setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        return written(spark.read.format("feature_snapshot").option("pushdown", "true").load(path).where(condition), "snapshot")

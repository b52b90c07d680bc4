"""Repeated word windows through a log-structured index of fingerprints.

Of the 6-word grams of a window the one with the least hash is its anchor, so equal windows have equal anchors at
equal places. Consecutive windows with the same anchor place are a run of up to 30 windows; its context is the words
they cover. The index holds one row for each distinct (anchor, 128-bit digest of the context's bytes): occurrences
and one place. Each batch of documents appends a run, bucketed and sorted by anchor, which never changes; a batch is
merge-joined with the runs before it bucket by bucket, without a shuffle of what they hold; compaction merges runs. A
manifest in the index's folder names the runs, so that a later application opens it and goes on.

A window is repeated if its context occurs twice, or if it is in two contexts; both then have its anchor. Only
contexts whose anchor has several are opened, once each, and their windows compared by digests of their bytes.
Two windows of one run are never equal: equal windows have their anchor at an equal offset.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map, as_bytes, slices
from boxlens.llm.spans import cut_out, joined, keyed, with_text
from boxlens.tables import _setting

WINDOW, GRAM = 35, 6
SPAN = WINDOW - GRAM + 1
SLICE_BYTES = 1 << 19
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
KEY = ["anchor", "c1", "c2"]


def words(text: bytes) -> list[bytes]:
    return text.split()


def _anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a sequence of word hashes the place of its anchor, leftmost of equals; and the grams' hashes."""
    n = len(hashes) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for j in range(GRAM):
        grams = grams * MULTIPLIER + hashes[j : j + n]
    grams = (grams ^ (grams >> np.uint64(31))) * MIX
    grams ^= grams >> np.uint64(29)
    least, place, width = grams, np.arange(n), 1
    while width < SPAN:  # least of twice as many, then of SPAN in all, two overlapping halves at the end
        step = min(width, SPAN - width)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    return place, grams


def runs(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each run. hashes: the words of documents of WINDOW words or more, one after another; begin: where each begins, and the end."""
    place, grams = _anchors(hashes)
    n = len(place)
    valid = np.ones(n, bool)
    for e in begin[1:-1]:  # windows over a document's end
        valid[max(0, e - WINDOW + 1) : e] = False
    first = np.ones(n, bool)
    first[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(first & valid)
    ends = np.append(np.flatnonzero(first | ~valid), n)
    return starts, ends[np.searchsorted(ends, starts, "right")] - starts, grams[place[starts]]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    for b in batches:
        texts = b.column(2).cast(pa.binary()).to_pylist()
        for s in slices([len(t) for t in texts], SLICE_BYTES):
            split = [t.split() for t in texts[s]]
            long_enough = [k for k, w in enumerate(split) if len(w) >= WINDOW]
            if not long_enough:
                continue
            flat = [w for k in long_enough for w in split[k]]
            begin = np.cumsum([0, *(len(split[k]) for k in long_enough)])
            starts, number, anchor = runs(np.fromiter(map(xxh3_64_intdigest, flat), np.uint64, len(flat)), begin)
            at = np.cumsum([0, *map(len, flat)]) + np.arange(len(flat) + 1)  # of each word in the joined line
            line = memoryview(b" ".join(flat))
            lo, hi = at[starts].tolist(), (at[starts + number + WINDOW - 1] - 1).tolist()
            digests = np.frombuffer(b"".join([xxh3_128_digest(line[x:y]) for x, y in zip(lo, hi, strict=True)]), "<i8").reshape(-1, 2)
            of = np.searchsorted(begin, starts, "right") - 1
            rows = pa.array(np.array(long_enough)[of] + s.start)
            cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array((starts - begin[of]).astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "start", "n", *KEY])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The runs of every document: (doc_id, h, start, n, anchor, c1, c2)."""
    return arrow_map(keyed(docs), _fingerprints, "doc_id long, h long, start int, n int, anchor long, c1 long, c2 long")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the contexts that spans name."""
    from xxhash import xxh3_128_digest

    for b in batches:
        docs, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
        texts, spans = as_bytes(b.column(2)), b.column(3).to_pylist()
        for s in slices([len(t) + 600 * len(x) for t, x in zip(texts, spans, strict=True)], SLICE_BYTES):
            out: list[tuple] = []
            digests: list[bytes] = []
            for doc, h, text, found in zip(docs[s], hs[s], texts[s], spans[s], strict=True):
                flat = text.split()
                at = (np.cumsum([0, *map(len, flat)]) + np.arange(len(flat) + 1)).tolist()
                line = memoryview(b" ".join(flat))
                for x in {(x["start"], x["n"]) for x in found}:
                    for w in range(x[0], x[0] + x[1]):
                        out.append((doc, h, w))
                        digests.append(xxh3_128_digest(line[at[w] : at[w + WINDOW] - 1]))
            keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], ["doc_id", "h", "start", "w1", "w2"])


class FingerprintIndex:
    """Runs of (anchor, c1, c2, occurrences, doc_id, h, start, n), the last four one of the places. More than MOST_RUNS are compacted.

    root is a folder that the cluster shares, and stays: opening it again finds what was appended. Each change writes the next
    manifest, and the last one counts; a run that no manifest names, as after a failure, is not there. work holds tables
    that end with the application. buckets is fixed when the folder is made.
    """

    MOST_RUNS = 8
    COLUMNS = "anchor long, c1 long, c2 long, occurrences long, doc_id long, h long, start int, n int"

    def __init__(self, spark: SparkSession, root: str, work: Workspace | None = None, buckets: int | None = None):
        self.spark, self.root, self.work, self.number = spark, root.rstrip("/"), work or Workspace(spark, "substrings"), count()
        found = self._manifests()
        state = json.loads(self._read(found[-1])) if found else {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": []}
        self.version, self.buckets, self.names = len(found), state["buckets"], state["runs"]

    # files of the folder, by the cluster's file system

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        folder = self._path("manifests")
        if not self._files().exists(folder):
            return []
        return sorted(f.getPath().getName() for f in self._files().listStatus(folder) if f.getPath().getName().endswith(".json"))

    def _read(self, name: str) -> str:
        stream = self._files().open(self._path(f"manifests/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, names: list[str]) -> None:
        """Never over an existing manifest: of two writers at once one fails."""
        made = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._files().create(made, False)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "runs": names}).encode()))
        stream.close()
        target = self._path(f"manifests/{self.version:08d}.json")
        if self._files().exists(target) or not self._files().rename(made, target):
            raise RuntimeError(f"the index {self.root} was changed by another writer")
        self.version, self.names = self.version + 1, names

    # runs

    def _table(self, name: str) -> str:
        """Names the run's files to Spark as a bucketed table."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.COLUMNS}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, c1, c2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/runs/{name}'")
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def _merge(self, parts: DataFrame) -> DataFrame:
        """first() of every column of a group is from one of its rows: which does not matter."""
        place = [F.first(c).alias(c) for c in ("doc_id", "h", "start", "n")]
        return parts.groupBy(*KEY).agg(F.sum("occurrences").alias("occurrences"), *place)

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        dealt = rows.select("anchor", "c1", "c2", "occurrences", "doc_id", "h", "start", "n").repartition(self.buckets, "anchor")
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            dealt.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy(*KEY).option("path", f"{self.root}/runs/{name}").saveAsTable(name)
        return name

    def append(self, marks: DataFrame) -> str:
        """A new batch's fingerprints become a run; older runs stay as they are."""
        name = self._write(self._merge(marks.withColumn("occurrences", F.lit(1).cast("long"))))
        self._commit([*self.names, name])
        return name

    def rows(self, names: list[str] | None = None) -> DataFrame:
        parts = [self._run(n) for n in (self.names if names is None else names)]
        out = parts[0] if parts else self.spark.createDataFrame([], self.COLUMNS)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self) -> None:
        """Merges all runs into one, which then takes their place."""
        if len(self.names) > 1:
            old = list(self.names)
            self._commit([self._write(self._merge(self.rows()))])
            for n in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {n}")
                self._files().delete(self._path(f"runs/{n}"), True)

    def met(self, name: str) -> DataFrame:
        """(anchor): anchors of a run that have several places in it, or one in an earlier run: a merge join of bucket with bucket."""
        own = self._run(name).groupBy("anchor").agg(F.sum("occurrences").alias("k"))
        found = [own.where("k > 1").select("anchor")]
        found += [own.join(self._run(n).groupBy("anchor").count().hint("merge"), "anchor").select("anchor") for n in self.names[: self.names.index(name)]]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return self.work.write(out.distinct(), f"met{next(self.number)}")

    def contexts(self, anchors: DataFrame) -> DataFrame:
        """A row a context of these anchors, over all runs. Only the anchors are dealt to the runs' buckets."""
        parts = [self._run(n).join(anchors.repartition(self.buckets, "anchor").hint("merge"), "anchor", "left_semi") for n in self.names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return self.work.write(self._merge(out), f"contexts{next(self.number)}")

    def close(self) -> None:
        """Spark forgets the runs' names; the files stay."""
        for n in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def ingest(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Adds a batch; gives (doc_id, h, start, n) of its windows that also start elsewhere in it or in history, the documents that came before, of which only those are read whose windows are in doubt."""
        rows = docs.select("doc_id", "text")
        marks = self.work.write(fingerprints(rows), f"marks{next(self.number)}")
        contexts = self.contexts(self.met(self.append(marks)))
        if len(self.names) > self.MOST_RUNS:
            self.compact()
        found = self.repeated(rows if history is None else history.select("doc_id", "text").unionByName(rows), marks, contexts)
        own = keyed(rows).select(F.col("doc_id").alias("o_doc"), F.col("h").alias("o_h")).distinct()
        return found.join(own, F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("h") == F.col("o_h")), "left_semi")

    def repeated(self, docs: DataFrame, marks: DataFrame, contexts: DataFrame) -> DataFrame:
        """(doc_id, h, start, n): windows of documents, whose fingerprints are marks, that contexts have elsewhere too; and of docs where contexts had to be opened. docs hold every place that contexts name."""
        work, turn = self.work, next(self.number)
        whole = marks.join(contexts.where("occurrences > 1").select(*KEY), KEY).select("doc_id", "h", "start", "n")
        shared = work.write(contexts.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1").select("anchor"), f"shared{turn}")
        opened = work.write(contexts.join(shared, "anchor").select("doc_id", "h", "start", "n", "occurrences"), f"opened{turn}")
        # a context that occurs once is alone with its windows if no other context of the anchor has them; rows equal
        # in id and text open a place twice, but then every window of theirs is repeated
        windows = work.write(arrow_map(joined(docs, opened.select("doc_id", "h", "start", "n"), "inner").select("doc_id", "h", "text", "spans"), _open, "doc_id long, h long, start int, w1 long, w2 long"), f"windows{turn}")
        several = work.write(windows.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2"), f"several{turn}")
        single = windows.join(several, ["w1", "w2"]).select("doc_id", "h", "start", F.lit(1).alias("n"))
        return work.write(whole, f"whole{turn}").unionByName(work.write(single, f"single{turn}"))


def _spans(docs: DataFrame, batches: int) -> DataFrame:
    """Word spans that repeated windows cover. Documents reach the index in that many batches, each of which is joined with those before it; the anchors that met tell which contexts are looked at, for early and late documents alike."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "substrings")
    marks, index = work.write(fingerprints(docs), "marks"), FingerprintIndex(spark, f"{work.root}/index", work)
    try:
        anchors = [index.met(index.append(marks.where(F.pmod(F.col("h"), F.lit(batches)) == k))) for k in range(batches)]
        met = anchors[0]
        for a in anchors[1:]:
            met = met.unionByName(a)
        return index.repeated(docs, marks, index.contexts(met.distinct())).withColumn("n", F.col("n") + WINDOW - 1)
    finally:  # names of runs do not outlive the call, whatever ended it
        index.close()


def remove_repeats(docs: DataFrame, batches: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every row without the words that windows cover which also start elsewhere, those kept joined by spaces.

    Null texts have no words. Rows equal in id and text are two places of the same windows. Texts shorter than a
    window stay. No rows: no rows. Extra columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    cut = cut_out(rows, _spans(rows, batches), words, b" ", False)
    return cut.select(F.col("_rest.doc_id").cast("long").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", "text")


def stage(docs: DataFrame, batches: int = 2) -> DataFrame:
    """docs with those words removed, all columns kept; every row stays, and a text without repeats, null ones too, stays as it is. No rows: no rows."""
    return with_text(cut_out(docs, _spans(docs.select("doc_id", "text"), batches), words, b" ", True), docs.columns)

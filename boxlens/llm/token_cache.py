"""Token counts kept by digest: a text is encoded once for a tokenizer version, ever.

The cache is a Parquet folder of immutable runs (tokenizer_digest, content_digest, n_tokens, run). A call
joins the digests of its texts to it, encodes one text of each digest that is missing, appends a run.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.llm.common import Workspace, arrow_map, as_bytes, as_texts, slices

SLICE_BYTES = 1 << 18
CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Of the file's bytes and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


@lru_cache(2)
def _loaded(spec: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Tokenizer.from_str(spec)
    made.no_truncation()
    made.no_padding()
    return made


def bounded_by_space(spec: str) -> bool:
    """Whether the tokenizer drops white space and lets no piece go over it, as its file says: then texts are the sum of their words."""
    import regex

    d = json.loads(spec)
    steps = d["normalizer"]["normalizers"] if (d["normalizer"] or {}).get("type") == "Sequence" else [d["normalizer"]] if d["normalizer"] else []
    harmless = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " ") for x in steps)
    before = d["pre_tokenizer"] or {}
    parts = before.get("pretokenizers", [before])
    cut = parts[0]
    if not harmless or cut.get("type") != "Split" or cut["behavior"] != "Removed" or not cut["invert"] or "Regex" not in cut["pattern"]:
        return False
    if any(x.get("type") != "ByteLevel" or x.get("add_prefix_space") for x in parts[1:]) or any(c.isspace() for t in d["added_tokens"] for c in t["content"]):
        return False
    space = " \t\n\r\v\f"  # where words end
    probes = [a + b + c for a in ("x", "7", "'", "-") for b in space for c in ("x", "7", "'s", "-", *space)]
    return not any(c in space for p in probes for m in regex.findall(cut["pattern"]["Regex"], p) for c in m)


class WordCounts:
    """Token counts of texts from those of their words, each of which the library encodes once while it is remembered.

    Holds where the tokenizer takes white space as a bound of its pieces and drops it, as with word ends: tests hold it
    against the library. Words end at ASCII white space.
    """

    MOST_WORDS = 300_000

    def __init__(self, tokenizer):
        self.encode, self.known = tokenizer.encode_batch_fast, {}

    def count(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]
        if len(self.known) > self.MOST_WORDS:
            self.known = {}
        known = self.known
        new = [w for w in set().union(*words) if w not in known]
        known.update(zip(new, map(len, self.encode([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, w)) for w in words]


def _counter(spec, by_word: bool):
    def run(batches):
        tokenizer = _loaded(spec.value)
        words = WordCounts(tokenizer)
        for b in batches:
            counts: list[int] = []
            if by_word:
                texts = as_bytes(b.column(1))
                for s in slices([len(t) for t in texts], 4 * SLICE_BYTES):
                    counts += words.count(texts[s])
            else:
                texts = as_texts(b.column(1))
                for s in slices([len(t) for t in texts], SLICE_BYTES):
                    counts += [len(e) for e in tokenizer.encode_batch_fast(texts[s], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    return run


class TokenCache:
    """collapse_space: the tokenizer drops white space, which bounds its pieces (bounded_by_space tells, unless the caller does): texts that differ in runs of it only share a digest, and counts are sums over words."""

    def __init__(self, spark: SparkSession, path: str, tokenizer_path: str, collapse_space: bool | None = None):
        if collapse_space is None:
            with open(tokenizer_path, encoding="utf-8") as f:
                collapse_space = bounded_by_space(f.read())
        self.spark, self.path, self.tokenizer_path, self.collapse_space = spark, path, tokenizer_path, collapse_space
        self.version = tokenizer_digest(tokenizer_path)

    def stored(self) -> DataFrame:
        """Counts of this tokenizer version; a digest that two writers appended at once is there once."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            runs = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        else:
            runs = self.spark.createDataFrame([], CACHE_SCHEMA)
        return runs.where(F.col("tokenizer_digest") == self.version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def _content(self):
        text = F.coalesce(F.col("text"), F.lit(""))
        return F.btrim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")) if self.collapse_space else text

    def count(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_bytes, n_tokens) of every row. Null text: 0 and what the tokenizer gives for an empty text. Rows with the same or a null id stay rows of their own; extra columns do not matter. No rows: no rows."""
        work = Workspace(self.spark, "token-cache")
        docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
        digest = F.unhex(F.sha2(self._content().cast("binary"), 256))
        keyed = work.write(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest.alias("content_digest")), "keyed")
        # one row of each digest that the cache lacks: ids only, partial sums meet a hot digest
        misses = keyed.groupBy("content_digest").agg(F.min("doc_id").alias("rep")).join(self.stored(), "content_digest", "left_anti")
        work.write(misses.select("rep", "content_digest"), "misses")
        misses = self.spark.read.parquet(f"{work.root}/misses")
        texts = docs.withColumn("_d", digest).join(misses, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("_d") == F.col("content_digest")))
        with open(self.tokenizer_path, encoding="utf-8") as f:
            spec = self.spark.sparkContext.broadcast(f.read())  # bounded by the vocabulary
        counted = arrow_map(texts.select("content_digest", "text"), _counter(spec, self.collapse_space), "content_digest binary, n_tokens long")
        run = counted.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
        run.select(F.lit(self.version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(f"{self.path}")
        counts = work.write(self.stored(), "counts")  # a table, so that Spark can split a hot digest's rows in the join
        return keyed.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens")


def fresh_cache(spark: SparkSession, tokenizer_path: str, collapse_space: bool | None = None) -> TokenCache:
    """An empty cache in the shared folder."""
    return TokenCache(spark, f"{Workspace(spark, 'token-cache').root}/{uuid.uuid4().hex}", tokenizer_path, collapse_space)

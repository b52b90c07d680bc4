"""Runs of words or lines to be cut out of documents: rows get them by id and content, so repeated and null ids are safe."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlens.llm.common import arrow_map


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h is a hash of the text. Rows equal in both get the same spans, as they must."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def by_document(spans: DataFrame) -> DataFrame:
    """spans (doc_id, h, start, n) gathered by document: at most one for each of its words or lines."""
    return spans.groupBy(F.col("doc_id").alias("s_doc"), F.col("h").alias("s_h")).agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def joined(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """(doc_id, h, text, _rest, spans): rows of docs, the columns but the text under _rest. Both sides are always shuffled: what spans hold follows the input, so a plan that broadcasts them on less of it tells nothing."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"), rest)
    return whole.join(by_document(spans).hint("merge"), F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("h") == F.col("s_h")), how)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places the spans cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths, n), -1)
    return np.cumsum(step[:n]) > 0


def cut_out(docs: DataFrame, spans: DataFrame, split: Callable[[bytes], list[bytes]], glue: bytes, keep_whole: bool) -> DataFrame:
    """Every row of docs: (_rest, n, n_removed, text), the pieces of its text that no span covers, glued. keep_whole: a text of which nothing is removed stays as it is, white space and null included."""
    both = joined(docs, spans, "left").select("_rest", "text", "spans")
    out = T.StructType([both.schema["_rest"], T.StructField("n", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            found = b.column("spans")
            values, offsets, some = found.values, found.offsets.to_numpy(), found.is_valid().to_numpy(zero_copy_only=False)
            starts, lengths = (values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
            for k, text in enumerate(b.column("text").cast(pa.binary())):
                text = text.as_py()
                parts = split(text or b"")
                lo, hi, n = offsets[k], offsets[k + 1], len(parts)
                if some[k] and hi > lo and n:
                    gone = covered(n, starts[lo:hi], lengths[lo:hi]).tolist()
                    parts = [p for p, g in zip(parts, gone, strict=True) if not g]
                total.append(n)
                removed.append(n - len(parts))
                kept.append(text if keep_whole and len(parts) == n else glue.join(parts))
            yield pa.RecordBatch.from_arrays([b.column("_rest"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["_rest", "n", "n_removed", "text"])

    return arrow_map(both, run, out)


def with_text(cut: DataFrame, columns: list[str]) -> DataFrame:
    """The original columns in their types, with the kept text, and its length in n_chars where something was removed."""
    length = None
    if "n_chars" in columns:
        own = cut.schema["_rest"].dataType["n_chars"].dataType
        length = F.when(F.col("n_removed") > 0, F.length("text").cast(own)).otherwise(F.col("_rest.n_chars"))
    new = {"text": F.col("text"), "n_chars": length}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"_rest.`{c}`").alias(c) for c in columns])

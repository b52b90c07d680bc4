"""Claims over a stream of matched detections: an extension.

Detections that match an object within a span of event time compete for it. A better one that comes later, but before the
watermark has passed the span, takes the claim over; nothing goes out before. When the span's timer fires, all its outcomes go out
once and its state goes. Rows that come after that are late and are dropped by the watermark.

Objects share state by a hash: a call of Python and a timer for each object and span would cost far more than its few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from boxlens.tables import _setting

#: Rows that came together, packed.
STATE = "rows binary"
COLUMNS = ["gt_id", "det_id", "score", "difficult"]
#: Parts of the objects of a span.
PARTS = 16
OUT = "gt_id long, span timestamp, det_id long, outcome string, place long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcomes(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each object's detections in a span: the first in order of score, of equals the larger id, claims it."""
    d = rows.drop_duplicates(["gt_id", "det_id"]).sort_values(["gt_id", "score", "det_id"], ascending=[True, False, False], ignore_index=True)
    place = d.groupby("gt_id").cumcount() + 1
    outcome = np.where(d["difficult"].astype(bool), "ignored", np.where(place == 1, "tp", "fp"))
    return pd.DataFrame({"gt_id": d["gt_id"], "det_id": d["det_id"], "outcome": outcome.astype(object), "place": place.astype("int64")})


class Claims(StatefulProcessor):
    """Keyed by span and part of its objects. State: the detections so far, as they came; one timer, at the span's end."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            self.handle.registerTimer(int(key[0].timestamp() * 1000) + self.seconds * 1000)
        for d in rows:
            self.held.appendValue((packed(d[COLUMNS]),))
        yield pd.DataFrame({"gt_id": [], "span": [], "det_id": [], "outcome": [], "place": []}).astype({"gt_id": "int64", "det_id": "int64", "place": "int64", "outcome": "object", "span": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.concat([unpacked(bytes(r[0])) for r in self.held.get()], ignore_index=True)
        self.held.clear()
        found = outcomes(rows)
        found.insert(1, "span", key[0])
        yield found

    def close(self) -> None:
        pass


def packed(d: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(d, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


@contextmanager
def state_in_rocks(spark: SparkSession):
    """This kind of state needs that store; the session's setting is as before afterwards."""
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        yield


def claim_stream(stream: DataFrame, span: str, seconds: int, late: str, parts: int = PARTS) -> DataFrame:
    """(gt_id, span, det_id, outcome, place) from a stream of gt_id, det_id, score, difficult, ts. span: a unit that date_trunc knows, of that many seconds; late: how far the watermark stays behind. A detection that comes twice counts once. parts: of the objects of a span; the rows of a part and span must fit a task."""
    rows = stream.select("gt_id", "det_id", "score", "difficult", "ts").withWatermark("ts", late).withColumn("span", F.date_trunc(span, "ts"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("gt_id"), F.lit(parts)).cast("int"))
    return rows.groupBy("span", "part").transformWithStateInPandas(Claims(seconds), OUT, outputMode="Append", timeMode="EventTime")

"""Repeats dropped from an unbounded stream, remembering keys for a limited time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from corpuskit.streaming.state import millis_of, use_engine_state

FIRST, LAST = "_first_ms", "_last_ms"


class FirstSightings(StatefulProcessor):
    """Remembers a key until the watermark is ``horizon_ms`` beyond its last row; the engine holds the state."""

    def __init__(self, columns: list[str], horizon_ms: int):
        self.columns, self.horizon_ms = columns, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        first, last = None, watermark
        for row in rows:
            if first is None or row[FIRST] is not None and (first[FIRST] is None or row[FIRST] < first[FIRST]):
                first = row
            last = max(last, row[LAST] if row[LAST] is not None else last)
        until, before = last + self.horizon_ms, self.until.get()[0] if self.until.exists() else None
        if before is None:
            late = first[FIRST] is not None and first[FIRST] < watermark
            yield Row(**{c: first[c] for c in self.columns}, late=late)
        if before is None or until > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.until.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def thinned(batches, key: list[str]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a key in a batch the earliest, with the times of the first and the last of them.

    It keeps no state and drops no key, so a key that makes up much of the stream reaches its task as a few rows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        order = pc.sort_indices(table, sort_keys=[(FIRST, "ascending")])  # nulls last
        names = [f"k{i}" for i in range(len(key))]
        keys = pa.table([table.column(k).take(order) for k in key] + [order, table.column(LAST).take(order)], names=[*names, "no", "last"])
        found = keys.group_by(names, use_threads=False).aggregate([("no", "first"), ("last", "max")])
        rows = table.take(found.column("no_first"))
        rows = rows.set_column(rows.schema.get_field_index(LAST), table.schema.field(LAST), found.column("last_max"))
        yield from rows.combine_chunks().to_batches()


def dedupe_stream(df: DataFrame, key: list[str], event_time: str, horizon: str) -> DataFrame:
    """First row of each key, with ``late``: whether it is older than the watermark, ``horizon`` behind the newest row.

    A key is remembered until the watermark is ``horizon`` beyond its last row, so a key comes out once as long as its rows are less
    than that apart. Nothing vanishes: the first row of a key that comes too late comes out marked, for
    the key may have been seen and forgotten. Of several rows of a key in one micro-batch the earliest is taken; rows without
    a time are never late. For a history without limit see `corpuskit.streaming.ingest.store_new_documents`.
    """
    use_engine_state(df.sparkSession)
    watched = df.withColumn("_event", F.col(event_time).cast("timestamp")).withWatermark("_event", horizon)
    # The times go on without the watermark's mark, or the engine would drop late rows unseen.
    millis = F.unix_millis(F.col("_event") + F.expr("interval 0 seconds"))
    timed = watched.select(*df.columns, millis.alias(FIRST), millis.alias(LAST))
    thin = timed.mapInArrow(lambda batches: thinned(batches, key), timed.schema)
    kind = StructType([*df.schema.fields, StructField("late", BooleanType())])
    return thin.groupBy(*key).transformWithState(FirstSightings(df.columns, millis_of(horizon)), kind, "Append", "EventTime")

"""Live state of a change log that arrives as a stream.

Late rows are rows of lower seq; they lose against what is known, whenever they come. State keeps
tombstones: a delete that was forgotten would let an older value, arriving later, live again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from siltstone.operators.state import newest


class Newest(StatefulProcessor):
    """Per key: the greatest seq seen, with its payload; emits a row whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "seq bigint, tombstone boolean, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.best.get() if self.best.exists() else None
        top = known
        for b in rows:
            r = b.loc[b["seq"].idxmax()]
            if top is None or int(r["seq"]) > top[0]:
                top = (int(r["seq"]), bool(r["tombstone"]), None if pd.isna(r["value"]) else str(r["value"]))
        if top is not None and top != known:
            self.best.update(top)
            yield pd.DataFrame({"key": [key[0]], "seq": [top[0]], "tombstone": [top[1]], "value": [top[2]]})

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """Changes of the live state of a stream (key, seq, tombstone, value); update mode. Needs the
    RocksDB state store."""
    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").transformWithStateInPandas(Newest(), f"key {kind}, seq bigint, tombstone boolean, value string", "Update", "None")


def aggregate_state(stream: DataFrame) -> DataFrame:
    """The same as one grouped maximum, for complete mode; deletes are filtered by the reader."""
    return stream.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("tombstone", "value"), "seq").alias("x")).select("key", "seq", "x.tombstone", "x.value")


def maintain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's newest rows to a parquet log under ``path``; readers take
    newest-wins over it. A batch is combined before it is written, and its folder is named by
    its id, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

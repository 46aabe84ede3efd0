"""Newest-wins state of a change log, and what is read from it.

A log has key, seq (unique; the only order there is), tombstone and payload columns. Deletes are
dropped after the newest row of each key is known: dropping them first would bring deleted keys
back. The grouped maximum is combined before the shuffle, so a hot key sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The row of greatest seq of every key, deletes included."""
    rest = [c for c in log.columns if c not in (key, seq)]
    best = log.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(F.struct(*rest), seq).alias("_x"))
    return best.select(key, seq, *[F.col(f"_x.{c}").alias(c) for c in rest])


def latest_state(log: DataFrame, key: str = "key", seq: str = "seq", tombstone: str = "tombstone") -> DataFrame:
    """Live rows: newest per key, without deleted keys."""
    return newest(log, key, seq).filter(~F.col(tombstone)).drop(tombstone)


def live_count(log: DataFrame) -> DataFrame:
    return latest_state(log).agg(F.count("*").alias("live_keys"))


def next_seq(log: DataFrame) -> DataFrame:
    """The number the next write gets: over all rows, tombstones too."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("bigint").alias("next_seq"))


def point_get(log: DataFrame, key: Column) -> DataFrame:
    """The live row of one key. The filter goes below the aggregate and into the scan."""
    return latest_state(log).filter(F.col("key") == key)


def count_existing(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many of the wanted (key) rows are live; a key asked twice counts twice."""
    return wanted.join(latest_state(log).select("key"), "key").agg(F.count("*").alias("n_existing"))


def effective_deletes(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tombstones that a delete of the wanted keys writes: live keys alone, each once."""
    return wanted.select("key").distinct().join(latest_state(log).select("key"), "key", "left_semi")


def marked_live(log: DataFrame) -> DataFrame:
    """The rows of a log with ``live``: whether the state points at the row's file and offset."""
    state = latest_state(log).select("key", "file_id", "offset", F.lit(True).alias("_live"))
    return log.join(state, ["key", "file_id", "offset"], "left").select(*log.columns, F.coalesce("_live", F.lit(False)).alias("live"))


def split_live(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, garbage) rows of a log."""
    marked = marked_live(log)
    return marked.filter("live").drop("live"), marked.filter("not live").drop("live")


def compact(log: DataFrame) -> DataFrame:
    """The log after compaction: live rows under their old seq, no tombstones. That is the newest row
    of each key where it is no delete, so the log is read once."""
    return newest(log).filter(~F.col("tombstone")).select(*log.columns)


def repoint(current: DataFrame, moved: DataFrame) -> DataFrame:
    """Index rows (key, file_id, offset) after moved (key, old_file, old_offset, new_file,
    new_offset): only rows that still name the old place change."""
    m = moved.select("key", F.col("old_file").alias("file_id"), F.col("old_offset").alias("offset"), "new_file", "new_offset")
    return current.join(m, ["key", "file_id", "offset"], "left").select(
        "key", F.coalesce("new_file", "file_id").alias("file_id"), F.coalesce("new_offset", "offset").alias("offset"), F.col("new_file").isNotNull().alias("moved")
    )


def state_diff(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(key, change) for every key that is added, removed or changed between two states."""
    b = before.select("key", F.struct(*columns).alias("_b"))
    a = after.select("key", F.struct(*columns).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return b.join(a, "key", "full_outer").select("key", change.alias("change")).filter("change is not null")


def unwritten(state: DataFrame, history: DataFrame) -> DataFrame:
    """Live (key, value) pairs that no write in the history made: must be empty."""
    same = state["key"].eqNullSafe(history["key"]) & state["value"].eqNullSafe(history["value"])
    return state.join(history.select("key", "value"), same, "left_anti")


def verified_get(index: DataFrame, records: DataFrame) -> DataFrame:
    """(key, status) of reads through an index (key, file_id, offset): ok, missing, checksum or
    wrong key. Records have file_id, offset, record_key, crc_ok."""
    status = F.when(F.col("record_key").isNull(), "missing").when(~F.col("crc_ok"), "checksum").when(F.col("record_key") != F.col("key"), "wrong key").otherwise("ok")
    return index.join(records, ["file_id", "offset"], "left").select("key", status.alias("status"))

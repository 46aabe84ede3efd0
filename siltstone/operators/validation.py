"""Log validation and recovery rules over decoded records (file_id, offset, record_size, outcome)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.state import latest_state, next_seq


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records before the first one of their file that isn't ok. The first bad offset is a grouped
    minimum, so no file is sorted."""
    bad = records.filter(F.col("outcome") != "ok").groupBy("file_id").agg(F.min("offset").alias("_bad"))
    return records.join(bad, "file_id", "left").filter(F.col("_bad").isNull() | (F.col("offset") < F.col("_bad"))).drop("_bad")


def torn(records: DataFrame) -> DataFrame:
    """(file_id, torn_bytes, corrupt): bytes from the first bad record to the end of its file, and
    whether it was corrupt rather than cut off."""
    first = F.min(F.when(F.col("outcome") != "ok", F.struct("offset", "outcome")))
    ends = records.groupBy("file_id").agg(F.max(F.col("offset") + F.col("record_size")).alias("_end"), first.alias("_bad"))
    return ends.select(
        "file_id", F.coalesce(F.col("_end") - F.col("_bad.offset"), F.lit(0)).cast("bigint").alias("torn_bytes"), F.coalesce((F.col("_bad.outcome") == "corrupt").cast("bigint"), F.lit(0).cast("bigint")).alias("corrupt")
    )


def usable_index(entries: DataFrame, file_sizes: DataFrame) -> DataFrame:
    """(file_id, source): `index` if every entry of a file's index is valid and inside the file,
    else `scan`; an index counts whole or not at all."""
    checked = entries.join(file_sizes, "file_id", "left")
    ok = F.col("entry_ok") & (F.col("offset") + F.col("record_size") <= F.coalesce("file_size", F.lit(0)))
    return checked.groupBy("file_id").agg(F.when(F.min(ok), "index").otherwise("scan").alias("source"))


def surviving_files(files: DataFrame, victims: DataFrame) -> DataFrame:
    """Files to load: not named by the marker of an interrupted compaction, and not empty."""
    return files.join(victims, "file_id", "left_anti").filter("file_size > 0")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status) of a backup: ok, missing, checksum mismatch, path with directory, extra."""
    m = manifest.select("name", F.col("sha256").alias("_m"))
    f = files.select("name", F.col("sha256").alias("_f"))
    status = (
        F.when(F.col("_m").isNull(), "extra").when(F.contains("name", F.lit("/")), "path with directory").when(F.col("_f").isNull(), "missing")
        .when(F.col("_m") != F.col("_f"), "checksum mismatch").otherwise("ok")
    )
    return m.join(f, "name", "full_outer").select("name", status.alias("status"))


def recover(records: DataFrame, victims: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, report) of decoded records of all files (file_id, offset, record_size, seq, tombstone, key,
    value, outcome): files that an interrupted compaction names are left out, each file counts up to
    its first bad record, the newest row of a key wins, and deletes go last. The report has the next
    number, over tombstones too, and what was cut off."""
    kept = records if victims is None else records.join(victims, "file_id", "left_anti")
    log = valid_prefix(kept)
    rest = torn(kept).agg(F.coalesce(F.sum("torn_bytes"), F.lit(0)).cast("bigint").alias("torn_bytes"), F.coalesce(F.sum("corrupt"), F.lit(0)).cast("bigint").alias("corrupt_records"))
    return latest_state(log).drop("outcome"), next_seq(log).crossJoin(rest)  # one row each


def repaired(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, content) with damaged tails cut off: each file's bytes up to its first bad record."""
    end = torn(records).select("file_id", "torn_bytes")
    size = F.octet_length("content") - F.coalesce("torn_bytes", F.lit(0))
    return files.join(end, "file_id", "left").select("file_id", F.substring(F.col("content"), F.lit(1), size.cast("int")).alias("content"))

"""Backup of a folder of log files as a table with a manifest, and restore that verifies first.

An archive is two parquet tables: `files` (name, content) and `manifest` (name, bytes, sha256). Files are
read and written by the executors, one row a file; only names, sizes and checksums are compared.
Names without a folder are allowed alone, so a restored file can't leave the target folder. The
target is a folder that driver and executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.validation import verify_manifest


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the data files and indexes of a folder."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
    return files.filter(F.regexp_like("name", F.lit(r"^[0-9]{9}\.(data|hint)$")))


def manifest_of(files: DataFrame) -> DataFrame:
    """(name, bytes, sha256) of files (name, content)."""
    return files.select("name", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def backup(spark: SparkSession, folder: str, archive: str) -> None:
    contents(spark, folder).write.parquet(f"{archive}/files")
    manifest_of(spark.read.parquet(f"{archive}/files")).write.parquet(f"{archive}/manifest")


def verify(spark: SparkSession, archive: str) -> DataFrame:
    """(name, status) of all files of an archive, or of its manifest."""
    return verify_manifest(spark.read.parquet(f"{archive}/manifest"), manifest_of(spark.read.parquet(f"{archive}/files")))


def restore(spark: SparkSession, archive: str, folder: str, *, force: bool = False) -> int:
    """Writes an archive's files to a folder and returns their number. Everything is verified before
    anything is written. Refused while a writer holds the folder's lock, and where it has data
    files, unless forced; these then go."""
    bad = verify(spark, archive).filter("status <> 'ok'").orderBy("name").first()
    if bad:
        raise ValueError(f"{bad['status']}: {bad['name']}")
    os.makedirs(folder, exist_ok=True)
    lock = os.path.join(folder, "LOCK")
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        raise RuntimeError("restore refused: a writer holds the lock") from None
    try:
        old = [n for n in os.listdir(folder) if n.endswith((".data", ".hint", ".tmp"))]
        if old and not force:
            raise RuntimeError(f"restore refused: the folder has {len(old)} data files")
        for n in old:
            os.remove(os.path.join(folder, n))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    tmp = os.path.join(folder, name + ".tmp")
                    with open(tmp, "wb") as f:
                        f.write(content)
                        f.flush()
                        os.fsync(f.fileno())
                    os.replace(tmp, os.path.join(folder, name))
                yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

        return spark.read.parquet(f"{archive}/files").select("name", "content").mapInArrow(write, "name string").count()
    finally:
        os.remove(lock)

"""Shared plumbing of the training-data operators: tables, shared folders, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.folders import shared_dir

#: Rows and bytes handed to a Python worker at once; a row above that comes alone.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data folder, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get; the settings are read when a job starts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: its lineage ends there, and a
    lost executor costs no recomputation of what came before."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path  # noqa: SLF001
    return back


def drop_cut(*dfs: DataFrame) -> None:
    """Deletes tables made by cut() that no later plan reads."""
    for df in dfs:
        spark, path = df.sparkSession, getattr(df, "_cut_path", None)
        if path:
            jvm = spark._jvm  # noqa: SLF001
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def gathered(df: DataFrame, each: int = 100, limit: int = 32 << 20) -> DataFrame:
    """A written table of narrow rows, marked for a broadcast where its rows, of ``each`` bytes at most
    in memory, stay within ``limit``; else it is joined by a shuffle."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() * each <= limit else kept


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[[dict[str, list]], dict[str, list]], setup: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over the named columns alone; ``fn`` maps lists of values to lists of values."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for batch in batches:
            if batch.num_rows:
                got = fn({c: batch.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def text_bytes(df: DataFrame, columns: list[str]) -> int:
    """Bytes of the named string columns over all rows; the check in front of every broadcast."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))
    return df.agg(F.sum(total).alias("n")).first()["n"] or 0

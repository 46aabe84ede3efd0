"""Ordered replay: counters, mixed commands per key, and file rotation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def counter_replay(ops: DataFrame) -> DataFrame:
    """(key, counter, exists) after INCR, DECR and DEL in order of seq.

    Only what follows a key's last DEL counts, so two grouped aggregates do, both combined before
    the shuffle; no key is folded row by row. For counters far from the 64-bit limits."""
    reset = ops.groupBy("key").agg(F.max(F.when(F.col("op") == "DEL", F.col("seq"))).alias("_r"))
    step = F.when(F.col("op") == "INCR", 1).when(F.col("op") == "DECR", -1).otherwise(0)
    after = F.col("_r").isNull() | (F.col("seq") > F.col("_r"))
    return ops.join(reset, "key").groupBy("key").agg(F.sum(F.when(after, step).otherwise(0)).cast("bigint").alias("counter"), F.max(after & (F.col("op") != "DEL")).alias("exists"))


def in_order(rows: DataFrame, by: list[str], order: list[str], schema: str, make: Callable[[], Callable[[dict], Iterator[tuple]]]) -> DataFrame:
    """Rows of ``schema`` out of a fold over the rows of each group in order. Groups are sorted outside
    the worker and streamed through it, so it holds one batch and the state of one group."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, got = make(), []
        for batch in batches:
            for row in batch.to_pylist():
                got += step(row)
                if len(got) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)
                    got = []
        got += step({})  # the end
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def add_to(value: str | None, step: int) -> tuple[str | None, str | None]:
    """(new value, error) of adding 1 or -1 to a decimal text; a missing one counts as 0."""
    if value is not None and not re.fullmatch(r"-?[0-9]+", value) or not -(1 << 63) <= (now := int(value or 0)) < 1 << 63:
        return value, "value is not an integer or out of range"
    if not -(1 << 63) <= now + step < 1 << 63:
        return value, "increment or decrement would overflow"
    return str(now + step), None


def fold_commands(ops: DataFrame) -> DataFrame:
    """(key, value, errors) after SET, DEL, INCR and DECR (key, seq, op, arg) in order of seq.

    INCR and DECR of a missing key start at 0; a value that is no integer, or an overflow, is an
    error that leaves the value as it is."""
    kind = ops.schema["key"].dataType.simpleString()

    def make() -> Callable[[dict], Iterator[tuple]]:
        now: list = []  # key, value, errors

        def step(row: dict) -> Iterator[tuple]:
            if now and (not row or row["key"] != now[0]):
                yield tuple(now)
                now.clear()
            if not row:
                return
            if not now:
                now[:] = [row["key"], None, 0]
            if row["op"] in ("SET", "DEL"):
                now[1] = row["arg"] if row["op"] == "SET" else None
            else:
                now[1], error = add_to(now[1], 1 if row["op"] == "INCR" else -1)
                now[2] += error is not None

        return step

    return in_order(ops.select("key", "seq", "op", "arg"), ["key"], ["seq"], f"key {kind}, value string, errors bigint", make)


def rotate(records: DataFrame, limit: int, group: str = "grp") -> DataFrame:
    """(grp, seq, size, file_no, offset): greedy file numbers within each writer's group.

    A record opens a new file if its file has bytes and would grow past the limit. Restarts depend
    on earlier restarts, which no window sum gives: each group's sorted sizes are streamed, and every
    file is one jump in their running sums."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = records.select(group, F.col("seq").cast("bigint").alias("seq"), F.col("size").cast("bigint").alias("size"))
    kind = rows.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, seq bigint, size bigint, file_no bigint, offset bigint"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file_no, used = None, 0, 0
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            files, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now is None or names[a] != now[0]:
                    now, file_no, used = (names[a],), 0, 0
                upto = np.concatenate([[0], np.cumsum(sizes[a:b])])
                k = 0
                while k < b - a:
                    # the last record that still fits; a record alone always does
                    fits = int(np.searchsorted(upto, upto[k] + limit - used, side="right")) - 1
                    if fits <= k:
                        if used:
                            file_no, used = file_no + 1, 0
                            continue
                        fits = k + 1
                    files[a + k : a + fits] = file_no
                    offsets[a + k : a + fits] = used + upto[k:fits] - upto[k]
                    used += int(upto[fits] - upto[k])
                    k = fits
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files), pa.array(offsets)], schema=out)

    return rows.repartition(group).sortWithinPartitions(group, "seq").mapInArrow(run, schema)


def running_sum(rows: DataFrame, position: str, value: str, width: int = 1 << 12) -> DataFrame:
    """``running``: the sum of ``value`` up to each row in the order of ``position``, whole numbers that
    don't repeat. Ranges of ``width`` positions are summed first; where their totals are more than a
    million ranges, these are added up in the same way, so no task gets a share of all rows."""
    placed = rows.withColumn("_b", F.expr(f"`{position}` div {width}"))
    totals = placed.groupBy("_b").agg(F.sum(value).alias("_t"))
    low, high = rows.agg(F.min(position), F.max(position)).first()
    if low is not None and (high - low) // width > 1 << 20:
        upper = totals.select(F.col("_b").alias("_p"), F.col("_t").alias("_v"))
        before = running_sum(upper, "_p", "_v", width).select(F.col("_p").alias("_b"), (F.col("running") - F.col("_v")).alias("_o"))
    else:
        before = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_o"))
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy(position))
    return placed.withColumn("_i", inside).join(before, "_b").withColumn("running", (F.col("_i") + F.col("_o")).cast("bigint")).drop("_b", "_i", "_o")


def workload(spark: SparkSession, n: int, seed: int, keys: int, deletes: int) -> DataFrame:
    """(seq, key, tombstone, value): ``n`` writes to ``keys`` keys, ``deletes`` percent of them deletes, drawn
    by a hash of the seed and the number, so every run and every machine makes the same ones."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    part = lambda at: F.conv(F.substring(drawn, at, 4), 16, 10).cast("bigint")
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("k"), (part(1) % keys).cast("string")).alias("key"), (part(5) % 100 < deletes).alias("tombstone"), F.concat(F.lit("op"), F.col("id").cast("string")).alias("value"))

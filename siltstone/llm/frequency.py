"""Which 64-bit keys come often: exact counts of cells over all data, kept as a table of fixed size.

Tasks pack their keys: sorted, counted, dealt into ``buckets`` ranges by the leading bits, four bytes a
key. A key that fills the corpus is one entry of a pack. Each bucket's cells (the 32 bits after the
bucket's) are then counted in one task, pack by pack; the number of buckets follows the number of
input partitions, so a bucket holds about as many cells at every size.

The outcome is a table of ``1 << size`` entries, in slices by bucket. An entry is 0, or the number of
thresholds that some cell at it exceeds (one bit an entry for one threshold, two for up to three).
A cell has PROBES entries of its slice and counts as the least of them. The table has a fixed size
on the driver and in every task. It errs upwards only, so whoever uses it as a filter loses
nothing; on inputs far beyond its size it filters less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import small_batches

PACK = 1 << 21  # keys sorted at once
MERGE = 1 << 22  # cells of one bucket merged at once
LEAST_BUCKETS, MOST_BUCKETS = 512, 1 << 16

#: Odd factors that spread a cell over its slice.
PROBES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)

_SCHEMA = pa.schema([("bucket", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


class Table:
    """Classes of keys; ``bucket_bits`` leading bits of a key choose the slice."""

    def __init__(self, packed: np.ndarray, size: int, bits: int, bucket_bits: int) -> None:
        self.packed, self.size, self.bits, self.bucket_bits = packed, size, bits, bucket_bits

    def of(self, keys: np.ndarray) -> np.ndarray:
        """0, or the class, of each key (uint64)."""
        cells, slices = _split(keys, self.bucket_bits)
        inside = self.size - self.bucket_bits
        per = 3 if self.bits == 1 else 2  # entries in a byte, as a power of two
        out = None
        for factor in PROBES:
            at = (slices << inside) + ((cells * factor) >> np.uint32(32 - inside))
            low = (at & ((1 << per) - 1)).astype(np.uint8) * np.uint8(self.bits)
            got = (self.packed[at >> per] >> low) & np.uint8((1 << self.bits) - 1)
            out = got if out is None else np.minimum(out, got)
        return out


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and buckets of keys."""
    return ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4"), (keys >> np.uint64(64 - bits)).astype(np.int64)


def _packs(keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    keys.sort()  # in place: a worker holds one copy of them
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(first, append=len(keys))
    cells, bucket = _split(keys[first], bits)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    rows = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        # sorted cells by byte, so that the leading bytes compress
        planes = np.ascontiguousarray(cells[a:b].view(np.uint8).reshape(-1, 4).T)
        own = counts[a:b]
        many = b"" if own.max() == 1 else np.minimum(own, 65535).astype("<u2").tobytes()
        rows.append((int(bucket[a]), planes.tobytes(), many))
    for k in range(0, len(rows), 512):
        part = list(zip(*rows[k : k + 512], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _SCHEMA, strict=True)], schema=_SCHEMA)


def _totals(packs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cells, counts = (np.concatenate(x) for x in zip(*packs, strict=True))
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.add.reduceat(counts, first)


def frequent(df: DataFrame, columns: Sequence[str], keys_of: Callable[..., Iterator[np.ndarray]], thresholds: Sequence[int], size: int) -> Table:
    """The table of all keys that ``keys_of`` yields, as arrays of uint64, from the columns' Arrow
    arrays."""
    spark, bits = df.sparkSession, 1 if len(thresholds) == 1 else 2
    small_batches(spark)
    plan = df.select(*columns)
    wanted = 4 * plan.rdd.getNumPartitions()
    bucket_bits = (min(MOST_BUCKETS, max(LEAST_BUCKETS, wanted)) - 1).bit_length()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for keys in keys_of(*batch.columns):
                held.append(keys)
                n += len(keys)
                if n >= PACK:
                    whole, held, n = np.concatenate(held), [], 0
                    yield from _packs(whole, bucket_bits)
                    del whole
        if n:
            yield from _packs(np.concatenate(held), bucket_bits)

    def slice_of(packs: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
        cells, counts = _totals(packs)
        kind = sum((counts > t).astype(np.uint8) for t in thresholds)
        cells, kind = cells[kind > 0], kind[kind > 0]
        entries = np.zeros(1 << (size - bucket_bits), dtype=np.uint8)
        for factor in PROBES:
            np.maximum.at(entries, (cells * factor) >> np.uint32(32 - (size - bucket_bits)), kind)
        groups = entries.reshape(-1, 8 // bits) << (np.arange(8 // bits, dtype=np.uint8) * np.uint8(bits))
        return np.bitwise_or.reduce(groups, axis=1).astype(np.uint8).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, n = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([slice_of(packs)], pa.binary())], names=["bucket", "part"])

        for batch in batches:
            for bucket, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now:
                    yield from done()
                    now, packs, n = bucket, [], 0
                c = np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(4, -1).T).view("<u4").ravel()
                k = np.frombuffer(counts, "<u2").astype(np.int64) if counts else np.ones(len(c), np.int64)
                packs.append((c, k))
                n += len(c)
                if n > MERGE and len(packs) > 1:
                    packs = [_totals(packs)]
                    n = max(0, len(packs[0][0]) - MERGE // 2)
        yield from done()

    packed = plan.mapInArrow(pack, "bucket int, cells binary, counts binary")
    by_bucket = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    made = by_bucket.mapInArrow(count, "bucket int, part binary").toArrow()  # at most the table in all
    table = np.zeros((1 << size) * bits // 8, dtype=np.uint8)
    each = len(table) >> bucket_bits
    for bucket, part in zip(made["bucket"].to_pylist(), made["part"], strict=True):
        table[bucket * each : (bucket + 1) * each] = np.frombuffer(part.as_buffer(), dtype=np.uint8)
    return Table(table, size, bits, bucket_bits)

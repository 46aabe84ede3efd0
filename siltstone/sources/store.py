"""A change-log store over immutable parquet generations and one manifest.

Layout: `gen-N/` folders, and `CURRENT`, a manifest that names the live folders, the victims of the
last compaction and the highest number ever given. Readers resolve the manifest first, so a crash
between writing and publishing leaves nothing visible. Publishing writes a temporary file and
renames it. The highest number outlives the tombstones that compaction drops; numbers never repeat.
Writers hold an exclusive lock file. Local paths and one driver: the store's own metadata are a few
lines; all data goes through Spark.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.state import compact, effective_deletes, latest_state

LOG = "key binary, value binary, seq bigint, tombstone boolean, file_id bigint, record_size bigint"


#: The smallest record: a header and a key of one byte.
LEAST_FILE = 22


class Store:
    """``max_file_size``: a write starts a new file of its generation beyond that many bytes a row
    group can't split; ``grace`` seconds pass before a folder that no manifest names is removed, so
    that readers of the manifest before can end."""

    def __init__(self, spark: SparkSession, path: str, *, must_exist: bool = False, max_file_size: int = 1 << 30, grace: float = 3600.0) -> None:
        self.spark, self.path, self.max_file_size, self.grace = spark, path, max_file_size, grace
        if max_file_size < LEAST_FILE:
            raise ValueError(f"max_file_size must be at least {LEAST_FILE}")
        if must_exist and not os.path.exists(self._manifest_path):
            raise FileNotFoundError(path)
        os.makedirs(path, exist_ok=True)

    @property
    def _manifest_path(self) -> str:
        return os.path.join(self.path, "CURRENT")

    def manifest(self) -> dict:
        if not os.path.exists(self._manifest_path):
            return {"live": [], "high": 0, "next": 1}
        with open(self._manifest_path) as f:
            return json.load(f)

    def _publish(self, manifest: dict) -> None:
        tmp = self._manifest_path + ".tmp"
        with open(tmp, "w") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.rename(tmp, self._manifest_path)

    def _clean(self) -> None:
        """Removes what interrupted or replaced generations left: folders that no manifest names and
        that are older than the grace. Called with the lock held, so no writer has one open."""
        live = set(self.manifest()["live"])
        for name in os.listdir(self.path):
            path = os.path.join(self.path, name)
            if name.startswith("gen-") and name not in live and time.time() - os.path.getmtime(path) >= self.grace:
                shutil.rmtree(path)

    def vacuum(self) -> None:
        """Removes unnamed folders; readers never do."""
        with self._locked():
            self._clean()

    @contextmanager
    def _locked(self) -> Iterator[None]:
        lock = os.path.join(self.path, "LOCK")
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            raise RuntimeError("already open by another writer") from None
        try:
            yield
        finally:
            os.remove(lock)

    def log(self) -> DataFrame:
        live = self.manifest()["live"]
        if not live:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[os.path.join(self.path, g) for g in live])

    def state(self) -> DataFrame:
        return latest_state(self.log())

    def put(self, rows: DataFrame) -> None:
        """Appends rows (key, value, ord) in the order of ord, which is unique."""
        self._append(rows.select("key", "value", "ord", F.lit(False).alias("tombstone")))

    def delete(self, keys: DataFrame) -> int:
        """Appends tombstones for the live ones among the keys; returns how many."""
        dead = effective_deletes(self.log(), keys).withColumn("ord", F.col("key")).cache()
        n = dead.count()
        if n:
            self._append(dead.select("key", F.lit(b"").alias("value"), "ord", F.lit(True).alias("tombstone")))
        dead.unpersist()
        return n

    def _append(self, rows: DataFrame) -> None:
        bad = rows.filter(~F.octet_length("key").between(1, 65_536) | (F.octet_length("value") > 256 << 20))
        if not bad.isEmpty():
            raise ValueError("a key must have 1..65536 bytes, a value at most 256 MiB")
        with self._locked():
            m = self.manifest()
            name = f"gen-{m['next']}"
            placed = rows.repartitionByRange("ord").sortWithinPartitions("ord").select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"))
            placed = placed.persist()
            sizes, first, offset = {r["p"]: r["count"] for r in placed.groupBy("p").count().collect()}, m["high"] + 1, []
            for p in sorted(sizes):
                offset.append((p, first))
                first += sizes[p]
            if sizes:
                starts = F.broadcast(self.spark.createDataFrame(offset, "p int, first bigint"))  # a row for each partition
                size = (21 + F.octet_length("key") + F.octet_length("value")).cast("bigint")
                rows = placed.join(starts, "p").select("key", "value", (F.col("i") + F.col("first")).cast("bigint").alias("seq"), "tombstone", F.lit(m["next"]).cast("bigint").alias("file_id"), size.alias("record_size"))
                rows.write.option("parquet.block.size", min(self.max_file_size, 128 << 20)).parquet(os.path.join(self.path, name))
                self._publish({"live": [*m["live"], name], "high": first - 1, "next": m["next"] + 1})
            placed.unpersist()

    def compact(self) -> None:
        """Replaces all generations by one of live rows; the manifest's rename is the commit."""
        with self._locked():
            m = self.manifest()
            if not m["live"]:
                return
            name = f"gen-{m['next']}"
            compact(self.log()).select(*[c.split()[0] for c in LOG.split(", ")]).write.parquet(os.path.join(self.path, name))
            self._publish({"live": [name], "high": m["high"], "next": m["next"] + 1})
            self._clean()

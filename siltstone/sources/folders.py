"""New folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``. Where the session has no such setting, a local
    folder serves a master on one machine; on a cluster that is an error, since executors would
    not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="siltstone-"))
        root = "file://" + _OWN[0]
    return f"{root.rstrip('/')}/siltstone-{uuid.uuid4().hex}"

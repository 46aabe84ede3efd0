from siltstone.operators.state import latest_state
from siltstone.streaming import live_state

KIND = "key string, seq bigint, tombstone boolean, value string"


def _parts(spark, path):
    late = [[("a", 5, False, "new"), ("b", 1, False, "b1")], [("a", 2, False, "old"), ("b", 3, True, "")], [("b", 2, False, "late"), ("c", 1, False, "c")]]
    for i, rows in enumerate(late):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{path}/in/p{i}")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def test_batches_in_any_order_give_the_batch_state(spark, tmp_path):
    stream = _parts(spark, tmp_path)
    live_state.maintain(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    log = spark.read.schema(KIND).parquet(str(tmp_path / "out"))
    assert {r["key"]: r["value"] for r in latest_state(log).collect()} == {"a": "new", "c": "c"}


def test_stateful_processor_keeps_tombstones(spark, tmp_path):
    q = live_state.changes(_parts(spark, tmp_path)).writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = {}
    for r in spark.table("changes").orderBy("seq").collect():
        last[r["key"]] = (r["seq"], r["tombstone"], r["value"])
    assert last["a"] == (5, False, "new") and last["b"][:2] == (3, True) and last["c"][0] == 1

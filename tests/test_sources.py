"""Binary log, store and command protocol."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.functions.scalars import encode_record
from siltstone.operators import validation
from siltstone.sources import backup, binary_log, command_protocol, folders
from siltstone.sources.store import Store

TEN = [binary_log.encode(i, False, f"k{i}".encode(), f"value-{i}".encode()) for i in range(10)]


def rows(data):
    return list(binary_log.records(1, data))


def test_checksum_and_codec_are_the_documented_ones(spark):
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert all(len(r) == 30 for r in TEN)
    odd = binary_log.encode(7, False, b"k\0e\0y", b"\0\xff\0\n\r")
    assert rows(odd)[0][3:7] == (7, False, b"k\0e\0y", b"\0\xff\0\n\r")
    df = spark.createDataFrame([(7, False, bytearray(b"k\0e\0y"), bytearray(b"\0\xff\0\n\r")), (2**40, True, bytearray(b"k"), bytearray(b""))], "s bigint, d boolean, k binary, v binary")
    made = [bytes(r[0]) for r in df.select(encode_record(F.col("s"), F.col("d"), F.col("k"), F.col("v"))).collect()]
    assert made == [odd, binary_log.encode(2**40, True, b"k", b"")]


def test_every_bit_flip_is_noticed():
    one = TEN[3]
    for i in range(len(one) * 8):
        bad = bytearray(one)
        bad[i // 8] ^= 1 << (i % 8)
        assert binary_log.decode(bytes(bad), 0)[0] != "ok"


def test_torn_tails_and_zeros():
    data = b"".join(TEN)
    for cut in range(1, 30):
        got = rows(data[:-cut])
        assert len(got) == 10 and got[-1][7] == "truncated" and got[-1][2] == 30 - cut
    got = rows(data + bytes(100))
    assert len(got) == 11 and got[-1][7] == "corrupt" and got[-1][2] == 100
    bad = bytearray(data)
    bad[5 * 30 + 22] ^= 1
    assert [r[7] for r in rows(bytes(bad))] == ["ok"] * 5 + ["corrupt"]


def test_source_reads_writes_and_uses_sound_indexes(spark, tmp_path):
    binary_log.register(spark)
    (tmp_path / "000000001.data").write_bytes(b"".join(TEN))
    (tmp_path / "notes.data").write_bytes(b"x")
    log = spark.read.format("checked_log").load(str(tmp_path))
    assert log.count() == 10
    same = binary_log.decode_frame(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted((r["seq"], bytes(r["key"])) for r in same.collect()) == sorted((r["seq"], bytes(r["key"])) for r in log.collect())
    index = b"".join(binary_log.encode_index(i, False, f"k{i}".encode(), 30, 30 * i) for i in range(10))
    (tmp_path / "000000001.hint").write_bytes(index)
    assert spark.read.format("checked_log").option("index", "true").load(str(tmp_path)).filter("value is null").count() == 10
    (tmp_path / "000000001.hint").write_bytes(index[:-1])
    assert spark.read.format("checked_log").option("index", "true").load(str(tmp_path)).filter("value is not null").count() == 10
    more = spark.createDataFrame([(10, False, bytearray(b"new"), bytearray(b"1")), (11, True, bytearray(b"k1"), None)], "seq bigint, tombstone boolean, key binary, value binary")
    more.write.format("checked_log").mode("append").save(str(tmp_path))
    assert spark.read.format("checked_log").load(str(tmp_path)).count() == 12
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]


def test_store_survives_interruption_and_never_reuses_numbers(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    put = lambda pairs: s.put(spark.createDataFrame([(bytearray(k.encode()), bytearray(v.encode()), i) for i, (k, v) in enumerate(pairs)], "key binary, value binary, ord bigint"))
    state = lambda: {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in s.state().collect()}
    put([("a", "1"), ("b", "2"), ("a", "3")])
    assert state() == {"a": "3", "b": "2"}
    keys = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"zz"),)], "key binary")
    assert s.delete(keys) == 1 and s.delete(keys) == 0
    high = s.manifest()["high"]
    s.compact()
    s.compact()
    assert state() == {"b": "2"} and s.log().count() == 1 and s.manifest()["high"] == high
    put([("a", "again")])
    assert state() == {"a": "again", "b": "2"}
    os.makedirs(tmp_path / "gen-99")  # what a crash between writing and publishing leaves
    assert Store(spark, str(tmp_path)).state().count() == 2 and (tmp_path / "gen-99").exists()
    s.vacuum()  # within the grace nothing goes, for readers of the manifest before
    assert (tmp_path / "gen-99").exists()
    Store(spark, str(tmp_path), grace=0).vacuum()
    assert sorted(p.name for p in tmp_path.glob("gen-*")) == sorted(s.manifest()["live"])
    (tmp_path / "LOCK").touch()
    with pytest.raises(RuntimeError):
        put([("c", "1")])
    (tmp_path / "LOCK").unlink()
    with pytest.raises(ValueError):
        put([("", "1")])
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), max_file_size=21)
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none"), must_exist=True)


def test_protocol_prefixes_are_incomplete_and_errors_named(spark):
    whole = b"*2\r\n$3\r\nGET\r\n$1\r\nk\r\n"
    for i in range(len(whole)):
        assert command_protocol.parse(whole[:i]) == ([], 0)
    assert command_protocol.parse(whole + b"PING  x\r\n" + whole[:5]) == ([[b"GET", b"k"], [b"PING", b"x"]], len(whole) + 9)
    for bad in (b"*0\r\n", b"*1\r\n+x\r\n", b"*1\r\n$-1\r\n", b"*1\r\n$1\r\nabc"):
        with pytest.raises(command_protocol.ProtocolError):
            command_protocol.parse(bad)
    assert command_protocol.reply([None, 1, b"x", ("ok", "OK"), ("error", "ERR no")]) == b"*5\r\n$-1\r\n:1\r\n$1\r\nx\r\n+OK\r\n-ERR no\r\n"
    mixed = b"PING\r\n*3\r\n$3\r\nSET\r\n$1\r\na\r\n$1\r\nb\r\n*x\r\nPING\r\n"
    df = spark.createDataFrame([("c", bytearray(whole * 2)), ("d", bytearray(b"*x\r\n")), ("e", bytearray(mixed))], "client string, data binary")
    got = command_protocol.parse_frame(df).orderBy("client", "pos").collect()
    assert [(r["client"], r["pos"], r["error"] is None) for r in got] == [("c", 0, True), ("c", 1, True), ("d", 0, False), ("e", 0, True), ("e", 1, True), ("e", 2, False)]
    assert [bytes(x) for x in got[4]["args"]] == [b"SET", b"a", b"b"]


def test_recovery_from_damaged_files(spark, tmp_path):
    binary_log.register(spark)
    log = lambda rows: b"".join(binary_log.encode(s, d, k.encode(), v.encode()) for s, d, k, v in rows)
    first = log([(1, False, "victim", "alive"), (2, False, "a", "1"), (9, False, "b", "late")])
    second = log([(3, True, "victim", ""), (4, False, "b", "old"), (5, False, "c", "cut")])
    (tmp_path / "000000001.data").write_bytes(first)
    (tmp_path / "000000002.data").write_bytes(second[:-1])
    (tmp_path / "000000003.data").write_bytes(log([(6, False, "z", "merged")]))
    (tmp_path / "000000004.data").write_bytes(b"")
    (tmp_path / "old.tmp").write_bytes(b"x")
    os.utime(tmp_path / "old.tmp", (1, 1))
    read = spark.read.format("checked_log").load(str(tmp_path))
    state, report = validation.recover(read, spark.createDataFrame([(3,)], "file_id bigint"))
    assert {bytes(r["key"]): bytes(r["value"]) for r in state.collect()} == {b"a": b"1", b"b": b"late"}
    assert tuple(report.first()) == (10, len(second) - 1 - 2 * 21 - 6 - 1 - 3, 0)
    files = spark.read.format("binaryFile").load(str(tmp_path)).filter("path like '%data'").select(F.regexp_extract("path", r"(\d{9})", 1).cast("bigint").alias("file_id"), "content")
    whole = {r["file_id"]: bytes(r["content"]) for r in validation.repaired(files, read).collect()}
    assert whole[1] == first and second.startswith(whole[2]) and len(whole[2]) == 21 + 6 + 21 + 1 + 3
    binary_log.remove_leftovers(str(tmp_path))
    assert not (tmp_path / "old.tmp").exists()


def test_restore_verifies_before_it_writes(spark, tmp_path):
    source, archive, target = (str(tmp_path / n) for n in ("src", "archive", "dst"))
    os.makedirs(source)
    for i in (1, 2):
        (tmp_path / "src" / f"{i:09d}.data").write_bytes(b"".join(TEN) * i)
    (tmp_path / "src" / "notes.txt").write_bytes(b"x")
    backup.backup(spark, source, archive)
    assert backup.restore(spark, archive, target) == 2
    assert sorted(os.listdir(target)) == ["000000001.data", "000000002.data"]
    assert (tmp_path / "dst" / "000000002.data").read_bytes() == b"".join(TEN) * 2
    with pytest.raises(RuntimeError, match="2 data files"):
        backup.restore(spark, archive, target)
    assert backup.restore(spark, archive, target, force=True) == 2
    (tmp_path / "dst" / "LOCK").touch()
    with pytest.raises(RuntimeError, match="lock"):
        backup.restore(spark, archive, target, force=True)
    files, bad = spark.read.parquet(f"{archive}/files"), str(tmp_path / "bad")
    files.withColumn("content", F.concat(F.substring("content", 1, 30), F.lit(b"!"), F.substring(F.col("content"), F.lit(32), F.octet_length("content")))).write.parquet(f"{bad}/files")
    spark.read.parquet(f"{archive}/manifest").write.parquet(f"{bad}/manifest")
    with pytest.raises(ValueError, match="checksum mismatch"):
        backup.restore(spark, bad, str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_shared_folders_need_a_setting_on_a_cluster(spark):
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError):
        folders.shared_dir(Session)
    assert folders.shared_dir(spark) != folders.shared_dir(spark)


def test_smoke(spark, tmp_path):
    """Writes, reads, deletes, compacts, and reopens, from end to end."""
    s = Store(spark, str(tmp_path / "s"), grace=0)
    rows = [(bytearray(f"k{i}".encode()), bytearray(f"v{i}".encode()), i) for i in range(300)]
    s.put(spark.createDataFrame(rows, "key binary, value binary, ord bigint"))
    assert s.delete(spark.createDataFrame([(bytearray(b"k7"),), (bytearray(b"none"),)], "key binary")) == 1
    s.compact()
    again = Store(spark, str(tmp_path / "s"), must_exist=True)
    state = {bytes(r["key"]): bytes(r["value"]) for r in again.state().collect()}
    assert len(state) == 299 and state[b"k123"] == b"v123" and b"k7" not in state
    assert again.manifest()["high"] == 301 and len(list((tmp_path / "s").glob("gen-*"))) == 1

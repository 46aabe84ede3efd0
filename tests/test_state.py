"""Newest-wins state, compaction and replay, against a dict model."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions.scalars import command_name, parse_integer
from siltstone.operators import execute, replay, state, statistics, validation

LOG = "key string, seq bigint, tombstone boolean, value string, file_id bigint, record_size bigint"


def model(ops):
    live = {}
    for key, _, dead, value, *_ in sorted(ops, key=lambda r: r[1]):
        if dead:
            live.pop(key, None)
        else:
            live[key] = value
    return live


@pytest.mark.parametrize("seed", [5, 71, 808])
def test_state_equals_a_map_in_any_order(spark, seed):
    rng = random.Random(seed)
    ops = [(f"k{rng.randrange(45)}", i, d := rng.random() < 0.35, "" if d else f"v{i}", i // 100, 30) for i in range(1, 800)]
    expected = model(ops)
    rng.shuffle(ops)
    log = spark.createDataFrame(ops, LOG).withColumn("offset", F.col("seq") * 30).repartition(7)
    assert {r["key"]: r["value"] for r in state.latest_state(log).collect()} == expected
    packed = state.compact(log)
    assert {r["key"]: r["value"] for r in state.latest_state(packed).collect()} == expected
    assert sorted(map(tuple, state.compact(packed).collect())) == sorted(map(tuple, packed.collect()))
    live, garbage = state.split_live(log)
    assert live.count() + garbage.count() == len(ops)


def test_deletes_do_not_resurrect_and_empty_values_live(spark):
    log = spark.createDataFrame([("a", 1, False, "x", 1, 1), ("a", 2, True, "", 1, 1), ("b", 3, False, "", 1, 1)], LOG)
    assert [(r["key"], r["value"]) for r in state.latest_state(log).collect()] == [("b", "")]
    assert state.next_seq(log).first()[0] == 4
    assert state.next_seq(log.limit(0)).first()[0] == 1
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string")
    assert state.count_existing(log, wanted).first()[0] == 2
    assert [r["key"] for r in state.effective_deletes(log, wanted).collect()] == ["b"]


def test_amplification_is_zero_for_a_dead_log(spark):
    log = spark.createDataFrame([("a", 1, False, "x", 1, 30), ("a", 2, True, "", 2, 29)], LOG)
    r = statistics.store_stats(log).first()
    assert (r["live_keys"], r["data_files"], r["disk_bytes"], r["live_bytes"], r["space_amplification"]) == (0, 2, 59, 0, 0.0)


def test_replay_of_mixed_commands(spark):
    top = str(2**63 - 1)
    ops = [("a", 1, "INCR", None), ("a", 2, "INCR", None), ("b", 1, "SET", "abc"), ("b", 2, "INCR", None), ("c", 1, "SET", top), ("c", 2, "INCR", None), ("c", 3, "DECR", None), ("d", 1, "SET", "1"), ("d", 2, "DEL", None), ("e", 1, "SET", "+5"), ("e", 2, "DECR", None), ("f", 5, "DECR", None), ("f", 4, "SET", "-3"), ("g", 1, "SET", "x"), ("g", 2, "INCR", None), ("g", 3, "SET", "7")]
    got = {r["key"]: (r["value"], r["errors"]) for r in replay.fold_commands(spark.createDataFrame(ops, "key string, seq bigint, op string, arg string")).collect()}
    assert got == {"a": ("2", 0), "b": ("abc", 1), "c": (str(2**63 - 2), 1), "d": (None, 0), "e": ("+5", 1), "f": ("-4", 0), "g": ("7", 1)}


def test_rotation_is_greedy(spark):
    rows = [("g", i, s) for i, s in enumerate([40, 40, 40, 200, 10, 90, 1])]
    got = replay.rotate(spark.createDataFrame(rows, "grp string, seq bigint, size bigint"), 100).orderBy("seq").collect()
    assert [(r["file_no"], r["offset"]) for r in got] == [(0, 0), (0, 40), (1, 0), (2, 0), (3, 0), (3, 10), (4, 0)]


def test_valid_prefix_and_torn_bytes(spark):
    rows = [(1, 0, 10, "ok"), (1, 10, 10, "corrupt"), (1, 20, 10, "ok"), (2, 0, 10, "ok"), (3, 0, 7, "truncated")]
    df = spark.createDataFrame(rows, "file_id bigint, offset bigint, record_size bigint, outcome string")
    assert sorted((r["file_id"], r["offset"]) for r in validation.valid_prefix(df).collect()) == [(1, 0), (2, 0)]
    assert sorted(map(tuple, validation.torn(df).collect())) == [(1, 20, 1), (2, 0, 0), (3, 7, 0)]


def test_integers_and_names(spark):
    df = spark.createDataFrame([("12",), ("-0",), ("+1",), (" 1",), ("1.0",), ("9223372036854775808",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_integer(F.col("t"))).collect()] == [12, 0, None, None, None, None, None]
    names = spark.createDataFrame([("GeT",), ("flushall",), (None,)], "t string")
    assert [r[0] for r in names.select(command_name(F.col("t"))).collect()] == ["get", "unknown", "unknown"]


def test_four_quantiles_disagree_as_defined(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert statistics.bench_percentile(df, "v", 99) == 100
    assert statistics.load_percentile(df, "v", 99) == 99
    b = spark.createDataFrame([(0.001, 90), (0.01, 99), (0.1, 100), (float("inf"), 100)], "le double, n bigint")
    assert statistics.bucket_quantile(b, 0.5).first()[0] == 0.001
    assert statistics.bucket_quantile(b, 0.99).first()[0] == 0.01
    assert abs(statistics.interpolated_quantile(b, 0.5).first()[0] - 0.001 * 50 / 90) < 1e-12
    assert statistics.bench_percentile(df.limit(0), "v", 99) == 0.0


def test_rotation_and_running_sums_equal_a_loop(spark):
    rng = random.Random(9)
    rows = [(f"g{i % 3}", i, rng.choice([0, 1, 7, 30, 99, 100, 101, 250])) for i in range(2_000)]
    expected, state_of, total = {}, {}, 0
    for g, i, size in rows:
        f, used = state_of.get(g, (0, 0))
        if used and used + size > 100:
            f, used = f + 1, 0
        expected[i], state_of[g] = (f, used), (f, used + size)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "grp string, seq bigint, size bigint")
    assert {r["seq"]: (r["file_no"], r["offset"]) for r in replay.rotate(df, 100).collect()} == expected
    got = {r["seq"]: r["running"] for r in replay.running_sum(df, "seq", "size", width=7).collect()}
    for _, i, size in rows:
        total += size
        assert got[i] == total
    far = spark.createDataFrame([(0, 1), (5, 2), (1 << 40, 4)], "p bigint, v int")
    assert sorted((r["p"], r["running"]) for r in replay.running_sum(far, "p", "v", width=4).collect()) == [(0, 1), (5, 3), (1 << 40, 7)]


def test_order_statistics_end_on_any_values(spark):
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_007).cast("double").alias("v"))
    values = sorted(i * 7919 % 300_007 for i in range(300_000))
    assert statistics.order_statistics(df, "v", [0, 123_456, 299_999, 300_000]) == [values[0], values[123_456], values[-1], None]
    inf = float("inf")
    odd = df.select(F.when(F.col("v") % 5 == 0, inf).when(F.col("v") % 5 == 1, -inf).when(F.col("v") % 5 == 2, 1e300).otherwise(F.col("v")).alias("v"))
    flat = sorted(inf if x % 5 == 0 else -inf if x % 5 == 1 else 1e300 if x % 5 == 2 else x for x in values)
    ranks = [0, 59_000, 61_000, 100_000, 200_000, 299_999]
    assert statistics.order_statistics(odd, "v", ranks) == [flat[r] for r in ranks]
    same = spark.range(250_000).select(F.lit(3.0).alias("v"))
    assert statistics.order_statistic(same, "v", 77) == 3.0


def test_alerts_fire_after_an_unbroken_time(spark):
    def fired(series, condition, minutes, step):
        rows = [(i, 60 * step * m, float(v)) for i, values in series.items() for m, v in enumerate(values) if v is not None]
        df = spark.createDataFrame(rows, "i string, t bigint, v double").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
        return sorted((r["i"], r["fired_at"].hour * 60 + r["fired_at"].minute) for r in statistics.firing(df, ["i"], condition, minutes, 60 * step).collect())

    assert fired({"a": [1, 1, 0, 0, 0, 1, 0, 0]}, F.col("v") == 0, 2, 1) == [("a", 4)]
    assert fired({"a": [1, 1, 0, 0, 0]}, F.col("v") == 0, 1, 1) == [("a", 3)]
    assert fired({"a": [1, *[5] * 8]}, F.col("v") > 3, 30, 5) == [("a", 35)]
    assert fired({"a": [0, None, None, 0, 0], "b": [0, 0, 0, 0, 0]}, F.col("v") == 0, 2, 1) == [("b", 2)]
    assert fired({"a": [0, 7, 0, 8]}, F.col("v") > 0, 0, 1) == [("a", 1), ("a", 3)]


def test_numbers_are_written_as_c_does(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, -2.5, 1e10, 9999999999.5, 1e-4, 9.9999999999e-5, 2.5e-05, 1e-300, 1e300, 123456.7890123, float("inf"), *(rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(200))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", statistics.number_text(F.col("v")).alias("t"))
    got = [r["t"] for r in df.orderBy("i").collect()]
    assert got == ["0" if v == 0 else "%.10g" % v for v in values]


def test_counts_keep_microseconds_and_deletes_of_absent_keys_write_nothing(spark):
    c = spark.createDataFrame([("GET", 0.000004, False), ("get", 0.0000025, True), ("zap", 1.5, False)], "name string, seconds double, error boolean")
    got = {r["command"]: (r["n"], r["errors"], r["seconds"]) for r in statistics.command_counts(c).collect()}
    assert got["get"][:2] == (2, 1) and abs(got["get"][2] - 0.000006) < 1.1e-6 and got["unknown"] == (1, 0, 1.5)
    rows = [("a", 1, True), ("a", 2, False), ("a", 9, True), ("a", 10, True), ("b", 3, False), ("b", 4, False), ("c", 5, True)]
    log = spark.createDataFrame([(k, s, d, "", 1, 1) for k, s, d in rows], LOG)
    for width in (1, 3, 1000):
        assert statistics.effective_writes(log, width).first()["writes"] == 4


def test_replies_of_a_command_log(spark):
    sent = [["SET", "k", "v"], ["get", "k"], ["EXISTS", "k", "nope", "k"], ["DEL", "k", "nope", "k"], ["GET", "k"], ["INCR", "c"], ["INCR", "c"], ["DECR", "c"], ["SET", "s", "abc"], ["INCR", "s"], ["PING"], ["PING", "hé"], ["PING", "a", "b"], ["GET"], ["NOSUCH", "x"], ["DBSIZE"], ["COMPACT"], ["SET", "a"], ["SET", "a", "b", "c"], [], ["SET", "", "x"], ["SET", "m", str(2**63 - 1)], ["INCR", "m"], ["ECHO", "x"], ["CONFIG", "GET", "x"], ["INFO"], ["QUIT"]]
    df = spark.createDataFrame(list(enumerate(sent)), "pos bigint, args array<string>")
    got = {r["pos"]: r["reply"] for r in execute.execute(df, F.lit("i")).collect()}
    expected = ["+OK", "$1\r\nv", ":2", ":1", "$-1", ":1", ":2", ":1", "+OK", "-ERR value is not an integer or out of range", "+PONG", "$3\r\nhé", "-ERR wrong number of arguments for 'ping' command", "-ERR wrong number of arguments for 'get' command", "-ERR unknown command 'NOSUCH'", ":2", "+OK", "-ERR wrong number of arguments for 'set' command", "-ERR syntax error", None, "-ERR key or value size out of range", "+OK", "-ERR increment or decrement would overflow", "$1\r\nx", "*0", "$1\r\ni", "+OK"]
    assert got == {i: t + "\r\n" for i, t in enumerate(expected) if t is not None}


def test_diagnosis_needs_enough_traffic(spark):
    kind = "reachable boolean, ping_ms double, space_amplification double, torn_bytes bigint, errors bigint, total bigint, p99_seconds double"
    found = lambda *row: {r["finding"] for r in statistics.diagnose(spark.createDataFrame([row], kind)).collect()}
    assert found(True, 1.0, 6.0, 0, 50, 1000, 0.001) == {"space amplification", "error ratio"}
    assert found(True, 1.0, 1.0, 0, 5, 100, 0.001) == set()
    assert found(False, 99.0, 1.0, 1, 0, 0, 0.5) == {"unreachable", "slow ping", "torn tail recovered", "slow requests"}


def test_manifest_statuses(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("x/y", "4")], "name string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "5")], "name string, sha256 string")
    got = {r["name"]: r["status"] for r in validation.verify_manifest(m, f).collect()}
    assert got == {"a": "ok", "b": "checksum mismatch", "c": "missing", "x/y": "path with directory", "d": "extra"}

"""Registered queries of the change-log operators and their SQL.

The test tables are read as logs: `events` keyed by user_id with seq event_id, deleted by type
`error`; `orders` keyed by o_custkey with seq o_orderkey, deleted by status F; `conversations` keyed by
conv_id with seq turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scalars import command_name, encode_record, parse_integer, record_size, sizes_valid
from siltstone.operators import execute, replay, state, statistics, validation
from siltstone.sources import binary_log
from siltstone.sources.folders import shared_dir
from siltstone.streaming import live_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = (3, 5, 5, 7, 11, 10_000_019)
TYPES = ("signup", "error", "click", "view", "purchase")
INTEGERS = ("0", "-5", "+5", " 5", "5 ", "5.0", "", "-", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "007", "1e3", "abc")
BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def events_log(spark: SparkSession, d: str) -> DataFrame:
    """key, seq, tombstone, value, file_id, offset, record_size of the events."""
    e = events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("tombstone"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("value"))
    return e.withColumns({"file_id": (F.col("seq") / 1000).cast("bigint"), "offset": F.col("seq") % 1000 * 64, "record_size": record_size(F.col("key").cast("string"), F.col("value"))})


LOG = """log AS (SELECT user_id AS key, event_id AS seq, event_type = 'error' AS tombstone, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS value,
  event_id // 1000 AS file_id, event_id % 1000 * 64 AS "offset", (21 + strlen(user_id::VARCHAR) + CASE WHEN event_type = 'error' THEN 0 ELSE strlen(event_type) END)::BIGINT AS record_size FROM events),
newest AS (SELECT key, max(seq) AS seq FROM log GROUP BY key),
state AS (SELECT log.* FROM log JOIN newest USING (key, seq) WHERE NOT tombstone)"""


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def listed(rows: tuple, name: str) -> str:
    return f"(VALUES {', '.join(f'({x!r})' for x in rows)}) AS t({name})"


@query(f"WITH {LOG} SELECT key, seq, value, file_id, \"offset\", record_size FROM state")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_state(events_log(spark, d)).select("key", "seq", "value", "file_id", "offset", "record_size")


@query(f"WITH {LOG} SELECT count(*) AS live_keys FROM state")
def live_count(spark: SparkSession, d: str) -> DataFrame:
    return state.live_count(events_log(spark, d))


@query("""SELECT o_custkey AS key, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority
FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'""")
def latest_state_orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    log = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("tombstone"), "o_totalprice", "o_orderpriority")
    return state.latest_state(log)


@query("SELECT conv_id AS key, max(turn) AS seq, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def latest_turn(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.lit(False).alias("tombstone"), "role", "text")
    return state.latest_state(c)


@query("SELECT coalesce(max(event_id), 0) + 1 AS next_seq FROM events")
def next_sequence(spark: SparkSession, d: str) -> DataFrame:
    return state.next_seq(events_log(spark, d))


@query(f"WITH {LOG} SELECT key, seq, value FROM state WHERE key = 7")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return state.point_get(events_log(spark, d), F.lit(7)).select("key", "seq", "value")


@query(f"WITH {LOG} SELECT count(*) AS n_existing FROM state JOIN {listed(KEYS, 'key')} USING (key)")
def multi_exists(spark: SparkSession, d: str) -> DataFrame:
    return state.count_existing(events_log(spark, d), values(spark, [(k,) for k in KEYS], "key bigint"))


@query(f"WITH {LOG} SELECT DISTINCT key::BIGINT AS key FROM {listed(KEYS, 'key')} WHERE key IN (SELECT key FROM state)")
def effective_deletes(spark: SparkSession, d: str) -> DataFrame:
    return state.effective_deletes(events_log(spark, d), values(spark, [(k,) for k in KEYS], "key bigint"))


@query(f"WITH {LOG} SELECT key, seq, tombstone, record_size, \"offset\" FROM log")
def hint_projection(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark, d).select("key", "seq", "tombstone", "record_size", "offset")


@query(f"WITH {LOG} SELECT log.seq IN (SELECT seq FROM state) AS live, count(*) AS records, sum(record_size)::BIGINT AS bytes FROM log GROUP BY 1")
def live_vs_garbage(spark: SparkSession, d: str) -> DataFrame:
    return state.marked_live(events_log(spark, d)).groupBy("live").agg(F.count("*").alias("records"), F.sum("record_size").alias("bytes"))


@query(f"WITH {LOG} SELECT key, seq, value FROM state")
def compaction_output(spark: SparkSession, d: str) -> DataFrame:
    return state.compact(events_log(spark, d)).select("key", "seq", "value")


@query(f"""WITH {LOG}, half AS (SELECT max(seq) // 2 AS h FROM log),
old AS (SELECT key, max(seq) AS seq FROM log, half WHERE seq <= h GROUP BY key),
moved AS (SELECT key, seq // 1000 AS file_id, seq % 1000 * 64 AS "offset", 1000000 + seq // 1000 AS nf, seq % 1000 * 32 AS no FROM old)
SELECT key, coalesce(nf, file_id) AS file_id, coalesce(no, "offset") AS "offset", nf IS NOT NULL AS moved FROM state LEFT JOIN moved USING (key, file_id, "offset")""")
def cas_repoint(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    old = state.newest(log.filter(F.col("seq") <= half))
    moved = old.select("key", F.col("file_id").alias("old_file"), F.col("offset").alias("old_offset"), (F.col("file_id") + 1_000_000).alias("new_file"), (F.col("offset") / 2).cast("bigint").alias("new_offset"))
    return state.repoint(state.latest_state(log).select("key", "file_id", "offset"), moved)


STATS = f"""{LOG}, stats AS (SELECT (SELECT count(*) FROM state) AS live_keys, count(DISTINCT file_id) AS data_files, sum(record_size)::BIGINT AS disk_bytes,
  (SELECT coalesce(sum(record_size), 0) FROM state)::BIGINT AS live_bytes FROM log)"""


@query(f"WITH {STATS} SELECT *, CASE WHEN live_bytes = 0 THEN 0.0::DOUBLE ELSE disk_bytes::DOUBLE / live_bytes END AS space_amplification FROM stats")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.store_stats(events_log(spark, d))


WRITES = """found AS (SELECT *, lag(tombstone) OVER (PARTITION BY key ORDER BY seq) AS before FROM log),
writes AS (SELECT count(*) AS writes FROM found WHERE NOT tombstone OR NOT before)"""


@query(f"WITH {LOG}, {WRITES} SELECT writes FROM writes")
def write_effects(spark: SparkSession, d: str) -> DataFrame:
    return statistics.effective_writes(events_log(spark, d), 100)


def whole_stats(spark: SparkSession, d: str) -> DataFrame:
    """The eight statistics of the events' log, as if every write was forced; the damage is that of
    outcomes()."""
    torn = validation.torn(outcomes(spark, d)).agg(F.sum("torn_bytes").alias("recovered_torn_bytes"))
    log = events_log(spark, d)
    parts = statistics.store_stats(log).unionByName(statistics.effective_writes(log, 100), allowMissingColumns=True).unionByName(torn, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns]).withColumn("fsyncs", F.col("writes"))  # three rows


OUTCOMES = """rec AS (SELECT event_id // 1000 AS file_id, event_id % 1000 * 64 AS "offset", 64 AS record_size,
  CASE WHEN event_id % 1709 = 1708 THEN 'corrupt' WHEN event_id % 2311 = 2310 THEN 'truncated' ELSE 'ok' END AS outcome FROM events),
bad AS (SELECT file_id, max("offset" + record_size) AS e, min("offset") FILTER (outcome <> 'ok') AS bad, arg_min(outcome, "offset") FILTER (outcome <> 'ok') AS o FROM rec GROUP BY 1)"""
EIGHT = f"""{STATS}, {WRITES}, {OUTCOMES}, eight AS (SELECT stats.*, disk_bytes::DOUBLE / live_bytes AS amplification, writes,
  (SELECT coalesce(sum(e - bad), 0)::BIGINT FROM bad) AS torn FROM stats, writes)"""


@query(f"""WITH {EIGHT} SELECT '# store' || n || 'live_keys:' || live_keys || n || 'data_files:' || data_files || n || 'disk_bytes:' || disk_bytes || n || 'live_bytes:' || live_bytes || n
|| 'space_amplification:' || printf('%.6f', amplification) || n || 'fsyncs:' || writes || n || 'writes:' || writes || n || 'recovered_torn_bytes:' || torn || n AS info FROM eight, (SELECT chr(13) || chr(10) AS n)""")
def store_info(spark: SparkSession, d: str) -> DataFrame:
    return statistics.info_text(whole_stats(spark, d))


OPS = "ops AS (SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'DECR' WHEN 'error' THEN 'DEL' ELSE 'INCR' END AS op FROM events)"


def counter_ops(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "DECR").when(F.col("event_type") == "error", "DEL").otherwise("INCR")
    return events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"))


@query(f"""WITH {OPS}, r AS (SELECT key, max(seq) FILTER (op = 'DEL') AS r FROM ops GROUP BY key)
SELECT key, sum(CASE WHEN r IS NOT NULL AND seq <= r THEN 0 WHEN op = 'INCR' THEN 1 WHEN op = 'DECR' THEN -1 ELSE 0 END)::BIGINT AS counter,
       bool_or((r IS NULL OR seq > r) AND op <> 'DEL') AS "exists" FROM ops JOIN r USING (key) GROUP BY key""")
def counter_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.counter_replay(counter_ops(spark, d))


@query(f"""WITH {OPS}, r AS (SELECT key, max(seq) FILTER (op = 'DEL') AS r FROM ops GROUP BY key)
SELECT key, CASE WHEN count(*) FILTER (r IS NULL OR seq > r) > 0 THEN (count(*) FILTER (op = 'INCR' AND (r IS NULL OR seq > r)) - count(*) FILTER (op = 'DECR' AND (r IS NULL OR seq > r)))::VARCHAR END AS value,
       0::BIGINT AS errors FROM ops JOIN r USING (key) GROUP BY key""")
def command_fold(spark: SparkSession, d: str) -> DataFrame:
    return replay.fold_commands(counter_ops(spark, d).withColumn("arg", F.lit(None).cast("string")))


MIXED = """ops AS (SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'SET' WHEN 'purchase' THEN 'DECR' WHEN 'error' THEN 'DEL' ELSE 'INCR' END AS op,
  CASE WHEN event_id % 7 = 0 THEN 'abc' ELSE (event_id % 100)::VARCHAR END AS arg FROM events),
w AS (SELECT *, count(*) FILTER (op IN ('SET', 'DEL')) OVER (PARTITION BY key ORDER BY seq) AS seg FROM ops),
seg AS (SELECT key, seg, max(arg) FILTER (op = 'SET') AS base, count(*) FILTER (op IN ('INCR', 'DECR')) AS n, (count(*) FILTER (op = 'INCR') - count(*) FILTER (op = 'DECR')) AS sum FROM w GROUP BY 1, 2)"""


@query(f"""WITH {MIXED} SELECT key, arg_max(CASE WHEN n = 0 OR base = 'abc' THEN base ELSE (coalesce(base::BIGINT, 0) + sum)::VARCHAR END, seg) AS value,
sum(CASE WHEN base = 'abc' THEN n ELSE 0 END)::BIGINT AS errors FROM (SELECT * FROM seg) GROUP BY key""".replace("arg_max(", "arg_max_null("))
def command_fold_mixed(spark: SparkSession, d: str) -> DataFrame:
    """SET, DEL, INCR and DECR of each user in order; values that are no numbers make errors."""
    t, i = F.col("event_type"), F.col("event_id")
    op = F.when(t == "signup", "SET").when(t == "purchase", "DECR").when(t == "error", "DEL").otherwise("INCR")
    arg = F.when(i % 7 == 0, "abc").otherwise((i % 100).cast("string"))
    return replay.fold_commands(events(spark, d).select(F.col("user_id").alias("key"), i.alias("seq"), op.alias("op"), arg.alias("arg")))


@query(f"SELECT text, CASE WHEN regexp_full_match(text, '-?[0-9]+') THEN try_cast(text AS BIGINT) END::VARCHAR AS number FROM {listed(INTEGERS, 'text')}")
def parse_integer_guard(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, [(t,) for t in INTEGERS], "text string").select("text", parse_integer(F.col("text")).cast("string").alias("number"))


@query("SELECT count(*) FILTER (strlen(text) BETWEEN 1 AND 65536 AND strlen(source) <= 268435456) AS n_texts_as_keys, count(*) FILTER (strlen(source) BETWEEN 1 AND 65536 AND strlen(text) <= 268435456) AS n_texts_as_values, count(*) AS n FROM documents")
def key_validation(spark: SparkSession, d: str) -> DataFrame:
    t, text, source = spark.read.parquet(f"{d}/documents.parquet"), F.col("text"), F.col("source")
    return t.agg(F.count_if(sizes_valid(text, source)).alias("n_texts_as_keys"), F.count_if(sizes_valid(source, text)).alias("n_texts_as_values"), F.count("*").alias("n"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, d).select(
        (e / 1000).cast("bigint").alias("file_id"), (e % 1000 * 64).alias("offset"), F.lit(64).alias("record_size"),
        F.when(e % 1709 == 1708, "corrupt").when(e % 2311 == 2310, "truncated").otherwise("ok").alias("outcome"),
    )


@query(f"""WITH {OUTCOMES}, p AS (SELECT file_id, "offset", max(outcome <> 'ok') OVER (PARTITION BY file_id ORDER BY "offset") AS bad FROM rec)
SELECT file_id, count(*) AS records, max("offset")::BIGINT AS last_offset FROM p WHERE NOT bad GROUP BY 1""")
def valid_prefix(spark: SparkSession, d: str) -> DataFrame:
    return validation.valid_prefix(outcomes(spark, d)).groupBy("file_id").agg(F.count("*").alias("records"), F.max("offset").alias("last_offset"))


@query(f"""WITH {OUTCOMES} SELECT file_id, coalesce(e - bad, 0)::BIGINT AS torn_bytes, coalesce((o = 'corrupt')::BIGINT, 0) AS corrupt FROM bad""")
def torn_bytes(spark: SparkSession, d: str) -> DataFrame:
    return validation.torn(outcomes(spark, d))


@query("""WITH e AS (SELECT event_id // 1000 AS file_id, min(event_id % 1013 <> 1012) AS ok FROM events GROUP BY 1)
SELECT file_id, CASE WHEN ok THEN 'index' ELSE 'scan' END AS source FROM e""")
def index_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    entries = events(spark, d).select((e / 1000).cast("bigint").alias("file_id"), (e % 1000 * 64).alias("offset"), F.lit(64).alias("record_size"), (e % 1013 != 1012).alias("entry_ok"))
    return validation.usable_index(entries, entries.groupBy("file_id").agg(F.lit(64_000).alias("file_size")))


@query("SELECT event_id // 1000 AS file_id, count(*) AS file_size FROM events WHERE (event_id // 1000) % 3 <> 1 GROUP BY 1")
def interrupted_compaction(spark: SparkSession, d: str) -> DataFrame:
    files = events(spark, d).groupBy((F.col("event_id") / 1000).cast("bigint").alias("file_id")).agg(F.count("*").alias("file_size"))
    return validation.surviving_files(files, files.filter("file_id % 3 = 1").select("file_id"))


@query(f"""WITH RECURSIVE {LOG}, s AS (SELECT key, seq, record_size AS size, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM log),
f(key, seq, size, i, file_no, "offset") AS (
  SELECT key, seq, size, i, 0::BIGINT, 0::BIGINT FROM s WHERE i = 1
  UNION ALL SELECT s.key, s.seq, s.size, s.i, CASE WHEN f."offset" + f.size + s.size > 256 THEN f.file_no + 1 ELSE f.file_no END,
    CASE WHEN f."offset" + f.size + s.size > 256 THEN 0 ELSE f."offset" + f.size END FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1)
SELECT key, seq, size, file_no, "offset" FROM f""")
def file_rotation(spark: SparkSession, d: str) -> DataFrame:
    return replay.rotate(events_log(spark, d).select("key", "seq", F.col("record_size").alias("size")), 256, "key")


@query("SELECT doc_id::VARCHAR || '.txt' AS name, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def checksum_manifest(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.octet_length("text").cast("bigint").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("""SELECT CASE WHEN doc_id % 7 = 6 THEN 'extra' WHEN doc_id % 7 = 5 THEN 'missing' WHEN doc_id % 7 = 4 THEN 'checksum mismatch' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1""")
def manifest_verification(spark: SparkSession, d: str) -> DataFrame:
    m, i = checksum_manifest(spark, d), F.regexp_extract("name", r"^(\d+)", 1).cast("bigint") % 7
    files = m.filter(i != 5).withColumn("sha256", F.when(i == 4, "0").otherwise(F.col("sha256")))
    return validation.verify_manifest(m.filter(i != 6), files).groupBy("status").agg(F.count("*").alias("n"))


COMMANDS = "cmd AS (SELECT CASE event_type WHEN 'signup' THEN 'SET' WHEN 'view' THEN 'get' WHEN 'click' THEN 'Incr' WHEN 'purchase' THEN 'flush' ELSE 'del' END AS name, value AS seconds, event_type = 'error' AS error, ts FROM events)"


def commands(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    name = F.when(t == "signup", "SET").when(t == "view", "get").when(t == "click", "Incr").when(t == "purchase", "flush").otherwise("del")
    return events(spark, d).select(name.alias("name"), F.col("value").alias("seconds"), (t == "error").alias("error"), "ts")


COUNTS = f"""{COMMANDS}, k AS (SELECT CASE WHEN lower(name) IN ('set', 'get', 'incr', 'del') THEN lower(name) ELSE 'unknown' END AS command, count(*) AS n,
count(*) FILTER (error) AS errors, sum(round(seconds * 1e6)::BIGINT)::DOUBLE / 1e6 AS seconds FROM cmd GROUP BY 1)"""


@query(f"WITH {COUNTS} SELECT * FROM k")
def command_counts(spark: SparkSession, d: str) -> DataFrame:
    return statistics.command_counts(commands(spark, d))


LE = f"(VALUES {', '.join(f'({b}::DOUBLE)' for b in BOUNDS)}, ('inf'::DOUBLE)) AS b(le)"
BUCKETS = f"{COMMANDS}, buckets AS (SELECT le, (SELECT count(*) FROM cmd WHERE seconds <= le OR le = 'inf'::DOUBLE) AS n FROM {LE})"


@query(f"WITH {BUCKETS} SELECT le, n FROM buckets")
def latency_buckets(spark: SparkSession, d: str) -> DataFrame:
    return statistics.latency_buckets(commands(spark, d), BOUNDS)


@query(f"WITH {BUCKETS} SELECT min(le) AS value FROM buckets WHERE n >= 0.5 * (SELECT max(n) FROM buckets)")
def quantile_bucket(spark: SparkSession, d: str) -> DataFrame:
    return statistics.bucket_quantile(statistics.latency_buckets(commands(spark, d), BOUNDS), 0.5)


@query(f"""WITH {BUCKETS}, w AS (SELECT le, n, coalesce(lag(n) OVER (ORDER BY le), 0) AS n0, coalesce(lag(le) OVER (ORDER BY le), 0) AS le0, 0.5::DOUBLE * max(n) OVER () AS r FROM buckets)
SELECT arg_min(CASE WHEN le = 'inf'::DOUBLE THEN le0 ELSE le0 + (le - le0) * (r - n0) / (n - n0) END, le) AS value FROM w WHERE n >= r AND n > n0""")
def quantile_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return statistics.interpolated_quantile(statistics.latency_buckets(commands(spark, d), BOUNDS), 0.5)


RANKED = "r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)"
PERCENTS = (50.0, 90.0, 99.0)


@query(f"WITH {RANKED} SELECT p, value FROM r, {listed(PERCENTS, 'p0')}, LATERAL (SELECT p0::DOUBLE AS p) WHERE i = least(n - 1, floor(p / 100 * n))")
def quantile_bench(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, list(zip(PERCENTS, statistics.bench_percentiles(events(spark, d), "value", PERCENTS), strict=True)), "p double, value double")


@query(f"WITH {RANKED} SELECT p, value FROM r, {listed(PERCENTS, 'p0')}, LATERAL (SELECT p0::DOUBLE AS p) WHERE i = floor(p / 100 * (n - 1))")
def quantile_load(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, list(zip(PERCENTS, statistics.load_percentiles(events(spark, d), "value", PERCENTS), strict=True)), "p double, value double")


@query("SELECT count(*) AS ops, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS seconds, count(*)::DOUBLE / (epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT) AS ops_per_second FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    return statistics.throughput(commands(spark, d), F.col("ts").cast("timestamp"))


@query("""SELECT event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS connected FROM events""")
def connected_gauge(spark: SparkSession, d: str) -> DataFrame:
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = events(spark, d).select("event_id", step.alias("step"))
    return replay.running_sum(rows, "event_id", "step").select("event_id", F.col("running").alias("connected"))


HOURLY = "h AS (SELECT date_trunc('hour', ts) AS ts, count(*) FILTER (event_type = 'error') AS errors, count(*) AS total FROM events GROUP BY 1)"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("total"))


@query(f"WITH {HOURLY} SELECT ts, errors, total, errors::DOUBLE / total AS ratio FROM h")
def error_ratio_by_window(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("ts", "errors", "total", F.try_divide(F.col("errors").cast("double"), F.col("total")).alias("ratio"))


@query(f"""WITH {HOURLY}, c AS (SELECT 'all' AS instance, ts, errors::DOUBLE / total > 0.15 AS c FROM h WHERE (epoch(ts)::BIGINT // 3600) % 11 <> 5),
g AS (SELECT *, ts > lag(ts) OVER (ORDER BY ts) + INTERVAL 1 HOUR AS gap FROM c),
r AS (SELECT *, sum(CASE WHEN c AND NOT coalesce(gap, FALSE) THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS run FROM g),
f AS (SELECT instance, run, ts, min(ts) OVER (PARTITION BY run) AS s FROM r WHERE c)
SELECT instance, min(ts) AS fired_at FROM f WHERE ts >= s + INTERVAL 120 MINUTE GROUP BY instance, run""")
def alert_for_duration(spark: SparkSession, d: str) -> DataFrame:
    """Hourly samples, every 11th of which is missing, which breaks a run."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    samples = hourly(spark, d).withColumn("instance", F.lit("all")).filter(hour % 11 != 5)
    return statistics.firing(samples, ["instance"], F.col("errors").cast("double") / F.col("total") > 0.15, 120, 3600)


BY_HOUR = """h AS (SELECT user_id % 5 AS i, date_trunc('hour', ts) AS ts, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)"""
RUNS = """g AS (SELECT *, ts > lag(ts) OVER (PARTITION BY i ORDER BY ts) + INTERVAL 1 HOUR AS gap FROM c),
r AS (SELECT *, sum(CASE WHEN c AND NOT coalesce(gap, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY i ORDER BY ts) AS run FROM g),
f AS (SELECT i, run, ts, min(ts) OVER (PARTITION BY i, run) AS s FROM r WHERE c)"""


def by_hour(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return events(spark, d).groupBy((F.col("user_id") % 5).alias("i"), hour.alias("ts")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {BY_HOUR}, c AS (SELECT i, ts, CASE WHEN n % 4 = 1 THEN 0 ELSE 1 END = 0 AS c FROM h), {RUNS}
SELECT i, min(ts) AS fired_at FROM f WHERE ts >= s + INTERVAL 60 MINUTE GROUP BY i, run""")
def down_alert(spark: SparkSession, d: str) -> DataFrame:
    """up == 0 for an hour; an instance counts as down in hours of 1, 5, 9 ... events."""
    samples = by_hour(spark, d).withColumn("up", F.when(F.col("n") % 4 == 1, 0).otherwise(1))
    return statistics.firing(samples, ["i"], F.col("up") == 0, 60, 3600)


@query(f"""WITH {BY_HOUR}, c AS (SELECT i, ts, n::DOUBLE / users > 1.05 AS c FROM h), {RUNS}
SELECT i, min(ts) AS fired_at FROM f WHERE ts >= s + INTERVAL 60 MINUTE GROUP BY i, run""")
def amplification_alert(spark: SparkSession, d: str) -> DataFrame:
    """A ratio above its limit for an hour: writes for each key."""
    samples = by_hour(spark, d).withColumn("amplification", F.col("n").cast("double") / F.col("users"))
    return statistics.firing(samples, ["i"], F.col("amplification") > 1.05, 60, 3600)


@query(f"""WITH {OUTCOMES} SELECT file_id::VARCHAR AS instance, TIMESTAMP '2026-01-01' AS fired_at FROM bad WHERE e - bad > 0""")
def torn_alert(spark: SparkSession, d: str) -> DataFrame:
    """An alert without a duration: torn bytes above 0."""
    samples = validation.torn(outcomes(spark, d)).select(F.col("file_id").cast("string").alias("instance"), F.lit("2026-01-01").cast("timestamp_ntz").alias("ts"), "torn_bytes")
    return statistics.firing(samples, ["instance"], F.col("torn_bytes") > 0, 0, 15)


@query("""SELECT event_type, to_timestamp(epoch(ts)::BIGINT // 15 * 15)::TIMESTAMP AS ts, arg_max(value, (ts, event_id)) AS value FROM (SELECT event_id, event_type, ts, value, epoch_us(ts) // 1000000 AS e FROM events)
GROUP BY event_type, e // 15, 2""".replace("to_timestamp(epoch(ts)::BIGINT // 15 * 15)::TIMESTAMP", "make_timestamp((e // 15 * 15) * 1000000)"))
def scrape_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_type", "ts", "value", "event_id")
    last = rows.groupBy("event_type", "ts").agg(F.max_by("value", "event_id").alias("value"))  # one sample a moment
    return statistics.on_grid(last, ["event_type"], 15)


BY_INSTANCE = f"""c AS (SELECT (user_id % 3)::VARCHAR AS instance, le, date_trunc('minute', ts) AS ts, count(*) FILTER (value <= le) AS k FROM events, (VALUES {', '.join(f'({b}::DOUBLE)' for b in BOUNDS)}, ('inf'::DOUBLE)) AS b(le) GROUP BY 1, 2, 3),
s AS (SELECT instance, le, ts, sum(k) OVER (PARTITION BY instance, le ORDER BY ts)::DOUBLE AS value FROM c),
p AS (SELECT *, date_trunc('day', ts) AS "window", lag(value) OVER (PARTITION BY instance, le, date_trunc('day', ts) ORDER BY ts) AS q FROM s),
rates AS (SELECT instance, "window", le, sum(CASE WHEN q IS NULL THEN 0 ELSE value - q END) / 86400 AS n FROM p GROUP BY 1, 2, 3),
w AS (SELECT *, coalesce(lag(n) OVER v, 0) AS n0, coalesce(lag(le) OVER v, 0) AS le0, 0.99::DOUBLE * max(n) OVER (PARTITION BY instance, "window") AS r FROM rates WINDOW v AS (PARTITION BY instance, "window" ORDER BY le))"""


@query(f"""WITH {BY_INSTANCE} SELECT instance, "window", round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN le0 ELSE le0 + (le - le0) * (r - n0) / (n - n0) END, le), 6) AS value FROM w WHERE n >= r AND n > n0 GROUP BY 1, 2""")
def quantile_by_instance(spark: SparkSession, d: str) -> DataFrame:
    """The 0.99 quantile of latency per instance and day, from rates of cumulative bucket counters."""
    from pyspark.sql import Window

    minute = F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    own = events(spark, d).select((F.col("user_id") % 3).cast("string").alias("instance"), minute.alias("ts"), "value")
    counted = own.groupBy("instance", "ts").agg(*[F.count_if(F.col("value") <= b).alias(f"n{i}") for i, b in enumerate(BOUNDS)], F.count("value").alias("all"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"n{i}").alias("k")) for i, b in enumerate(BOUNDS)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("k")))
    samples = counted.select("instance", "ts", F.explode(pairs).alias("x")).select("instance", "ts", "x.*")
    running = F.sum("k").over(Window.partitionBy("instance", "le").orderBy("ts")).cast("double")
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    found = statistics.histogram_quantile(samples.select("instance", "le", "ts", running.alias("value")), ["instance"], 0.99, day, 86400.0)
    return found.withColumn("value", F.round("value", 6))


COUNTERS = """c AS (SELECT event_type AS command, date_trunc('minute', ts) AS ts, count(*) AS k FROM events GROUP BY 1, 2),
s AS (SELECT command, ts, (sum(k) OVER (PARTITION BY command ORDER BY ts) % 500)::DOUBLE AS value FROM c)"""


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Counter samples by minute and command, which restart at 500."""
    from pyspark.sql import Window

    c = events(spark, d).groupBy(F.col("event_type").alias("command"), F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("k"))
    return c.select("command", "ts", (F.sum("k").over(Window.partitionBy("command").orderBy("ts")) % 500).cast("double").alias("value"))


@query(f"""WITH {COUNTERS}, p AS (SELECT *, date_trunc('hour', ts) AS "window", lag(value) OVER (PARTITION BY command, date_trunc('hour', ts) ORDER BY ts) AS q FROM s)
SELECT command, "window", sum(CASE WHEN q IS NULL THEN 0 WHEN value < q THEN value ELSE value - q END) / 3600 AS rate FROM p GROUP BY 1, 2""")
def command_rates(spark: SparkSession, d: str) -> DataFrame:
    return statistics.rate(counters(spark, d), ["command"], F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"), 3600.0)


@query(f"WITH {COUNTERS} SELECT max(value) AS max_value, sum(value) AS sum_value, count(*) AS n FROM (SELECT command, arg_max(value, ts) AS value FROM s GROUP BY 1)")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    last = counters(spark, d).groupBy("command").agg(F.max_by("value", "ts").alias("value"))
    return last.agg(F.max("value").alias("max_value"), F.sum("value").alias("sum_value"), F.count("*").alias("n"))


@query(f"""WITH {STATS}, x AS (SELECT disk_bytes::DOUBLE / live_bytes AS a, (SELECT count(*) FROM events WHERE event_type = 'error') AS e, (SELECT count(*) FROM events) AS t FROM stats)
SELECT 'warning' AS severity, 'space amplification' AS finding FROM x WHERE a > 3 UNION ALL SELECT 'warning', 'error ratio' FROM x WHERE t > 100 AND e::DOUBLE / t > 0.01
UNION ALL SELECT 'warning', 'slow ping' FROM x WHERE 60 > 50""")
def doctor_rules(spark: SparkSession, d: str) -> DataFrame:
    counts = events(spark, d).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("total"))
    both = statistics.store_stats(events_log(spark, d)).unionByName(counts, allowMissingColumns=True)
    evidence = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return statistics.diagnose(evidence.select(F.lit(True).alias("reachable"), F.lit(60.0).alias("ping_ms"), "space_amplification", F.lit(0).alias("torn_bytes"), "errors", "total", F.lit(0.001).alias("p99_seconds")))


@query(f"""WITH {LOG}, b AS (SELECT key, arg_max(value, seq) AS v FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log) GROUP BY key HAVING NOT arg_max(tombstone, seq))
SELECT key, CASE WHEN b.key IS NULL THEN 'added' WHEN s.key IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT key, value AS v FROM state) s FULL JOIN b USING (key) WHERE b.v IS DISTINCT FROM s.v""")
def state_diff(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    before = state.latest_state(log.filter(F.col("seq") <= half))
    return state.state_diff(before, state.latest_state(log), ["value"])


@query(f"WITH {LOG} SELECT count(*) AS unwritten FROM state WHERE seq % 97 = 0")
def history_check(spark: SparkSession, d: str) -> DataFrame:
    """A state damaged at every 97th number, against all that was ever written."""
    log = events_log(spark, d)
    s = state.latest_state(log).withColumn("value", F.when(F.col("seq") % 97 == 0, "damaged").otherwise(F.col("value")))
    return state.unwritten(s, log).agg(F.count("*").alias("unwritten"))


@query(f"""WITH {LOG}, r AS (SELECT key, CASE WHEN seq % 5 = 0 THEN 'missing' WHEN seq % 5 = 1 THEN 'checksum' WHEN seq % 5 = 2 THEN 'wrong key' ELSE 'ok' END AS status FROM state)
SELECT status, count(*) AS n FROM r GROUP BY 1""")
def read_verification(spark: SparkSession, d: str) -> DataFrame:
    log, m = events_log(spark, d), F.col("seq") % 5
    records = log.filter(m != 0).select("file_id", "offset", F.when(m == 2, F.col("key") + 1).otherwise(F.col("key")).alias("record_key"), (m != 1).alias("crc_ok"))
    index = state.latest_state(log).select("key", "file_id", "offset")
    return state.verified_get(index, records).groupBy("status").agg(F.count("*").alias("n"))


ARITY = (("PING", 1), ("ping", 3), ("ECHO", 2), ("GET", 1), ("get", 2), ("SET", 3), ("SET", 4), ("DEL", 1), ("EXISTS", 3), ("INCR", 2), ("DBSIZE", 1), ("CONFIG", 9), ("KEYS", 2))


@query(f"""SELECT name, argc::BIGINT AS argc, CASE upper(name) WHEN 'PING' THEN argc <= 2 WHEN 'ECHO' THEN argc = 2 WHEN 'GET' THEN argc = 2 WHEN 'SET' THEN argc = 3 WHEN 'DEL' THEN argc >= 2
WHEN 'EXISTS' THEN argc >= 2 WHEN 'INCR' THEN argc = 2 WHEN 'DECR' THEN argc = 2 WHEN 'DBSIZE' THEN TRUE WHEN 'CONFIG' THEN TRUE ELSE FALSE END AS accepted
FROM (VALUES {", ".join(str(a) for a in ARITY)}) AS t(name, argc)""")
def command_arity(spark: SparkSession, d: str) -> DataFrame:
    n, c = F.upper("name"), F.col("argc")
    fine = F.when(n == "PING", c <= 2).when(n.isin("ECHO", "GET", "INCR", "DECR"), c == 2).when(n == "SET", c == 3).when(n.isin("DEL", "EXISTS"), c >= 2)
    known = command_name(F.col("name")) != "unknown"
    return values(spark, list(ARITY), "name string, argc bigint").select("name", "argc", F.coalesce(fine, known).alias("accepted"))


def g(x: str) -> str:
    return f"printf('%.10g', ({x})::DOUBLE)"


SINGLE = (("up", "1"), ("uptime_seconds", "0.25"), ("keys", "live_keys"), ("data_files", "data_files"), ("disk_bytes", "disk_bytes"), ("live_bytes", "live_bytes"), ("space_amplification", "amplification"),
          ("recovered_torn_bytes", "torn"), ("fsyncs_total", "writes"), ("writes_total", "writes"), ("connected_clients", "0"), ("connections_total", "12345678901"))
TEXT = f"""{EIGHT}, {COUNTS}, buckets AS (SELECT le, (SELECT count(*) FROM cmd WHERE seconds <= le OR le = 'inf'::DOUBLE) AS n FROM (VALUES {', '.join(f'({b}::DOUBLE)' for b in BOUNDS)}, ('inf'::DOUBLE)) AS b(le)),
samples AS ({' UNION ALL '.join(f"SELECT 'store_{n} ' || {g(x)} AS line FROM eight" for n, x in SINGLE)}
  UNION ALL SELECT 'store_commands_total{{command="' || command || '"}} ' || {g('n')} FROM k
  UNION ALL SELECT 'store_command_errors_total ' || {g('sum(errors)')} FROM k
  UNION ALL SELECT 'store_command_duration_seconds_bucket{{le="' || CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE {g('le')} END || '"}} ' || {g('n')} FROM buckets
  UNION ALL SELECT 'store_command_duration_seconds_sum ' || {g('sum(seconds)')} FROM k
  UNION ALL SELECT 'store_command_duration_seconds_count ' || {g('sum(n)')} FROM k)"""


def exposition(spark: SparkSession, d: str) -> DataFrame:
    names = {"live_keys": "keys", "fsyncs": "fsyncs_total", "writes": "writes_total"}
    gauges = whole_stats(spark, d).withColumnsRenamed(names).withColumns({"up": F.lit(1), "uptime_seconds": F.lit(0.25), "connected_clients": F.lit(0), "connections_total": F.lit(12_345_678_901)})
    c = commands(spark, d)
    return statistics.metrics_text(gauges, statistics.command_counts(c), statistics.latency_buckets(c, BOUNDS))


@query(f"""WITH {TEXT} SELECT line FROM samples UNION ALL SELECT line FROM (VALUES {', '.join(f"('# HELP store_{n} {t}'), ('# TYPE store_{n} {k}')" for n, k, t in statistics.FAMILIES)}) AS t(line)""")
def metrics_exposition(spark: SparkSession, d: str) -> DataFrame:
    """All families of the exposition, without their order."""
    return exposition(spark, d).select("line")


@query(f"""WITH {TEXT} SELECT regexp_extract(line, '^(.*) ([^ ]+)$', 1) AS series, regexp_extract(line, '^(.*) ([^ ]+)$', 2)::DOUBLE AS value FROM samples""")
def metrics_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The exposition, parsed again."""
    return statistics.parse_metrics(exposition(spark, d).select(F.col("line").alias("value")))


@query("SELECT epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS uptime_seconds FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def uptime(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    return events(spark, d).agg((F.unix_seconds(F.max(t)) - F.unix_seconds(F.min(t))).alias("uptime_seconds"))


BYTES = """raw AS (SELECT key, seq, flatten([[(seq >> (8 * i)) & 255 FOR i IN range(8)], [(strlen(k) >> (8 * i)) & 255 FOR i IN range(4)], [(strlen(value) >> (8 * i)) & 255 FOR i IN range(4)],
  [CASE WHEN tombstone THEN 1 ELSE 0 END], [ascii(x) FOR x IN string_split(k, '')], CASE WHEN value = '' THEN [] ELSE [ascii(x) FOR x IN string_split(value, '')] END]) AS body FROM (SELECT *, key::VARCHAR AS k FROM log)),
steps AS (SELECT [list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
summed AS (SELECT key, seq, body, xor(list_reduce(list_prepend(4294967295, body), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM raw, steps)"""


@query(f"""WITH {LOG}, {BYTES} SELECT seq, crc, upper(array_to_string([printf('%02x', b) FOR b IN flatten([[(crc >> (8 * i)) & 255 FOR i IN range(4)], body])], '')) AS record FROM summed""")
def record_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a checksummed binary record, in hex, encoded in the JVM."""
    made = encoded_log(spark, d)
    return made.select("seq", F.hex("record").alias("record"), F.crc32(F.substring(F.col("record"), F.lit(5), F.octet_length("record"))).alias("crc"))


def encoded_log(spark: SparkSession, d: str) -> DataFrame:
    made = encode_record(F.col("seq"), F.col("tombstone"), F.col("key").cast("string").cast("binary"), F.col("value").cast("binary"))
    return events_log(spark, d).select("file_id", "seq", made.alias("record"))


def damaged_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): the events as files of at most 1,000 records. The last record of every file
    1, 4, 7 ... is cut off by 5 bytes, and record 37 of every file 2, 5, 8 ... has an impossible flag."""
    r, n = F.col("record"), F.octet_length("record")
    flag = (F.col("file_id") % 3 == 2) & (F.col("seq") % 1000 == 37)
    bad = F.when(flag, F.concat(F.substring(r, 1, 20), F.lit(b"\x07"), F.substring(r, F.lit(22), n))).otherwise(r)
    rows = encoded_log(spark, d).select("file_id", F.struct("seq", F.hex(bad).alias("h")).alias("x"))
    whole = rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "").alias("h"))
    cut = F.when(F.col("file_id") % 3 == 1, F.substring(F.col("h"), F.lit(1), F.length("h") - 10)).otherwise(F.col("h"))
    return whole.select(F.concat(F.lit("/"), F.lpad(F.col("file_id").cast("string"), 9, "0"), F.lit(".data")).alias("path"), F.unhex(cut).alias("content"))


KEPT = f"""{LOG}, ends AS (SELECT file_id, max(seq) AS last FROM log GROUP BY 1),
kept AS (SELECT log.* FROM log JOIN ends USING (file_id) WHERE NOT (file_id % 3 = 1 AND seq = last) AND NOT (file_id % 3 = 2 AND seq % 1000 >= 37)),
lost AS (SELECT file_id, sum(CASE WHEN file_id % 3 = 1 THEN record_size - 5 ELSE record_size END) AS bytes FROM log JOIN ends USING (file_id) WHERE (file_id % 3 = 1 AND seq = last) OR (file_id % 3 = 2 AND seq % 1000 >= 37) GROUP BY 1)"""


@query(f"""WITH {KEPT}, n AS (SELECT key, max(seq) AS seq FROM kept GROUP BY 1) SELECT key::VARCHAR AS key, seq, value FROM kept JOIN n USING (key, seq) WHERE NOT tombstone""")
def recovered_state(spark: SparkSession, d: str) -> DataFrame:
    """Recovery from bytes: decode, valid prefix of each file, newest row of each key, deletes last."""
    found, _ = validation.recover(binary_log.decode_frame(damaged_files(spark, d)))
    return found.select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


@query(f"""WITH {KEPT} SELECT (SELECT max(seq) + 1 FROM kept) AS next_seq, coalesce(sum(bytes), 0)::BIGINT AS torn_bytes, count(*) FILTER (file_id % 3 = 2) AS corrupt_records FROM lost""")
def recovery_report(spark: SparkSession, d: str) -> DataFrame:
    return validation.recover(binary_log.decode_frame(damaged_files(spark, d)))[1]


@query(f"""WITH {KEPT} SELECT e.file_id, coalesce(sum(record_size), 0)::BIGINT AS bytes FROM ends e LEFT JOIN kept USING (file_id) GROUP BY 1""")
def repaired_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with their damaged tails cut off, by size."""
    files = damaged_files(spark, d)
    numbered = files.select(F.regexp_extract("path", r"([0-9]{9})", 1).cast("bigint").alias("file_id"), "content")
    whole = validation.repaired(numbered, binary_log.decode_frame(files))
    return whole.select("file_id", F.octet_length("content").cast("bigint").alias("bytes"))


@query(f"""WITH RECURSIVE {LOG}, s AS (SELECT key, key % 4 AS writer, seq, record_size AS size, row_number() OVER (PARTITION BY key % 4 ORDER BY seq) AS i FROM state),
f(key, writer, seq, size, i, file_no, "offset") AS (
  SELECT key, writer, seq, size, i, 0::BIGINT, 0::BIGINT FROM s WHERE i = 1
  UNION ALL SELECT s.key, s.writer, s.seq, s.size, s.i, CASE WHEN f."offset" + f.size + s.size > 256 THEN f.file_no + 1 ELSE f.file_no END,
    CASE WHEN f."offset" + f.size + s.size > 256 THEN 0 ELSE f."offset" + f.size END FROM f JOIN s ON s.writer = f.writer AND s.i = f.i + 1)
SELECT writer, seq, size, file_no, "offset" FROM f""")
def compaction_split(spark: SparkSession, d: str) -> DataFrame:
    """The output of a compaction by four writers, split into files of at most 256 bytes."""
    packed = state.compact(events_log(spark, d)).select((F.col("key") % 4).alias("writer"), "seq", F.col("record_size").alias("size"))
    return replay.rotate(packed, 256, "writer")


SENT = """sent AS (SELECT event_id AS pos, 'k' || user_id AS k, 'k' || (user_id + 1) AS k2, CASE WHEN event_id % 13 = 0 THEN 'abc' ELSE (event_id % 50)::VARCHAR END AS v,
  CASE event_type WHEN 'signup' THEN 'SET' WHEN 'error' THEN 'DEL' WHEN 'click' THEN 'INCR' WHEN 'view' THEN 'GET' ELSE ['PING', 'ECHO', 'DBSIZE', 'EXISTS', 'CONFIG', 'NOPE', 'ARITY', 'COMPACT', 'QUIT'][event_id % 9 + 1] END AS op FROM events),
parts AS (SELECT pos, op, v, k AS key, 0 AS at FROM sent WHERE op IN ('SET', 'DEL', 'INCR', 'GET', 'EXISTS') UNION ALL SELECT pos, op, v, k2, 1 FROM sent WHERE op = 'EXISTS'),
w AS (SELECT *, count(*) FILTER (op IN ('SET', 'DEL')) OVER (PARTITION BY key ORDER BY pos) AS seg FROM parts),
b AS (SELECT *, max(CASE WHEN op = 'SET' THEN v END) OVER (PARTITION BY key, seg) AS base, count(*) FILTER (op = 'INCR') OVER (PARTITION BY key, seg ORDER BY pos) AS incs FROM w),
a AS (SELECT *, CASE WHEN incs = 0 OR base = 'abc' THEN base ELSE (coalesce(base::BIGINT, 0) + incs)::VARCHAR END AS after FROM b),
p AS (SELECT *, lag(after) OVER (PARTITION BY key ORDER BY pos) AS had FROM a),
x AS (SELECT pos, count(had) AS n, max(after) AS after, max(CASE WHEN op = 'INCR' AND base = 'abc' THEN 1 END) AS bad, (count(after) - count(had)) AS change FROM p GROUP BY 1),
y AS (SELECT sent.*, n, after, bad, sum(coalesce(change, 0)) OVER (ORDER BY sent.pos)::BIGINT AS live FROM sent LEFT JOIN x USING (pos)),
replies AS (SELECT pos, CASE op WHEN 'SET' THEN '+OK' WHEN 'COMPACT' THEN '+OK' WHEN 'QUIT' THEN '+OK' WHEN 'PING' THEN '+PONG' WHEN 'ECHO' THEN '$2' || chr(13) || chr(10) || 'hi' WHEN 'DBSIZE' THEN ':' || live WHEN 'EXISTS' THEN ':' || n
  WHEN 'DEL' THEN ':' || n WHEN 'CONFIG' THEN '*0' WHEN 'NOPE' THEN '-ERR unknown command ' || chr(39) || 'Nope' || chr(39) WHEN 'ARITY' THEN '-ERR wrong number of arguments for ' || chr(39) || 'get' || chr(39) || ' command'
  WHEN 'GET' THEN CASE WHEN after IS NULL THEN '$-1' ELSE '$' || strlen(after) || chr(13) || chr(10) || after END
  ELSE CASE WHEN bad = 1 THEN '-ERR value is not an integer or out of range' ELSE ':' || after END END || chr(13) || chr(10) AS reply FROM y)"""


def sent_commands(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    k, k2 = (F.concat(F.lit("k"), (F.col("user_id") + n).cast("string")) for n in (0, 1))
    v = F.when(i % 13 == 0, "abc").otherwise((i % 50).cast("string"))
    line = lambda *x: F.array(*[F.lit(c) if isinstance(c, str) else c for c in x])
    rest = (line("PING"), line("echo", "hi"), line("DbSize"), line("EXISTS", k, k2), line("CONFIG", "GET", "save"), line("Nope", k), line("GET"), line("COMPACT"), line("QUIT"))
    other = rest[8]
    for n in range(8):
        other = F.when(i % 9 == n, rest[n]).otherwise(other)
    args = F.when(t == "signup", line("SET", k, v)).when(t == "error", line("DEL", k)).when(t == "click", line("incr", k)).when(t == "view", line("get", k)).otherwise(other)
    return events(spark, d).select(i.alias("pos"), args.alias("args"))


@query(f"WITH {SENT} SELECT pos, reply FROM replies")
def command_replies(spark: SparkSession, d: str) -> DataFrame:
    return execute.execute(sent_commands(spark, d))


@query(f"WITH {SENT} SELECT starts_with(reply, '-') AS error, count(*) AS n FROM replies GROUP BY 1")
def reply_errors(spark: SparkSession, d: str) -> DataFrame:
    return statistics.error_replies(execute.execute(sent_commands(spark, d))).groupBy("error").agg(F.count("*").alias("n"))


WORK = """h AS (SELECT i, md5('7:' || i) AS m FROM range(3000) AS t(i)),
log AS (SELECT i AS seq, 'k' || (('0x' || m[1:4])::BIGINT % 50) AS key, ('0x' || m[5:8])::BIGINT % 100 < 25 AS tombstone, 'op' || i AS value FROM h)"""


@query(f"""WITH {WORK}, n AS (SELECT key, max(seq) AS seq FROM log GROUP BY 1) SELECT key, seq, value FROM log JOIN n USING (key, seq) WHERE NOT tombstone""")
def workload_state(spark: SparkSession, d: str) -> DataFrame:
    """The state that a seeded workload leaves."""
    return state.latest_state(replay.workload(spark, 3000, seed=7, keys=50, deletes=25)).select("key", "seq", "value")


@query(f"WITH {LOG} SELECT key, seq, value FROM state")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The live state of the events as a stream, kept by micro-batches."""
    log = events_log(spark, d).select("key", "seq", "tombstone", "value")
    source, out, checkpoint = (shared_dir(spark) for _ in range(3))
    log.write.parquet(source)
    live_state.maintain(spark.readStream.schema(log.schema).parquet(source), out, checkpoint).awaitTermination()
    return state.latest_state(spark.read.schema(log.schema).parquet(out)).select("key", "seq", "value")

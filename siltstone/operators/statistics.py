"""Storage statistics, command metrics, quantiles, alert conditions and diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import command_name, ratio
from siltstone.operators.state import latest_state

#: Upper bounds of the latency histogram in seconds (fixed values).
LATENCY_BOUNDS = (0.00001, 0.000025, 0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.05)


def store_stats(log: DataFrame, active_empty: bool = False) -> DataFrame:
    """One row: live keys, files (one more where the active file is still empty), bytes on disk,
    live bytes and their ratio."""
    live = latest_state(log).select("record_size", F.lit(None).cast("bigint").alias("file_id"), F.lit(True).alias("live"))
    both = live.unionByName(log.select("record_size", "file_id", F.lit(False).alias("live")))
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("record_size"))), F.lit(0)).cast("bigint")
    files = (F.count_distinct("file_id") + int(active_empty)).alias("data_files")
    return both.agg(F.count_if("live").alias("live_keys"), files, size(~F.col("live")).alias("disk_bytes"), size(F.col("live")).alias("live_bytes")).withColumn(
        "space_amplification", ratio(F.col("disk_bytes"), F.col("live_bytes"))
    )


#: Fields of the statistics text, in order (fixed format); the ratio has six decimals.
INFO_FIELDS = ("live_keys", "data_files", "disk_bytes", "live_bytes", "space_amplification", "fsyncs", "writes", "recovered_torn_bytes")


def info_text(stats: DataFrame, title: str = "store") -> DataFrame:
    """The eight statistics as a heading and name:value lines, each ended by CR LF."""
    shown = [F.format_string("%.6f", n) if n == "space_amplification" else F.col(n).cast("string") for n in INFO_FIELDS]
    lines = [F.concat(F.lit(f"{n}:"), v, F.lit("\r\n")) for n, v in zip(INFO_FIELDS, shown, strict=True)]
    return stats.select(F.concat(F.lit(f"# {title}\r\n"), *lines).alias("info"))


def effective_writes(log: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``writes``: puts, and deletes of keys that were live. A delete of an absent key writes nothing.

    What a row finds is the row before it of its key. Runs of ``width`` numbers of a key are ordered
    each for themselves; only their first and last rows meet to bridge the runs."""
    inside = Window.partitionBy("key", "_r").orderBy("seq")
    runs = log.select("key", "seq", "tombstone", F.floor(F.col("seq") / width).alias("_r")).withColumn("_before", F.lag("tombstone").over(inside))
    wrote = ~F.col("tombstone") | ~F.col("_before")
    ends = runs.groupBy("key", "_r").agg(F.count_if(wrote).alias("n"), F.min_by("tombstone", "seq").alias("_first"), F.max_by("tombstone", "seq").alias("_last"))
    bridge = F.lag("_last").over(Window.partitionBy("key").orderBy("_r"))
    more = ends.withColumn("_found", bridge).select((F.col("n") + F.when(F.col("_first") & ~F.col("_found"), 1).otherwise(0)).alias("n"))
    return more.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("writes"))


def command_counts(commands: DataFrame) -> DataFrame:
    """(command, n, errors, seconds) per normalised name; seconds are summed as whole microseconds, so
    the sum doesn't depend on its order."""
    micros = F.sum(F.round(F.col("seconds").cast("double") * 1e6).cast("bigint"))
    return commands.groupBy(command_name(F.col("name")).alias("command")).agg(
        F.count("*").alias("n"), F.count_if("error").alias("errors"), (F.coalesce(micros, F.lit(0)).cast("double") / 1e6).alias("seconds")
    )


def error_replies(replies: DataFrame) -> DataFrame:
    """Replies (reply) with ``error``: an error reply begins with a minus."""
    return replies.withColumn("error", F.substring(F.col("reply").cast("binary"), 1, 1) == F.lit(b"-"))


def latency_buckets(commands: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """(le, n): cumulative counts; +Inf holds all. One scan that counts every bound; no range join."""
    counted = commands.agg(*[F.count_if(F.col("seconds") <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count("*").alias("_all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n"))]
    return counted.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def bucket_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """The least bound that at least q of all observations reach; none when there are none."""
    total = F.max("n").over(Window.partitionBy())  # one row per bound
    return buckets.withColumn("_total", total).filter((F.col("_total") > 0) & (F.col("n") >= q * F.col("_total"))).agg(F.min("le").alias("value"))


def interpolated_quantile(buckets: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Per ``keys``: linear interpolation inside the bucket of rank q * total; the last finite bound
    above it. Groups without observations have no row."""
    by = Window.partitionBy(*keys)
    w = by.orderBy("le")  # one row per bound
    rows = buckets.withColumn("_n0", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("_le0", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_rank", q * F.max("n").over(by))
    inside = F.when(F.col("le") == float("inf"), F.col("_le0")).otherwise(F.col("_le0") + (F.col("le") - F.col("_le0")) * (F.col("_rank") - F.col("_n0")) / (F.col("n") - F.col("_n0")))
    return rows.filter((F.col("n") >= F.col("_rank")) & (F.col("n") > F.col("_n0"))).groupBy(*keys).agg(F.min_by(inside, "le").alias("value"))


def histogram_quantile(samples: DataFrame, keys: list[str], q: float, window: Column, seconds: float) -> DataFrame:
    """(keys, window, value): the quantile of the rates of cumulative bucket counters (keys, le, ts,
    value, and further labels, over which the rates are summed)."""
    labels = [c for c in samples.columns if c not in (*keys, "le", "ts", "value")]
    rates = rate(samples, [*keys, *labels, "le"], window, seconds)
    return interpolated_quantile(rates.groupBy(*keys, "window", "le").agg(F.sum("rate").alias("n")), q, [*keys, "window"])


def order_statistics(rows: DataFrame, column: str, ranks: Sequence[int]) -> list[float | None]:
    """The values at the 0-based ``ranks`` of the sorted column, exactly; None beyond its rows. NaN is
    the greatest.

    Approximate percentiles around each rank, all in one pass, bound where it is; exact counts of
    what lies below the bounds, in another, confirm it; only the values between are sorted, at
    most 100,000 a rank. A rank that is not so confirmed goes on with what is left for it."""
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    todo, out = {k: (F.lit(True), r) for k, r in enumerate(ranks)}, [None] * len(ranks)
    while todo:
        counts = values.agg(*[F.count_if(c).alias(f"n{k}") for k, (c, _) in todo.items()]).first()
        todo = {k: x for k, x in todo.items() if 0 <= x[1] < counts[f"n{k}"]}
        if not todo:
            break
        near = lambda k, r: [min(1.0, max(0.0, (r + d * counts[f"n{k}"] / 4000) / counts[f"n{k}"])) for d in (-1, 1)]
        ends = values.agg(*[F.percentile_approx(F.when(c, F.col("v")), near(k, r), 10_000).alias(f"p{k}") for k, (c, r) in todo.items()]).first()
        tests = []
        for k, (c, _) in todo.items():
            lo, hi = ends[f"p{k}"]
            tests += [F.count_if(c & t).alias(f"{n}{k}") for n, t in (("a", F.col("v") < lo), ("b", F.col("v") <= lo), ("c", F.col("v") < hi), ("d", F.col("v") <= hi))]
        got, left, few = values.agg(*tests).first(), {}, {}
        for k, (c, r) in todo.items():
            (lo, hi), (a, b, x, y) = ends[f"p{k}"], (got[f"{n}{k}"] for n in "abcd")
            if a <= r < b or x <= r < y:
                out[k] = lo if r < b else hi
            elif r < a:
                left[k] = c & (F.col("v") < lo), r
            elif r >= y:
                left[k] = c & (F.col("v") > hi), r - y
            elif x - b <= 100_000:
                few[k] = c & (F.col("v") > lo) & (F.col("v") < hi), r - b
            else:
                left[k] = c & (F.col("v") > lo) & (F.col("v") < hi), r - b
        if few:
            sorted_ = values.agg(*[F.sort_array(F.collect_list(F.when(c, F.col("v"))))[F.lit(r)].alias(f"v{k}") for k, (c, r) in few.items()]).first()
            for k in few:
                out[k] = sorted_[f"v{k}"]
        todo = left
    return out


def order_statistic(rows: DataFrame, column: str, rank: int) -> float | None:
    return order_statistics(rows, column, [rank])[0]


def bench_percentiles(rows: DataFrame, column: str, ps: Sequence[float]) -> list[float]:
    """sorted[min(n - 1, floor(p / 100 * n))] for each p; 0 for none."""
    n = rows.filter(F.col(column).isNotNull()).count()
    return order_statistics(rows, column, [min(n - 1, int(p / 100 * n)) for p in ps]) if n else [0.0] * len(ps)


def load_percentiles(rows: DataFrame, column: str, ps: Sequence[float]) -> list[float]:
    """sorted[floor(p / 100 * (n - 1))] for each p; 0 for none."""
    n = rows.filter(F.col(column).isNotNull()).count()
    return order_statistics(rows, column, [int(p / 100 * (n - 1)) for p in ps]) if n else [0.0] * len(ps)


def bench_percentile(rows: DataFrame, column: str, p: float) -> float:
    return bench_percentiles(rows, column, [p])[0]


def load_percentile(rows: DataFrame, column: str, p: float) -> float:
    return load_percentiles(rows, column, [p])[0]


def throughput(commands: DataFrame, time: Column) -> DataFrame:
    """Operations per second between the first and the last one."""
    return commands.agg(F.count("*").alias("ops"), (F.unix_seconds(F.max(time)) - F.unix_seconds(F.min(time))).alias("seconds")).select(
        "ops", "seconds", F.try_divide(F.col("ops").cast("double"), F.col("seconds")).alias("ops_per_second")
    )


def rate(samples: DataFrame, keys: list[str], window: Column, seconds: float) -> DataFrame:
    """Increase of a counter per second in each window: the sum of its steps, where a step down is
    a restart that counts from 0. No extrapolation to the window's ends."""
    by = Window.partitionBy(*keys, "_w").orderBy("ts")
    placed = samples.withColumn("_w", window).withColumn("_p", F.lag("value").over(by))
    step = F.when(F.col("_p").isNull(), 0.0).when(F.col("value") < F.col("_p"), F.col("value")).otherwise(F.col("value") - F.col("_p"))
    return placed.groupBy(*keys, F.col("_w").alias("window")).agg((F.sum(step) / seconds).alias("rate"))


def firing(samples: DataFrame, keys: list[str], condition: Column, minutes: int, interval_seconds: int) -> DataFrame:
    """(keys, fired_at): the moments at which a condition has held without a break for so long;
    one row per run. A false sample ends a run, and so does a missing one: two samples further
    apart than ``interval_seconds``. With 0 minutes a run fires at its first sample."""
    by = Window.partitionBy(*keys).orderBy("ts")
    gap = F.col("ts") > F.lag("ts").over(by) + F.make_dt_interval(secs=F.lit(interval_seconds))
    cut = ~F.col("_c") | F.coalesce(gap, F.lit(False))
    runs = samples.withColumn("_c", F.coalesce(condition, F.lit(False))).withColumn("_cut", cut.cast("int")).withColumn("_run", F.sum("_cut").over(by))
    held = runs.filter("_c").withColumn("_from", F.min("ts").over(Window.partitionBy(*keys, "_run")))
    return held.filter(F.col("ts") >= F.col("_from") + F.make_dt_interval(mins=F.lit(minutes))).groupBy(*keys, "_run").agg(F.min("ts").alias("fired_at")).drop("_run")


def on_grid(samples: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """The last sample of each step of a grid of ``seconds``, at the step's time (ts): what a scrape at
    that interval keeps. Steps without a sample have no row, so alerts see the gap."""
    step = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("bigint")
    rest = [c for c in samples.columns if c not in (*keys, "ts")]
    last = samples.groupBy(*keys, step.alias("_t")).agg(F.max_by(F.struct(*rest), "ts").alias("_x"))
    return last.select(*keys, F.timestamp_seconds("_t").cast("timestamp_ntz").alias("ts"), *[F.col(f"_x.{c}").alias(c) for c in rest])


def diagnose(evidence: DataFrame) -> DataFrame:
    """(severity, finding) of one row of evidence: reachable, ping_ms, space_amplification,
    torn_bytes, errors, total, p99_seconds."""
    share = F.try_divide(F.col("errors").cast("double"), F.col("total"))
    rules = [
        (~F.col("reachable"), "critical", "unreachable"),
        (F.col("ping_ms") > 50, "warning", "slow ping"),
        (F.col("space_amplification") > 3, "warning", "space amplification"),
        (F.col("torn_bytes") > 0, "warning", "torn tail recovered"),
        ((F.col("total") > 100) & (share > 0.01), "warning", "error ratio"),
        (F.col("p99_seconds") > 0.010, "warning", "slow requests"),
    ]
    made = [F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(f).alias("finding"))) for c, s, f in rules]
    return evidence.select(F.explode(F.array_compact(F.array(*made))).alias("x")).select("x.*")


#: Families of the exposition: name, kind, help (fixed format; the prefix is the caller's).
FAMILIES = (
    ("up", "gauge", "1 if the server is running."),
    ("uptime_seconds", "gauge", "Seconds since the server started."),
    ("keys", "gauge", "Number of live keys."),
    ("data_files", "gauge", "Total data files."),
    ("disk_bytes", "gauge", "Bytes of all data files."),
    ("live_bytes", "gauge", "Bytes of live records."),
    ("space_amplification", "gauge", "disk_bytes / live_bytes."),
    ("recovered_torn_bytes", "gauge", "Bytes cut off at the last start."),
    ("fsyncs_total", "counter", "Forced writes."),
    ("writes_total", "counter", "Successful puts and deletes."),
    ("connected_clients", "gauge", "Open connections."),
    ("connections_total", "counter", "Connections accepted."),
    ("commands_total", "counter", "Commands by name."),
    ("command_errors_total", "counter", "Commands that returned an error."),
    ("command_duration_seconds", "histogram", "Command run time."),
)


def number_text(value: Column) -> Column:
    """A number as C's %.10g writes it: ten significant digits, no trailing zeros, an exponent of two
    digits at least below 1e-4 and from 1e10."""
    v = value.cast("double")
    rounded = F.format_string("%.9e", v)
    exponent = F.regexp_extract(rounded, "e([+-][0-9]+)$", 1).cast("int")
    trim = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    mantissa = trim(F.regexp_extract(rounded, "^(-?[0-9.]+)e", 1))
    power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    plain = F.lit(None).cast("string")
    for e in range(-4, 10):
        plain = F.when(exponent == e, trim(F.format_string(f"%.{9 - e}f", v))).otherwise(plain)
    return F.when(v == 0, "0").when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(F.coalesce(plain, F.concat(mantissa, power)))


def metrics_text(gauges: DataFrame, counts: DataFrame, buckets: DataFrame, prefix: str = "store_") -> DataFrame:
    """(place, line): the exposition of all families, in order of place. ``gauges`` is one row with the
    families' names but the last three; counts are by command; buckets are cumulative, +Inf last."""
    label = lambda name, value: F.concat(F.lit(f'{{{name}="'), value, F.lit('"}'))
    line = lambda name, value, labels=F.lit(""): F.concat(F.lit(prefix + name), labels, F.lit(" "), number_text(value))
    rows = lambda df, k, text, order=F.lit(""): df.select(F.struct(F.lit(k).alias("family"), F.lit(2).alias("part"), order.cast("string").alias("at")).alias("place"), text.alias("line"))
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(number_text(F.col("le")))
    heads = [F.struct(F.struct(F.lit(k).alias("family"), F.lit(i).alias("part"), F.lit("").alias("at")).alias("place"), F.lit(t).alias("line")) for k, (name, kind, text) in enumerate(FAMILIES) for i, t in enumerate((f"# HELP {prefix}{name} {text}", f"# TYPE {prefix}{name} {kind}"))]
    single = [F.struct(F.struct(F.lit(k).alias("family"), F.lit(2).alias("part"), F.lit("").alias("at")).alias("place"), line(name, F.col(name)).alias("line")) for k, (name, _, _) in enumerate(FAMILIES[:12])]
    own = gauges.select(F.explode(F.array(*heads, *single)).alias("x")).select("x.*")
    errors = counts.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    at = F.when(F.col("le") == float("inf"), "z").otherwise(F.format_string("%020.9f", "le"))
    return (
        own.union(rows(counts, 12, line("commands_total", F.col("n"), label("command", F.col("command"))), F.col("command")))
        .union(rows(errors, 13, line("command_errors_total", F.col("errors"))))
        .union(rows(buckets, 14, line("command_duration_seconds_bucket", F.col("n"), label("le", le)), at))
        .union(rows(errors, 14, line("command_duration_seconds_sum", F.col("seconds")), F.lit("zsum")))
        .union(rows(errors, 14, line("command_duration_seconds_count", F.col("n")), F.lit("ztotal")))
    )


def parse_metrics(lines: DataFrame) -> DataFrame:
    """(series, value) of a text exposition's lines (value): comments and blanks are skipped, the
    number follows the last space."""
    kept = lines.select(F.trim("value").alias("l")).filter("l <> '' and not startswith(l, '#')")
    return kept.select(F.regexp_extract("l", r"^(.*) (\S+)$", 1).alias("series"), F.regexp_extract("l", r"^(.*) (\S+)$", 2).try_cast("double").alias("value"))

"""Replies of a log of commands, as one server would give them that runs the commands in order.

Keys don't touch each other, so each command is dealt out to its keys; every key's steps are
streamed in order (replay), which gives what the command found and left there. A command's reply puts
its keys together again. Only the number of live keys spans keys: it is a running sum of the steps
that made a key live or removed one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import KEY_LIMIT, VALUE_LIMIT
from siltstone.operators.replay import add_to, in_order, running_sum

KEYED = ("SET", "GET", "DEL", "EXISTS", "INCR", "DECR")
#: Error texts (fixed format).
SYNTAX, UNKNOWN = "ERR syntax error", "ERR unknown command '"


def arity_error(name: Column, argc: Column) -> Column:
    """The error of a command (upper-case name, number of arguments and name), or null."""
    wrong = F.when(name == "PING", argc > 2).when(name.isin("ECHO", "GET", "INCR", "DECR"), argc != 2).when(name == "SET", argc < 3).when(name.isin("DEL", "EXISTS"), argc < 2).otherwise(False)
    text = F.concat(F.lit("ERR wrong number of arguments for '"), F.lower(name), F.lit("' command"))
    return F.when((name == "SET") & (argc > 3), F.lit(SYNTAX)).when(wrong, text)


def size_error(name: Column, key: Column, value: Column) -> Column:
    """The error of a write whose key or value is out of bounds, or null."""
    bad = name.isin("SET", "INCR", "DECR") & (~F.octet_length(key).between(1, KEY_LIMIT) | ((name == "SET") & (F.octet_length(value) > VALUE_LIMIT)))
    return F.when(bad, F.lit("ERR key or value size out of range"))


def _steps(parts: DataFrame) -> DataFrame:
    """(pos, n, value, number, error, change) of every key of every command, in order of pos: whether the
    key was live, what GET found, what INCR or DECR made, and by how much live keys changed."""

    def make() -> Callable[[dict], Iterator[tuple]]:
        now: list = [None, None]  # key, value

        def step(row: dict) -> Iterator[tuple]:
            if not row:
                return
            if now[0] != row["key"]:
                now[:] = [row["key"], None]
            had, found, number, error = now[1] is not None, None, None, None
            if row["name"] == "SET":
                now[1] = row["value"]
            elif row["name"] == "DEL":
                now[1] = None
            elif row["name"] == "GET":
                found = now[1]
            elif row["name"] != "EXISTS":
                now[1], error = add_to(now[1], 1 if row["name"] == "INCR" else -1)
                number = None if error else int(now[1])
            yield row["pos"], int(had), found, number, error, int(now[1] is not None) - int(had)

        return step

    return in_order(parts, ["key"], ["pos", "at"], "pos bigint, n bigint, value string, number bigint, error string, change bigint", make)


def execute(commands: DataFrame, info: Column | None = None) -> DataFrame:
    """(pos, reply) of commands (pos, args), text arguments, in order of pos, whole numbers that don't
    repeat; in the notation of command_protocol.reply. Commands without arguments have no reply.
    INFO replies with ``info``, a text, by default empty; COMPACT changes nothing that a reply shows."""
    named = commands.filter(F.size("args") > 0).select("pos", "args", F.upper(F.col("args")[0]).alias("name"), F.size("args").alias("argc"))
    first, second = F.get("args", F.lit(1)), F.get("args", F.lit(2))
    fault = F.coalesce(arity_error(F.col("name"), F.col("argc")), size_error(F.col("name"), first, second))
    checked = named.withColumn("fault", fault)
    keyed = checked.filter(F.col("fault").isNull() & F.col("name").isin(*KEYED))
    several = F.when(F.col("name").isin("DEL", "EXISTS"), F.slice("args", 2, 1 << 20)).otherwise(F.array(first))
    parts = keyed.select("pos", "name", second.alias("value"), F.posexplode(several).alias("at", "key")).select("pos", "at", "name", "key", "value")
    by = _steps(parts).groupBy("pos").agg(F.sum("n").alias("n"), F.max("value").alias("value"), F.max("number").alias("number"), F.max("error").alias("error"), F.sum("change").alias("change"))
    done = checked.join(by, "pos", "left")
    live = running_sum(done.select("pos", F.coalesce("change", F.lit(0)).alias("change")), "pos", "change").select("pos", F.col("running").alias("live"))
    text = lambda c: F.concat(F.lit("$"), F.octet_length(c).cast("string"), F.lit("\r\n"), c, F.lit("\r\n"))
    line = lambda mark, c: F.concat(F.lit(mark), c.cast("string"), F.lit("\r\n"))
    n, ok = F.col("name"), F.lit("+OK\r\n")
    reply = (
        F.when(F.col("fault").isNotNull(), line("-", F.col("fault")))
        .when(F.col("error").isNotNull(), line("-ERR ", F.col("error")))
        .when((n == "PING") & (F.col("argc") == 1), F.lit("+PONG\r\n"))
        .when(n.isin("PING", "ECHO"), text(first))
        .when(n.isin("SET", "COMPACT", "QUIT"), ok)
        .when((n == "GET") & F.col("value").isNull(), F.lit("$-1\r\n"))
        .when(n == "GET", text(F.col("value")))
        .when(n.isin("DEL", "EXISTS"), line(":", F.col("n")))
        .when(n.isin("INCR", "DECR"), line(":", F.col("number")))
        .when(n == "DBSIZE", line(":", F.col("live")))
        .when(n == "INFO", text(info if info is not None else F.lit("")))
        .when(n.isin("CONFIG", "COMMAND"), F.lit("*0\r\n"))
        .otherwise(F.concat(F.lit(f"-{UNKNOWN}"), F.col("args")[0], F.lit("'\r\n")))
    )
    return done.join(live, "pos").select("pos", reply.alias("reply"))

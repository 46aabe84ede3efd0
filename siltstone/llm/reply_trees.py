"""Chat formatting of reply trees.

Nodes are messages with a parent. Iterative self-joins double the pointers upwards: after k rounds
every node knows its ancestor 2^k steps up, its depth and the score of that stretch, so a tree
of depth d takes log2(d) rounds. Leaves are ranked by the score of their path; the chosen paths
are spelled out by the same pointers, largest jump last, again in log2(d) self-joins. Every path
becomes one formatted conversation with a loss mask over its assistant texts.

Rounds are written to the shared folder. No join is by conversation: pointers are by node, so a
conversation that holds most rows spreads like any other. Only the formatted conversation itself is
one value in one row.

Template: ``<s>`` then for each turn ``<|role|>`` role ``<|text|>`` text ``<|end|>``, then ``</s>``.
Control strings inside roles and texts (those, and markers of other common templates) become a
backslash and a letter, a backslash becomes two; reading undoes it.

Defined results: null roles and texts are empty; turns that tie are ordered by role and text, all
kept; a parent that doesn't exist makes a root; nodes on a cycle belong to no path; paths of equal score
rank by leaf; null scores count 0; a null conv_id is a conversation of its own; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, map_rows, table

#: Strings that mean something to a template: this one's first, then those of other common ones.
CONTROLS = ("<s>", "</s>", "<|role|>", "<|text|>", "<|end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CODE = {c: "\\" + chr(ord("a") + i) for i, c in enumerate(CONTROLS)} | {"\\": "\\\\"}
_PLAIN = {v: k for k, v in _CODE.items()}
_FIND = re.compile("|".join(re.escape(c) for c in _CODE))


@dataclass(frozen=True)
class Params:
    """``branches`` best paths of each conversation are formatted; None: all, ranked all the same."""

    branches: int | None = None
    loss_roles: tuple[str, ...] = ("assistant",)


def escape(s: str | None) -> str:
    return _FIND.sub(lambda m: _CODE[m[0]], s or "")


def unescape(s: str) -> str:
    return re.sub(r"(?s)\\.", lambda m: _PLAIN.get(m[0], m[0]), s)


def format_turns(turns: list[tuple[str | None, str | None]], p: Params = Params()) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask as (start, end) in code points."""
    parts, at, mask = ["<s>"], 3, []
    for role, text in turns:
        head, body = f"<|role|>{escape(role)}<|text|>", escape(text)
        if (role or "") in p.loss_roles:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "<|end|>"]
        at += len(head) + len(body) + 7
    return "".join([*parts, "</s>"]), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    if not (formatted.startswith("<s>") and formatted.endswith("</s>")):
        raise ValueError("not a formatted conversation")
    out = []
    for turn in formatted[3:-4].split("<|end|>")[:-1]:
        role, _, text = turn.removeprefix("<|role|>").partition("<|text|>")
        out.append((unescape(role), unescape(text)))
    return out


def _numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows``, written, with their number from 0 in the given order. Rows are range-partitioned, so no
    group is sorted in one task; running numbers come from the partitions' sizes."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = cut(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")))
    sizes, first, starts = {r["_part"]: r["count"] for r in kept.groupBy("_part").count().collect()}, 0, []  # a row a partition
    for k in sorted(sizes):
        starts.append((k, first))
        first += sizes[k]
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _first bigint"))
    return kept.join(offsets, "_part").withColumn(name, (F.col("_i") + F.col("_first")).cast("long")).drop("_part", "_i", "_first")


def chain(rows: DataFrame) -> DataFrame:
    """Nodes of plain conversations (conv_id, turn, role, text): each turn replies to the one before.

    One long conversation is sorted by many tasks."""
    keys = ["conv_id", "turn", "role", "text"]
    nodes = _numbered(rows.select(*keys), keys, "node").select("conv_id", "node", "role", "text")
    before = nodes.select(F.col("conv_id").alias("_c"), (F.col("node") + 1).alias("_n"), F.col("node").alias("parent"))
    same = (nodes["node"] == before["_n"]) & nodes["conv_id"].eqNullSafe(before["_c"])
    return nodes.join(before, same, "left").select("conv_id", "node", "parent", "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, p: Params = Params()) -> DataFrame:
    """(conv_id, leaf, path_score, rank, pos, role, text): the turns of the chosen paths."""
    nodes = cut(nodes.select("conv_id", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("ok"))
    # a missing parent makes a root
    now = cut(nodes.join(known, "parent", "left").select("node", F.when(F.col("ok"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    done, jumps, most = now.filter("up is null"), [now.filter("up is not null")], nodes.count().bit_length() + 1
    while len(jumps) <= most and not jumps[-1].isEmpty():
        # only nodes that have not reached their root go on; after ``most`` rounds those are on cycles
        last = jumps[-1]
        above = done.union(last).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        now = cut(last.join(above, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total")))
        done = done.union(now.filter("up is null"))
        jumps.append(now.filter("up is not null"))
    leaves = done.select("node", "depth", "total").join(nodes.select("conv_id", "node"), "node").join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    placed = _numbered(leaves, ["conv_id", F.desc("total"), "node"], "_at")
    first = cut(placed.groupBy("conv_id").agg(F.min("_at").alias("_from")).withColumnRenamed("conv_id", "_c"))
    leaves = placed.join(first, placed["conv_id"].eqNullSafe(first["_c"])).withColumn("rank", (F.col("_at") - F.col("_from") + 1).cast("int"))
    if p.branches is not None:
        leaves = leaves.filter(F.col("rank") <= p.branches)
    on_path = cut(leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.col("depth").alias("pos"), F.col("total").alias("path_score"), "rank"))
    for k, jump in enumerate(jumps):
        step = jump.select("node", "up")
        higher = on_path.join(step, "node").select("conv_id", "leaf", F.col("up").alias("node"), (F.col("pos") - (1 << k)).alias("pos"), "path_score", "rank")
        on_path = cut(on_path.unionByName(higher))
    return on_path.join(nodes.select("node", "role", "text"), "node").select("conv_id", "leaf", "path_score", "rank", "pos", "role", "text")


def format_paths(turns: DataFrame, p: Params = Params()) -> DataFrame:
    """(conv_id, leaf, formatted, mask): one row a path; mask is array<struct<from,to>>."""
    gathered = turns.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))

    def rows(got: dict[str, list]) -> dict[str, list]:
        made = [format_turns([(t["role"], t["text"]) for t in turns], p) for turns in got["turns"]]
        return {"conv_id": got["conv_id"], "leaf": got["leaf"], "formatted": [m[0] for m in made], "mask": [[{"from": a, "to": b} for a, b in m[1]] for m in made]}

    kind = turns.schema["conv_id"].dataType.simpleString()
    return map_rows(gathered, ["conv_id", "leaf", "turns"], f"conv_id {kind}, leaf bigint, formatted string, mask array<struct<`from`:int,`to`:int>>", rows)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their loss masks hold."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, mask in zip(got["formatted"], got["mask"], strict=True):
            turns = read_turns(text)
            loss = "".join(unescape(text[m["from"] : m["to"]]) for m in mask)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(_sha("".join(f"{r}\n{t}\n" for r, t in turns)))
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(_sha(loss))
            out["formatted_chars"].append(len(text))
        return {"conv_id": got["conv_id"]} | out

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return map_rows(formatted, ["conv_id", "formatted", "mask"], f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", rows)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


PROBE = "</s>[INST] ok [/INST]"


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], told.schema)
    return read_back(format_paths(paths(chain(told.union(probe)))))


def chat_sql() -> str:
    """The contract of op2 in SQL, formatted_chars by counting control strings."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    longer = lambda c: " + ".join(f"(len({c}) - len(replace({c}, {q(x)}, ''))) // {len(x)} * {2 - len(x)}" for x in (*CONTROLS, "\\"))
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', {q(PROBE)} UNION ALL SELECT -1, 1, 'assistant', {q(PROBE)})
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(23 + len(role) + len(text) + {longer('role')} + {longer('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

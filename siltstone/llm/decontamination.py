"""Benchmark decontamination by winnowing.

Both sides are fingerprinted alike: of every ``Params.span - Params.gram + 1`` consecutive k-gram
hashes the smallest is kept (the rightmost of equals). Two texts that share ``span`` words share a
window of the same hashes, hence the same kept one, so joining the fingerprints misses no span.
Each hit is then extended: the ``span``-word windows of the document that contain the matched
k-gram are compared, word hash by word hash, with the benchmark's windows of equal hash.
Items shorter than ``span`` lie under that guarantee; their whole word sequence is one window,
and documents look it up by n-grams of its length.

The benchmark's side is a bounded index: its bytes are measured first, and a benchmark of more
than ``block_bytes`` is dealt into blocks of at most about that size, each a pass of its own whose hits
are added to the row's earlier ones. Documents are only mapped over: no shuffle, no skew.

Defined results: null texts and texts without words have no words and no hits; items without
words are ignored; items of equal text are all reported; an item without an id hits, but is not
listed; repeated document rows are treated each; columns of the input beside doc_id and text are
never looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, map_rows, table, text_bytes
from siltstone.llm.textkit import ALNUM, Words, blocks


@dataclass(frozen=True)
class Params:
    """``span`` words make a window; ``gram`` is the k of the fingerprints; a document is
    contaminated when ``share`` times its hit words reach its words."""

    span: int = 13
    gram: int = 5
    share: int = 20
    block_bytes: int = 32 << 20


def winnow(w: Words, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-grams of a block of texts: hashes and first words."""
    width = p.span - p.gram + 1
    h, at = w.grams(p.gram)
    if len(h) < width:
        return h[:0], at[:0]
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    whole = at[width - 1 :] - at[: len(views)] == width - 1
    low = np.arange(len(views)) + (width - 1 - np.argmin(views[:, ::-1], axis=1))
    kept = np.unique(low[whole])
    return h[kept], at[kept]


class Index:
    """Fingerprints and windows of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str]], p: Params) -> None:
        self.p = p
        prints, windows, short = set(), {}, defaultdict(dict)
        texts = [t for _, t in items]
        for first, run in blocks(texts):
            w = Words(run, ALNUM)
            prints.update(winnow(w, p)[0].tolist())
            lengths = np.diff(w.first)
            h, at = w.grams(p.span)
            for key, i in zip(h.tolist(), at.tolist(), strict=True):
                windows.setdefault((key, w.hash[i : i + p.span].tobytes()), set()).add(items[first + w.doc[i]][0])
            for d in np.flatnonzero((lengths > 0) & (lengths < p.span)):
                n, own = int(lengths[d]), Words([run[d]], ALNUM)
                short[n].setdefault((int(own.grams(n)[0][0]), own.hash.tobytes()), set()).add(items[first + d][0])
        self.prints = np.array(sorted(prints), dtype=np.uint64)
        self.tables = {n: _by_hash(t) for n, t in [(p.span, windows), *short.items()]}

    def hits(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[int, int, int, int]], list[int], int]]:
        """(hit runs as first word, last word + 1, first byte, last byte + 1; item ids; words) of
        each text."""
        for _, run in blocks(texts):
            w = Words(run, ALNUM)
            starts: list[tuple[int, int]] = []
            found: dict[int, set] = defaultdict(set)
            for n, t in self.tables.items():
                h, at = self._candidates(w, n)
                for key, i in zip(h.tolist(), at.tolist(), strict=True):
                    items = t.get(key, {}).get(w.hash[i : i + n].tobytes())
                    if items is not None:
                        starts.append((i, n))
                        found[int(w.doc[i])] |= items
            change = np.zeros(len(w) + 1, dtype=np.int64)
            if starts:
                s, n = np.array(starts).T
                np.add.at(change, s, 1)
                np.add.at(change, s + n, -1)
            hit = np.cumsum(change)[:-1] > 0
            for d in range(len(run)):
                a, b = w.first[d], w.first[d + 1]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))))
                o = w.offset[d]
                runs = [(int(x), int(y), int(w.start[a + x] - o), int(w.end[a + y - 1] - o)) for x, y in zip(edge[0::2], edge[1::2], strict=True)]
                yield runs, sorted(x for x in found.get(d, ()) if x is not None), int(b - a)

    def _candidates(self, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams that may equal a window: those that contain a matched fingerprint, or, for
        items below the guarantee, those whose hash is known."""
        h, at = w.grams(n)
        if not len(h):
            return h, at
        if n < self.p.span:
            keep = np.isin(h, np.fromiter(self.tables[n], dtype=np.uint64))
            return h[keep], at[keep]
        kept, words = winnow(w, self.p)
        words = words[_member(kept, self.prints)]
        near = np.unique((words[:, None] - np.arange(self.p.span - self.p.gram + 1)).ravel())
        place = np.searchsorted(at, near)
        place = place[(place < len(at)) & (at[np.minimum(place, len(at) - 1)] == near)]
        return h[place], at[place]


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _by_hash(t: dict) -> dict[int, dict[bytes, set]]:
    out: dict[int, dict[bytes, set]] = defaultdict(dict)
    for (key, words), items in t.items():
        out[key][words] = items
    return dict(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, columns: list[str], p: Params = Params()) -> DataFrame:
    """``columns`` of every document row (doc_id, text, ...), with n_words, runs (the hit words:
    first, last + 1, and their bytes in the UTF-8 text) and items (ids of the items hit)."""
    bench = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    n_blocks = -(-text_bytes(bench, ["text"]) // p.block_bytes) or 1
    types = {c: docs.schema[c].dataType.simpleString() for c in columns}
    run_type = "array<struct<first:int,last:int,from:int,to:int>>"
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + f", `_words` int, `_runs` {run_type}, `_items` array<bigint>"
    need = list(dict.fromkeys([*columns, "text"]))
    out = None
    for k in range(n_blocks):
        own = bench.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own])
        state: list[Index] = []

        def rows(got: dict[str, list], shared=shared, state=state) -> dict[str, list]:
            if not state:
                state.append(Index(shared.value, p))
            found = list(state[0].hits(got["text"]))
            runs, items = [x[0] for x in found], [x[1] for x in found]
            if "_runs" in got:
                runs = [_union(a, [tuple(x.values()) for x in b]) for a, b in zip(runs, got["_runs"], strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(items, got["_items"], strict=True)]
            dicts = [[dict(zip(("first", "last", "from", "to"), x, strict=True)) for x in r] for r in runs]
            return got | {"_words": [x[2] for x in found], "_runs": dicts, "_items": items}

        more = schema if "text" in columns or k == n_blocks - 1 else f"`text` string, {schema}"
        if out is None:
            out = map_rows(docs, need, more, rows)
        else:
            out = map_rows(out, [*need, "_runs", "_items"], more, rows)
        if k < n_blocks - 1:
            out = cut(out)
    return out


def _union(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Union of two lists of word runs; touching runs become one."""
    out: list[list] = []
    for x in sorted([*a, *b]):
        if out and x[0] <= out[-1][1]:
            if x[1] > out[-1][1]:
                out[-1][1], out[-1][3] = x[1], x[3]
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def _hit_words() -> F.Column:
    return F.aggregate("_runs", F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"]))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Params()
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], p)
    ids = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("_words").cast("long").alias("n_words"),
        _hit_words().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (p.share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, p: Params = Params()) -> DataFrame:
    """Pipeline stage: contaminated documents go; from the others the hit words are cut, so that no
    benchmark window stays in the corpus."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), docs.columns, p)
    n = _hit_words()
    kept = found.filter(~((n > 0) & (p.share * n >= F.col("_words"))))
    # bytes between the runs; run k ends where part k begins
    raw = F.col("text").cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda x: x["to"]))
    ends = F.concat(F.transform("_runs", lambda x: x["from"]), F.array(F.octet_length("text")))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring(raw, a + 1, b - a).cast("string"))
    text = F.when(F.size("_runs") == 0, F.col("text")).otherwise(F.array_join(parts, ""))
    return kept.select(*[(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns])


def window_sql(p: Params = Params()) -> str:
    """The contract of op5 in SQL: every document window of each item length, by a plain join."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
lens AS (SELECT DISTINCT least(len(w), {p.span}) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), {p.span}) AS n,
              unnest([array_to_string(w[i : i + least(len(w), {p.span}) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), {p.span}) + 2)]) AS s
       FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, s)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {p.share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""


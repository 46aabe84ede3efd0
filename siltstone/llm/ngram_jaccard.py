"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word n-grams, 64-bit hashes each. Documents of equal sets are
one class from the start (set digests of 128 bits), so copies cost one row each and no pairs.
Classes are joined exactly:

1. Order. Occurrences of n-grams are counted over all documents (``frequency``). The global order is
   by frequency class (``classes`` gives their bounds), rare ones first, then by hash.
2. Candidates. Two sets with a Jaccard index of at least the threshold share an n-gram among
   their first n - ceil(threshold n) + 1 of that order. Which of those come in several classes
   is counted the same way, so that only these become rows. Pairs pass the size filter, the
   position filter, and a filter by 512 parity bits per set.
3. Counting. The order is cut into ``fragments`` parts that hold about equally many occurrences. A pair
   that is left is counted in each fragment alone, and the partial overlaps are summed per pair:
   rows hold parts of sets, and a pair links if its sum reaches the threshold.

Candidates and counting are in set_join: a group of near copies is linked by its central members
first, then all pairs of different components are made, so components are exact.

Defined results: null texts and texts without words have empty sets and link with nothing; a
text of fewer words than n has its word sequence as its only n-gram; repeated rows are one class; a
null doc_id is no representative; rows that share a doc_id are judged each; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, drop_cut, gathered, small_batches, table
from siltstone.llm.frequency import Table, frequent
from siltstone.llm.set_join import WORDS, digests, is_needed, linked, parities
from siltstone.llm.textkit import gram_sets


@dataclass(frozen=True)
class Params:
    """Two sets link when ``per`` * intersection >= ``least`` * union. ``size``: the tables of frequent
    n-grams have 2^size entries; ``linear``: a round of central sets is made while all pairs are
    more than this for each place, at most ``rounds`` times."""

    n: int = 3
    least: int = 90
    per: int = 100
    fragments: int = 4
    classes: tuple[int, int, int] = (8, 64, 512)
    size: int = 26
    rounds: int = 3
    linear: int = 8


class Order:
    """The global order of n-grams and its fragments."""

    def __init__(self, table: Table, fragments: int) -> None:
        self.table, self.fragments = table, fragments

    def place(self, h: np.ndarray) -> np.ndarray:
        """The place of each n-gram in the order: its frequency class, then its hash."""
        return (self.table.of(h).astype(np.uint64) << np.uint64(62)) | (h >> np.uint64(2))

    def fragment(self, h: np.ndarray) -> np.ndarray:
        """Parts of the order: equal ranges of the rare n-grams, which nearly all are; the frequent
        ones belong to the last part."""
        rare = ((h >> np.uint64(32)) * np.uint64(self.fragments)) >> np.uint64(32)
        return np.where(self.table.of(h) > 0, self.fragments - 1, rare.astype(np.int64))


def order(docs: DataFrame, p: Params) -> Order:
    def grams(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, h, _ in gram_sets(texts.to_pylist(), p.n):
            yield h

    return Order(frequent(docs, ["text"], grams, p.classes, p.size), p.fragments)


def _prefix_lengths(n: np.ndarray, p: Params) -> np.ndarray:
    """0 where every unequal pair misses the threshold."""
    return np.where(p.per * n >= p.least * (n + 1), n + (-p.least * n) // p.per + 1, 0)


def described(docs: DataFrame, by: object, p: Params) -> DataFrame:
    """(doc_id, th, n, sig, prefix, b0..b7) per document row; the prefix is empty where the set can
    link to no other."""
    small_batches(docs.sparkSession)
    kinds = [("doc_id", "bigint", pa.int64()), ("th", "bigint", pa.int64()), ("n", "bigint", pa.int64()), ("sig", "binary", pa.binary()), ("prefix", "array<bigint>", pa.list_(pa.int64())), *[(w, "bigint", pa.int64()) for w in WORDS]]
    out = pa.schema([(name, kind) for name, _, kind in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, bounds in gram_sets(batch.column(2).to_pylist(), p.n):
                n = np.diff(bounds)
                lengths = _prefix_lengths(n, p)
                place = by.value.place(h)
                starts, prefix = np.zeros(len(n) + 1, np.int32), []
                np.cumsum(lengths, out=starts[1:])
                for d in np.flatnonzero(lengths).tolist():
                    a, b, k = bounds[d], bounds[d + 1], int(lengths[d])
                    own = place[a:b]
                    least = np.argpartition(own, k - 1)[:k] if k < b - a else np.arange(k)
                    prefix.append(h[a:b][least[np.argsort(own[least])]])
                flat = np.concatenate(prefix) if prefix else h[:0]
                bits = parities(h, bounds)
                rows = slice(first, first + len(n))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64())[rows], batch.column(1)[rows], pa.array(n), pa.array(digests(h, bounds), pa.binary()), pa.ListArray.from_arrays(pa.array(starts), pa.array(flat.view(np.int64))), *[pa.array(bits[:, i]) for i in range(len(WORDS))]], schema=out)

    return docs.select("doc_id", "th", "text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind, _ in kinds))


def shared_places(nodes: DataFrame, column: str, common: object, extra: str = "") -> DataFrame:
    """(key, node, n, i, c, m): the elements of an array column that c > 1 nodes have, with their
    position from 1. Of m elements that the very same nodes have only the first in the order is kept:
    it is also the first for any two of them that share none before. ``common`` is the table of
    elements that come more than once."""
    out = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("i", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            keys = lists.flatten().to_numpy().view(np.uint64)
            lengths = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(lengths)
            at = np.flatnonzero(common.value.of(keys))
            row = np.searchsorted(ends, at, side="right")
            i = at - (ends - lengths)[row] + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(i)], schema=out)

    own = cut(nodes.select("node", "n", column).mapInArrow(run, "key bigint, node bigint, n bigint, i bigint"))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(name) for seed, name in enumerate("xy")]
    shared = own.groupBy("key").agg(F.count("*").alias("c"), F.min("i").alias("at"), *same).filter("c > 1")
    one = shared.groupBy("c", "x", "y").agg(F.min(F.struct("at", "key")).alias("k"), F.count("*").alias("m"))
    places = cut(own.join(one.select("k.key", "c", "m"), "key"))
    drop_cut(own)
    return places


def segments(docs: DataFrame, needed: np.ndarray, by: object, p: Params) -> DataFrame:
    """(seg, grams): the sets of the texts in the filter ``needed``, by fragment; seg is the set's digest
    and the fragment's number."""
    bits = docs.sparkSession.sparkContext.broadcast(needed)
    small_batches(docs.sparkSession)
    out = pa.schema([("seg", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(is_needed(batch.column(0).to_numpy(), bits.value))).to_pylist()
            for _, h, bounds in gram_sets(texts, p.n):
                part = by.value.fragment(h)
                own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * p.fragments + part
                turn = np.argsort(own, kind="stable")
                edges = np.searchsorted(own[turn], np.arange((len(bounds) - 1) * p.fragments + 1))
                seg = [s + bytes([k]) for s in digests(h, bounds) for k in range(p.fragments)]
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(h[turn].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(seg, pa.binary()), lists], schema=out).filter(pa.array(np.diff(edges) > 0))

    return docs.select("th", "text").mapInArrow(run, "seg binary, grams array<bigint>")


def text_hash(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def with_hash(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th): th is the hash of the text, 0 of null."""
    return docs.select("doc_id", "text", text_hash(F.col("text")).alias("th"))


def classes(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, sig) per document row, and (sig, root) for every class that links to another:
    sets are named by their digests, roots by numbers."""
    sc = docs.sparkSession.sparkContext
    docs = with_hash(docs)
    by = sc.broadcast(order(docs, p))
    raw = cut(described(docs, by, p))
    own = raw.filter(F.size("prefix") > 0).groupBy("sig").agg(F.first(F.struct("th", "n", "prefix", *WORDS)).alias("x"))
    nodes = cut(own.select(F.monotonically_increasing_id().alias("node"), "sig", "x.*").withColumn("size", F.size("prefix")))

    def keys(lists: pa.Array) -> Iterator[np.ndarray]:
        yield lists.flatten().to_numpy().view(np.uint64)

    common = sc.broadcast(frequent(nodes, ["prefix"], keys, (1,), p.size + 1))
    places = shared_places(nodes, "prefix", common)
    common.destroy()
    # prefixes have done their work: what is read from here on is written without them
    rows, narrow = cut(raw.select("doc_id", "th", "n", "sig")), cut(nodes.drop("prefix"))
    drop_cut(raw, nodes)
    labels = linked(places, narrow, lambda needed: segments(docs, needed, by, p), p)
    named = cut(narrow.select("node", "sig").join(labels, "node").select("sig", "root"))
    drop_cut(narrow, places, labels)
    by.destroy()  # what was made with it is written
    return rows, named


def _components(rows: DataFrame, labels: DataFrame, least: Column) -> DataFrame:
    """(sig, best): the least of ``least`` over each component of more than one row."""
    reps = rows.filter("n > 0").groupBy("sig").agg(least.alias("rep"), F.count("*").alias("copies"))
    rooted = reps.join(labels, "sig", "left").filter("copies > 1 or root is not null")
    best = rooted.filter("root is not null").groupBy("root").agg(F.min("rep").alias("best"))
    return cut(rooted.join(best, "root", "left").select("sig", F.coalesce("best", "rep").alias("best")))


def groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document row."""
    rows, labels = classes(docs, p)
    named = _components(rows, labels, F.min("doc_id"))
    return rows.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best", "doc_id").alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


#: The pipeline stage's own threshold; Params' defaults are op6's contract.
STAGE = Params(n=5, least=80)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str, p: Params = STAGE) -> DataFrame:
    """Pipeline stage: of every component at five words and 0.8 the row of least doc_id stays (of
    least text hash where an id has several texts; a null id only where there is no other), once.
    Only rows that go are joined to the documents."""
    rows, labels = classes(docs, p)
    named = _components(rows, labels, F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")))
    own = [F.col("doc_id").alias("_of"), F.col("th").alias("_hash")]
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    gone = gathered(rows.join(named, "sig").filter(~stays).select(*own).distinct())
    again = gathered(rows.groupBy("doc_id", "th").agg(F.count("*").alias("c")).filter("c > 1").select(*own))
    same = docs["doc_id"].eqNullSafe(F.col("_of")) & (text_hash(docs["text"]) == F.col("_hash"))
    left = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return left
    twice = left.join(again, left["doc_id"].eqNullSafe(again["_of"]) & (text_hash(left["text"]) == again["_hash"]), "left_semi")
    return left.join(again, left["doc_id"].eqNullSafe(again["_of"]) & (text_hash(left["text"]) == again["_hash"]), "left_anti").union(twice.dropDuplicates(["doc_id", "text"]))


def jaccard_sql(p: Params = Params()) -> str:
    """The contract of op6 in SQL: all pairs that share an n-gram, then reachability."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {p.n} THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i : i + {p.n - 1}], ' ') FOR i IN range(1, len(w) - {p.n - 2})]) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {p.per} * count(*) >= {p.least} * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(reach.v) AS component_id
FROM s JOIN reach ON reach.u = s.doc_id GROUP BY s.doc_id, len(s.g)"""

"""Substring dedup: short paragraphs that come again, word for word or nearly, are found and removed.

Paragraphs don't depend on line breaks. A text is cut at content-defined places: in every run of
``window`` words there is a cut, after a word that ends a sentence if the run has one, else after the word
of least hash. Parts of fewer than ``min_words`` words join the part that follows. So a passage that
stands in two texts is cut alike in both, but for its first and last part; one of over 50 words
has whole paragraphs inside, whatever stands around it.

Equal paragraphs (the same set of five-word shingles) are one class from the start, however many copies
there are. Each class has ``bands`` keys of ``rows`` MinHash values; with 12 bands of 3, two paragraphs of
similarity 0.8 meet in some band with probability 1 - (1 - 0.8^3)^12 > 0.9998. Which keys come
again is counted first (``frequency``), so only paragraphs with such a key become rows. Colliding
paragraphs are verified by their exact Jaccard index and clustered by components (set_join makes
no pairs of a whole group at once). In each cluster the first occurrence, by doc_id and place,
stays; the others are removed.

A row is a paragraph to remove: ``start`` and ``end`` count the characters of the text from 0, without the
white space around the paragraph.

Defined results: null and empty texts have no paragraphs; a text of fewer than ``min_words`` words,
or what is left of that length at the end of a text, is no paragraph and stays; repeated rows of one
doc_id and text are one occurrence; texts that share a doc_id count each; a null doc_id comes last;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, drop_cut, small_batches, table
from siltstone.llm.frequency import frequent
from siltstone.llm.ngram_jaccard import shared_places, text_hash, with_hash
from siltstone.llm.set_join import digests, is_needed, linked, parities
from siltstone.llm.textkit import NOT_SPACE, Words, blocks, mix


@dataclass(frozen=True)
class Params:
    """Paragraphs link when ``per`` * intersection >= ``least`` * union of their shingles. ``size``, ``rounds``
    and ``linear`` are as in ngram_jaccard."""

    n: int = 5
    window: int = 20
    min_words: int = 8
    bands: int = 12
    rows: int = 3
    least: int = 80
    per: int = 100
    rounds: int = 3
    fragments: int = 1
    linear: int = 8
    size: int = 27


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` elements."""
    f, have = (np.minimum if least else np.maximum), 1
    while 2 * have <= width:
        x, have = f(x[:-have], x[have:]), 2 * have
    return f(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _cuts(w: Words, width: int) -> np.ndarray:
    """Whether a cut follows each word: it is the most preferred one of some run of ``width`` words."""
    count = len(w) - width + 1
    chosen = np.zeros(len(w), dtype=bool)
    if count <= 0:
        return chosen
    last, before = w.data[w.end - 1], w.data[np.maximum(w.end - 2, 0)]
    shut = np.isin(last, np.frombuffer(b"\"')]", np.uint8)) & (w.end - w.start > 1)
    stop = np.isin(np.where(shut, before, last), np.frombuffer(b".!?", np.uint8))
    key = (mix(w.hash + np.uint64(7)) >> np.uint64(1)) | (~stop).astype(np.uint64) << np.uint64(63)
    low = _sliding(key, width, least=True)
    low[w.doc[:count] != w.doc[width - 1 :]] = 0  # runs end with their text
    edge = np.zeros(width - 1, dtype=np.uint64)
    return (_sliding(np.concatenate([edge, low, edge]), width, least=False) == key) & (key > 0)


class Paragraphs:
    """The paragraphs of a block of texts: ``doc``, words ``start`` to ``end``, and their shingles,
    grams[a[k]:b[k]]."""

    def __init__(self, run: list[bytes], p: Params) -> None:
        self.words = w = Words(run, NOT_SPACE)
        filled = w.first[1:][np.diff(w.first) > 0]
        ends = np.union1d(np.flatnonzero(_cuts(w, p.window)) + 1, filled)
        long = np.diff(ends, prepend=0) >= p.min_words
        ends = ends[long | np.isin(ends, filled)]
        start = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        keep = ends - start >= max(p.min_words, p.n)
        self.start, self.end = start[keep], ends[keep]
        self.doc = w.doc[self.start]
        self.grams, at = w.grams(p.n)
        self.a, self.b = np.searchsorted(at, self.start), np.searchsorted(at, self.end - p.n + 1)

    def keys(self, p: Params) -> np.ndarray:
        """A row of ``bands`` keys for each paragraph."""
        keys = np.zeros((len(self.start), p.bands), dtype=np.uint64)
        if not len(self.start):
            return keys
        bounds = np.stack([self.a, self.b], axis=1).ravel()
        for b in range(p.bands):
            k = np.full(len(self.start), b + 1, dtype=np.uint64)
            for seed in _SEEDS[b * p.rows : (b + 1) * p.rows]:
                values = np.append(self.grams * seed, np.uint64(0))
                k = mix(k * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(values, bounds)[::2])
            keys[:, b] = k
        return keys

    def sets(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of the chosen paragraphs, one after another, and their bounds."""
        a, b = self.a[chosen], self.b[chosen]
        bounds = np.concatenate([[0], np.cumsum(b - a)])
        h = self.grams[np.arange(bounds[-1]) + np.repeat(a - bounds[:-1], b - a)]
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            h[x:y].sort()
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = h[1:] != h[:-1]
        keep[bounds[:-1]] = True
        return h[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]

    def spans(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 character, in their texts, of the chosen paragraphs."""
        w = self.words
        upto = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        base = upto[w.offset[self.doc[chosen]]]
        return upto[w.start[self.start[chosen]]] - base, upto[w.end[self.end[chosen] - 1]] - base


#: Odd factors; the least product modulo 2^64 of hashes and one of them is a MinHash value.
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def paragraphs(texts: list[str | None], p: Params) -> Iterator[tuple[int, Paragraphs]]:
    """(index of the first text, paragraphs) of each block of texts."""
    for first, run in blocks(texts):
        yield first, Paragraphs(run, p)


def candidates(docs: DataFrame, again: object, p: Params) -> DataFrame:
    """(doc_id, th, start, end, n_words, sig, n, b0, keys) of the paragraphs with keys that come again, and
    those keys."""
    small_batches(docs.sparkSession)
    kinds = [("doc_id", "bigint", pa.int64()), ("th", "bigint", pa.int64()), ("start", "int", pa.int32()), ("end", "int", pa.int32()), ("n_words", "int", pa.int32()), ("sig", "binary", pa.binary()), ("n", "bigint", pa.int64()), ("b0", "bigint", pa.int64()), ("keys", "array<bigint>", pa.list_(pa.int64()))]
    out = pa.schema([(name, kind) for name, _, kind in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, own in paragraphs(batch.column(2).to_pylist(), p):
                keys = own.keys(p)
                known = again.value.of(keys) > 0
                chosen = np.flatnonzero(known.any(axis=1))
                if not len(chosen):
                    continue
                h, bounds = own.sets(chosen)
                start, end = own.spans(chosen)
                row = pa.array(first + own.doc[chosen])
                offsets = np.concatenate([[0], np.cumsum(known[chosen].sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[chosen][known[chosen]].view(np.int64)))
                words = (own.end - own.start)[chosen]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x.astype(np.int32)) for x in (start, end, words)), pa.array(digests(h, bounds), pa.binary()), pa.array(np.diff(bounds)), pa.array(parities(h, bounds, 1)[:, 0]), lists], schema=out)

    return docs.select("doc_id", "th", "text").mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind, _ in kinds))


def shingles(docs: DataFrame, needed: np.ndarray, p: Params) -> DataFrame:
    """(seg, grams): the sets of the paragraphs of the texts in the filter ``needed``."""
    bits = docs.sparkSession.sparkContext.broadcast(needed)
    small_batches(docs.sparkSession)
    out = pa.schema([("seg", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(is_needed(batch.column(0).to_numpy(), bits.value))).to_pylist()
            for _, own in paragraphs(texts, p):
                h, bounds = own.sets(np.arange(len(own.start)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([s + b"\0" for s in digests(h, bounds)], pa.binary()), lists], schema=out)

    return docs.select("th", "text").mapInArrow(run, "seg binary, grams array<bigint>")


def repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, th, start, end, n_words, kept_doc_id, kept_start): every paragraph to remove, with the hash
    of its text, and the place of the one that stays."""
    docs, sc = with_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), docs.sparkSession.sparkContext

    def keys(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, own in paragraphs(texts.to_pylist(), p):
            yield own.keys(p).ravel()

    again = sc.broadcast(frequent(docs, ["text"], keys, (1,), p.size))
    found = cut(candidates(docs, again, p))
    again.destroy()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "th")
    own = found.groupBy("sig").agg(F.first(F.struct("th", "n", "b0", "keys")).alias("x"), F.min(place).alias("place"), F.count("*").alias("copies"))
    nodes = cut(own.select(F.monotonically_increasing_id().alias("node"), "sig", "x.*", "place", "copies").withColumn("size", F.lit(p.bands)))

    def listed(lists: pa.Array) -> Iterator[np.ndarray]:
        yield lists.flatten().to_numpy().view(np.uint64)

    common = sc.broadcast(frequent(nodes, ["keys"], listed, (1,), p.size))
    places = shared_places(nodes, "keys", common)
    common.destroy()
    labels = linked(places.withColumn("i", F.lit(1).cast("long")), nodes.select("node", "sig", "th", "n", "b0", "size"), lambda needed: shingles(docs, needed, p), p)
    clusters = nodes.select("node", "sig", "place", "copies").join(labels, "node", "left").withColumn("cluster", F.coalesce("root", "node")).filter("copies > 1 or root is not null")
    first = clusters.groupBy("cluster").agg(F.min("place").alias("kept"))
    named = cut(clusters.join(first, "cluster").select("sig", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), F.col("kept.th").alias("kept_th")))
    drop_cut(nodes, places, labels)
    other = ~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start")) & (F.col("th") == F.col("kept_th")))
    return found.join(named, "sig").filter(other).select("doc_id", "th", "start", "end", "n_words", "kept_doc_id", "kept_start").distinct()


def remove(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` without the paragraphs in ``repeated``, and without the white space
    that follows them."""
    spans = repeated.groupBy(F.col("doc_id").alias("_of"), F.col("th").alias("_hash")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_of"]) & (text_hash(docs["text"]) == spans["_hash"]), "left")

    @F.udf("string")
    def without(text: str | None, spans: list) -> str | None:
        if text is None or not spans:
            return text
        out, at = [], 0
        for s, e in spans:
            out.append(text[at:s])
            while e < len(text) and text[e].isspace():
                e += 1
            at = max(at, e)
        return "".join([*out, text[at:]])

    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(without("text", "_spans"))
    return joined.select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))

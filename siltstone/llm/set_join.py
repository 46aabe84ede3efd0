"""Exact links between sets that share a key, without all pairs of a group.

Sets are nodes with 64-bit numbers; ``sig`` is a set's 128-bit digest, and ``n`` its number of
elements, 64-bit hashes. ``places`` has a row (key, node, n, i, c, m) for every node at every key that
c > 1 nodes share, where a key stands for m keys of the very same nodes; a key may be an n-gram, with
i its position in the set's order, or a band of MinHash values, with i = 1. Links are pairs with
``per`` * intersection >= ``least`` * union.

A group of g similar sets has g * g pairs, of which connectivity needs few. So while all pairs
would be many (``linear`` a place, with a key counted m times), a round is made first: for each crowded key and size class the
most central set without a link (whose keys are most shared) is paired with the others; what links
is merged into components. At the end all pairs of different components are made, so no link
between components is lost. A key of many sets is dealt out in blocks, each block of it against
all, so no task gets all pairs of a key. Rounds end
when one leaves more than half of the pairs.

Before a pair is counted it passes filters that no link fails: sizes, positions, and parity
bits per set (64 for small sets, else 512), whose difference in bits is at most the difference of the sets. Counting is by
fragments of the sets, partial overlaps summed per pair; sets are made again from their texts by
``sets_of(needed)``, where ``needed`` is a bit filter of fixed size over the hashes of texts, so
other texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, drop_cut
from siltstone.llm.components import components
from siltstone.llm.textkit import mix, sums

BITS = 8  # 64-bit words of the parity filter
WORDS = [f"b{i}" for i in range(BITS)]
NEEDED = 24  # leading bits that the filter of texts tells apart
BLOCK = 512  # places of a key in a block
CROWD = 4  # places of a key, beyond which they carry parity bits
SMALL = 160_000  # nodes that may be broadcast, of 200 bytes at most: 32 MB


def digests(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Digest of each run h[bounds[d]:bounds[d+1]], a set of hashes: its size and two independent
    sums, mixed."""
    n = np.diff(bounds).astype(np.uint64)
    a = mix(sums(mix(h + np.uint64(0x51)), bounds) + n)
    b = mix(sums(mix(h ^ np.uint64(0xA076_1D64_78BD_642F)), bounds) ^ n)
    both = np.ascontiguousarray(np.stack([a, b], axis=1)).tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def parities(h: np.ndarray, bounds: np.ndarray, words: int = BITS) -> np.ndarray:
    """A row of words for each set; bit i is the parity of the number of elements on it."""
    sets, wide = len(bounds) - 1, 64 * words
    own = np.repeat(np.arange(sets), np.diff(bounds))
    at = (mix(h ^ np.uint64(0xD6E8_FEB8_6659_FD93)) % np.uint64(wide)).astype(np.int64)
    odd = (np.bincount(own * wide + at, minlength=sets * wide) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(sets, words)


def needed_texts(hashes: DataFrame) -> np.ndarray:
    """Bits of the leading NEEDED bits of every ``th``."""
    at = hashes.select(F.expr(f"cast(shiftrightunsigned(th, {64 - NEEDED}) as int)").alias("h"))
    words = at.groupBy(F.shiftright("h", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, h & 31))").alias("x")).toArrow()
    out = np.zeros(1 << (NEEDED - 5), dtype=np.uint32)
    out[words["w"].to_numpy()] = words["x"].to_numpy()  # at most 2^(NEEDED - 5) rows
    return out


def is_needed(th: np.ndarray, needed: np.ndarray) -> np.ndarray:
    at = th.view(np.uint64) >> np.uint64(64 - NEEDED)
    return (needed[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def reaches(overlap: Column, p) -> Column:
    """Whether the overlap is enough for sets of na and nb elements."""
    return (p.per + p.least) * overlap >= p.least * (F.col("na") + F.col("nb"))


def near_enough(p) -> Column:
    """Size and position filters of a candidate (na, nb, ia, ib)."""
    na, nb = F.col("na"), F.col("nb")
    size = p.per * F.least(na, nb) >= p.least * F.greatest(na, nb)
    return size & reaches(1 + F.least(na - F.col("ia"), nb - F.col("ib")), p)


def parity_allows(p, words: int) -> Column:
    """Parity filter of a pair (na, nb, pa0.., pb0..): overlap <= (na + nb - difference) / 2."""
    differ = sum((F.bit_count(F.col(f"pa{i}").bitwiseXOR(F.col(f"pb{i}"))) for i in range(1, words)), F.bit_count(F.col("pa0").bitwiseXOR(F.col("pb0"))))
    size = F.col("na") + F.col("nb")
    return (p.per + p.least) * (size - differ) >= 2 * p.least * size


def _side(rows: DataFrame, s: str, *keep: str | Column) -> DataFrame:
    return rows.select(*keep, F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("i").alias(f"i{s}"))


class _Join:
    """The steps over one set of nodes (node, sig, th, b0, ...)."""

    def __init__(self, nodes: DataFrame, sets_of: Callable[[np.ndarray], DataFrame], p) -> None:
        self.nodes, self.sets_of, self.p = nodes, sets_of, p
        self.small = nodes.count() <= SMALL
        self.bits = [w for w in WORDS if w in nodes.columns]
        self.tried: DataFrame | None = None
        self.links: DataFrame | None = None
        self.made: list[DataFrame] = []

    def side(self, df: DataFrame) -> DataFrame:
        """A table of one row a node at most, broadcast where there are few nodes."""
        return F.broadcast(df) if self.small else df

    def words(self, s: str) -> list[Column]:
        return [F.col(w).alias(f"p{s}{i}") for i, w in enumerate(self.bits)]

    def keep(self, df: DataFrame) -> DataFrame:
        self.made.append(df := cut(df))
        return df

    def pairs(self, candidates: DataFrame) -> DataFrame:
        """(a, b, na, nb, sa, sb, ta, tb): each candidate once with a < b, with the digests and hashes of
        texts, unless it was counted before or the parity bits rule it out."""
        low, high = (f(F.struct("a", "na"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"))) for f in (F.least, F.greatest))
        once = candidates.select(low.alias("x"), high.alias("y")).distinct().select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x.na").alias("na"), F.col("y.na").alias("nb"))
        if self.tried is not None:
            once = once.join(self.tried, ["a", "b"], "left_anti")
        # names alone tell the two sides apart, so Spark broadcasts them once
        a, b = (self.nodes.select(F.col("node").alias(s), F.col("sig").alias(f"s{s}"), F.col("th").alias(f"t{s}"), *self.words(s)) for s in "ab")
        both = once.join(self.side(a), "a").join(self.side(b), "b")
        return self.keep(both.filter(parity_allows(self.p, len(self.bits))).select("a", "b", "na", "nb", "sa", "sb", "ta", "tb"))

    def count(self, pairs: DataFrame) -> bool:
        """Counts the pairs and adds those that link to the links; whether there are any. The sets are
        those of the pairs' ends, by fragment: (seg, grams), where seg is a set's digest and the
        number of a fragment."""
        p = self.p
        needed = needed_texts(pairs.select(F.explode(F.array("ta", "tb")).alias("th")))
        stored = self.keep(self.sets_of(needed).groupBy("seg").agg(F.first("grams").alias("grams")))
        parts = pairs.select("a", "b", "na", "nb", "sa", "sb", F.explode(F.array(*[F.lit(bytes([k])) for k in range(p.fragments)])).alias("k"))
        left = stored.select(F.col("seg").alias("sa"), F.col("grams").alias("ga"))
        right = stored.select(F.col("seg").alias("sb"), F.col("grams").alias("gb"))
        both = parts.withColumn("sa", F.concat("sa", "k")).join(left, "sa").withColumn("sb", F.concat("sb", "k")).join(right, "sb")
        partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"))
        new = self.keep(partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")).filter(reaches(F.col("o"), p)).select(F.col("a").alias("u"), F.col("b").alias("v")))
        own = pairs.select("a", "b")
        self.tried = own if self.tried is None else self.tried.union(own)
        if new.isEmpty():
            return False
        self.links = new if self.links is None else self.links.union(new)
        return True

    def round(self, known: DataFrame) -> bool:
        """In each key and size class of ``known`` the most central set without a link meets the others;
        whether that brought a link."""
        best = known.filter(F.col("root") == F.col("node")).groupBy("key", "k").agg(F.max(F.struct("w", "node", "n", "i")).alias("x")).select("key", "k", "x.*")
        hubs = _side(best, "a", "key", F.explode(F.array(F.col("k") - 1, "k", F.col("k") + 1)).alias("k"))
        others = _side(known, "b", "key", "k", F.col("root").alias("rb"))
        pairs = self.pairs(others.join(hubs, ["key", "k"]).filter((F.col("a") != F.col("rb")) & near_enough(self.p)))
        return not pairs.isEmpty() and self.count(pairs)

    def all_pairs(self, few: DataFrame, known: DataFrame) -> DataFrame:
        """Candidates of different roots at the keys of ``few``, of CROWD places at most, and of ``known``
        (key, node, n, i, root, c). The latter carry the parity bits, so that pairs which these rule
        out are never made; the former too, if there is one word of them."""
        wide = self.side(self.nodes.select("node", *self.bits))
        made = self._at_keys(known.join(wide, "node"), True)
        return made.union(self._at_keys(few.join(wide, "node"), True) if len(self.bits) == 1 else self._at_keys(few, False))

    def _at_keys(self, known: DataFrame, bits: bool) -> DataFrame:
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        left = _side(known, "a", "key", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.col("root").alias("ra"), *(self.words("a") if bits else []))
        right = _side(known, "b", "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("root").alias("rb"), *(self.words("b") if bits else []))
        fits = (F.col("ra") < F.col("rb")) & near_enough(self.p)
        return left.join(right, ["key", "block"]).filter(fits & parity_allows(self.p, len(self.bits)) if bits else fits).select("a", "na", "b", "nb")


def _mixed(places: DataFrame, labels: DataFrame) -> DataFrame:
    """Places (key, node, n, i, c, root) at keys that hold more than one component, with c the
    places there now."""
    rooted = places.drop("c").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c")).filter("x <> y").select("key", "c")
    return rooted.join(mixed, "key")


def linked(places: DataFrame, nodes: DataFrame, sets_of: Callable[[np.ndarray], DataFrame], p) -> DataFrame:
    """(node, root) of every node that links to another. ``nodes`` has (node, sig, th, size, b0, ...): size
    is the number of the node's keys, th the hash of a text that has the set."""
    join, labels = _Join(nodes, sets_of, p), None
    step, rooted = float(np.log(p.per / p.least)), places.withColumn("root", F.col("node"))
    # at keys of few places all pairs are made anyway, so only the others follow the components
    few, many = rooted.filter(F.col("c") <= CROWD), rooted.filter(F.col("c") > CROWD)
    known = many
    n, pairs = places.agg(F.sum("m"), F.sum(F.col("m") * (F.col("c") - 1) / 2)).first()
    for _ in range(p.rounds):
        if not n or pairs <= p.linear * n:
            break
        crowded = known.filter(F.col("c") > p.linear)
        weight = crowded.groupBy("node").agg(F.sum(F.col("m") * F.log2("c")).alias("w")).join(join.side(nodes.select("node", "size")), "node").select("node", (F.col("w") / F.col("size")).cast("float").alias("w"))
        hot = join.keep(crowded.join(join.side(weight), "node").withColumn("k", F.floor(F.log("n") / step).cast("int")))
        if not join.round(hot):
            break
        labels = cut(components(join.links))
        join.made.append(labels)
        known = join.keep(_mixed(many.drop("root"), join.side(labels)))
        apart = known.groupBy("key", "root").agg(F.count("*").alias("r"), F.first("c").alias("c"), F.first("m").alias("m"))
        left = apart.agg(F.sum(F.col("m") * F.col("r") * (F.col("c") - F.col("r")) / 2)).first()[0]
        if left and 2 * left > pairs:  # few are left that another round would link
            break
        pairs = left or 0
    rest = join.pairs(join.all_pairs(few, known))
    if not rest.isEmpty() and join.count(rest) or labels is None:
        labels = cut(components(join.links if join.links is not None else rest.select(F.col("a").alias("u"), F.col("b").alias("v")).limit(0)))
    else:
        labels = cut(labels)
    drop_cut(*join.made)
    return labels

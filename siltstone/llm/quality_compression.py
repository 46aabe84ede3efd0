"""Quality classifier by compression: two Zstandard dictionaries, one of good and one of bad
labelled text, price every whole text; the normalised size difference becomes a calibrated score.

Only differences of the two sizes enter the score: how well a text compresses by itself doesn't. A short
text shows little of either, so its log-odds are drawn towards those of the labels' shares.
Texts are priced in short parts, since a long one would be its own dictionary and hide the
difference. A dictionary holds a short piece of as many labelled texts as fit.

Fitting sees a bounded sample of the labelled rows (``Params``): the dictionaries come from one
half of it, the calibration from the other, so that no text is priced by a dictionary that
contains it. Scoring is one pass over all rows without a shuffle; the model is about 130 KB.

Defined results: a null or empty text is scored like any other (all sizes are of the empty
string); without rows of both labels the score is the share of label 1, or 0.5 without labels;
repeated rows are scored each; further columns of the input stay untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import map_rows, small_batches, table


@dataclass(frozen=True)
class Params:
    """``per_class`` labelled texts of at most ``max_bytes`` bytes are the most that fitting
    reads, the smallest hashes of doc_id first; ``dict_bytes`` bounds a dictionary, to which a text
    gives ``piece`` bytes or its equal share. All parts of ``part`` bytes of a text are priced. A text of
    ``evidence`` bytes stands half by itself, half by the labels' shares."""

    per_class: int = 1500
    max_bytes: int = 16_384
    dict_bytes: int = 65_536
    piece: int = 64
    part: int = 256
    level: int = 6
    evidence: int = 128
    ridge: float = 1e-3
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    prior: float
    p: Params

    def scorer(self):
        """A function from text to score; it holds the two digested dictionaries."""
        if not self.good:
            return lambda text: self.weights[0]
        features = _pricer(self.good, self.bad, self.p)
        w, mean, scale = (np.array(x) for x in (self.weights, self.mean, self.scale))

        def score(text: str | None) -> float:
            own = float(w[0] + ((np.array(features(text)) - mean) / scale) @ w[1:])
            n = len((text or "").encode("utf-8", "surrogatepass"))
            z = (n * own + self.p.evidence * self.prior) / (n + self.p.evidence)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _pricer(good: bytes, bad: bytes, p: Params):
    """Text to features: the difference of its compressed sizes with either dictionary, as a share of
    their sum, that times its absolute value, and the difference for each byte of the text."""
    packers = []
    for content in (good, bad):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=p.level)
        packers.append(zstandard.ZstdCompressor(dict_data=d, level=p.level, write_content_size=False))

    def features(text: str | None) -> tuple[float, float, float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts = [raw[i : i + p.part] for i in range(0, len(raw), p.part)] or [b""]
        g, b = (sum(len(c.compress(x)) for x in parts) for c in packers)
        share = (b - g) / (b + g)
        return share, share * abs(share), (b - g) / (len(raw) + 16)

    return features


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def sample(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[list[tuple[str, int]], float]:
    """The bounded training sample as (text, label), in a fixed order, and the share of label 1 among all
    learnable labels: about ``per_class`` labelled
    ids of each class by a hash threshold, at most twice as many, then their texts. Only ids, whose
    number is bounded, are broadcast; no text is shuffled."""
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    ids = labels.select("doc_id", F.col("quality").cast("int").alias("label")).dropna().filter(learnable())
    counts = {r["label"]: r["count"] for r in ids.filter(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    taken = [ids.filter((F.col("label") == k) & (draw < int(min(1, p.per_class / n) * (1 << 30)))).limit(2 * p.per_class) for k, n in counts.items()]
    if not taken:
        return [], 0.5
    chosen = F.broadcast(reduce(DataFrame.unionByName, taken))
    rows = (
        docs.select("doc_id", "text").filter(F.octet_length("text") <= p.max_bytes).join(chosen, "doc_id")
        .select("label", "text", draw.alias("h")).limit(4 * p.per_class).collect()
    )
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["label"], r["h"], r["text"]))], counts.get(1, 0) / sum(counts.values())


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Dictionaries and calibration from the bounded sample of learnable labelled rows."""
    rows, share = sample(docs, labels, p)
    groups = [[t for t, k in rows if k == label] for label in (0, 1)]
    if min(map(len, groups)) < 4:
        return Model(b"", b"", (share,), (), (), 0.0, p)
    shared = Counter(line for t, _ in rows for line in set(t.split("\n")))
    own = [["\n".join(x for x in t.split("\n") if shared[x] < 2) for t in g[0::2]] for g in groups]
    bad, good = (_dictionary(g, p) for g in own)
    features = _pricer(good, bad, p)
    x = np.array([features(t) for g in groups for t in g[1::2]])
    y = np.repeat([0.0, 1.0], [len(g[1::2]) for g in groups])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = _logistic((x - mean) / scale, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), p.ridge)
    return Model(good, bad, tuple(weights), tuple(mean), tuple(scale), math.log(share / (1 - share)), p)


def _dictionary(texts: list[str], p: Params) -> bytes:
    """The middle of each text, in the sample's order, until the dictionary is full. The caller has
    removed lines that several texts share: boilerplate tells nothing about quality, but would
    compress to nothing."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts if t.strip()]
    each = max(p.piece, p.dict_bytes // max(1, len(raw)) - 1)
    pieces = [x[(len(x) - each) // 2 :][:each] if len(x) > each else x for x in raw]
    return b"\n".join(pieces)[: p.dict_bytes] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; intercept first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge * len(x))
    pull[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model, columns: list[str], p: Params = Params()) -> DataFrame:
    """``columns`` of every row, with score and predicted; a map over partitions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: list = []

    def rows(got: dict[str, list]) -> dict[str, list]:
        if not state:
            state.append(shared.value.scorer())
        s = [state[0](t) for t in got["text"]]
        return got | {"score": s, "predicted": [int(v >= p.threshold) for v in s]}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_rows(docs, list(dict.fromkeys([*columns, "text"])), f"{schema}, score double, predicted int", rows)


def op10_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, p: Params = Params()) -> DataFrame:
    """Pipeline stage: rows of ``docs`` whose score reaches the threshold, with all columns."""
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels"), p))
    state: list = []
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(shared.value.scorer())
        for batch in batches:
            keep = [state[0](t) >= p.threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(spark)
    return docs.mapInArrow(run, docs.schema)

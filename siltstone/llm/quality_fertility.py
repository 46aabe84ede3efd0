"""Quality rules on how public vocabularies split a text: tokeniser fertility.

Three figures of every whole text. Characters per token and token entropy (as a share of the largest
that so many tokens can have) are those of a byte-level vocabulary for many languages. The
byte-fallback share is that of a piece vocabulary which spells characters it doesn't have in
bytes: the share of such characters among all but white space. Text in another language than it
claims, symbol soup, tables and loops leave the usual range of one of them.

The rejection bands come from the corpus itself, for each language, or for each script where a
language has fewer than ``min_docs`` usable documents, or for all documents together where the
script has fewer too: median plus or minus a multiple of the interquartile range, at least
``floor``. The quartiles are exact on a grid of 1/1000 and counted over all documents that pass
the base rules; counts are aggregated before the shuffle, so a language that holds most rows costs
no more than another.

Base rules: fewer than 50 words, or more than half of the words in repeated three-word windows.
Defined results: null texts have no words and fail; repeated rows are judged each; a null
language goes by script; where no document passes the base rules there are no bands, and none
are kept; columns beside doc_id, text and lang are not read.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, map_rows, table
from siltstone.llm.textkit import NOT_SPACE, Words, blocks


@dataclass(frozen=True)
class Params:
    """``bands``: metric to (interquartile ranges below and above the median, least half-width)."""

    tokenizers: str = "/opt/tokenizers"
    vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    pieces: str = "piece_bpe_32k.model"
    min_words: int = 50
    min_docs: int = 50
    bands: tuple[tuple[str, float, float, float], ...] = (
        ("chars_per_token", 6.0, 6.0, 0.3),
        ("byte_share", 6.0, 6.0, 0.01),
        ("entropy_share", 2.5, 4.0, 0.15),
    )


#: Lead bytes of UTF-8 by script, coarse; ASCII letters count as Latin.
SCRIPTS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF],
    "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "hebrew_arabic": [0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xDB],
    "indic": [0xE0],
    "east_asian": [*range(0xE3, 0xEE)],
}
#: Bands whose limits may be broadcast, of a kilobyte each.
MOST_BANDS = 10_000
SYMBOLS = [ord(c) for c in "#*$%&|<>"]


class Vocabulary:
    """A byte-level vocabulary of ranks, and the characters that a piece vocabulary has."""

    def __init__(self, ranks_path: str, pieces_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        model = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.spelt = np.ones(0x110000, dtype=bool)  # characters that no piece holds alone
        self.spelt[[ord(x) for x in pieces if len(x) == 1]] = False
        self.blank = np.zeros(0x110000, dtype=bool)
        self.blank[[c for c in range(0x3001) if chr(c).isspace()]] = True

    def figures(self, text: str) -> tuple[float, float, float]:
        """Characters per token, byte-fallback share, entropy share; zeros for no text."""
        ids = np.asarray(self.encoding.encode_ordinary(text), dtype=np.int64)
        if not len(ids):
            return 0.0, 0.0, 0.0
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        seen = chars[~self.blank[chars]]
        p = np.unique(ids, return_counts=True)[1] / len(ids)
        entropy = float(-(p * np.log2(p)).sum())
        return len(text) / len(ids), float(self.spelt[seen].mean()) if len(seen) else 0.0, entropy / math.log2(max(2, len(ids)))


def base_figures(texts: list[str | None]) -> list[dict]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and script of each text."""
    out = []
    for _, run in blocks(texts):
        w = Words(run, NOT_SPACE, lower=False)
        start_of_char = (w.data & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(start_of_char)))
        word_chars = np.concatenate(([0], np.cumsum(chars[w.end] - chars[w.start])))
        h, at = w.grams(3)
        bounds = np.searchsorted(at, w.first)
        for d, raw in enumerate(run):
            a, b = int(w.first[d]), int(w.first[d + 1])
            counts = np.bincount(w.data[w.offset[d] : w.offset[d] + len(raw)], minlength=256)
            own, where = h[bounds[d] : bounds[d + 1]], at[bounds[d] : bounds[d + 1]] - a
            repeated = np.zeros(b - a + 1, dtype=np.int64)
            if len(own):
                _, inverse, n = np.unique(own, return_inverse=True, return_counts=True)
                twice = where[n[inverse] > 1]
                np.add.at(repeated, twice, 1)
                np.add.at(repeated, twice + 3, -1)
            seen: set[bytes] = set()
            dup = 0
            for line in raw.split(b"\n"):
                if line in seen:
                    dup += bool(line.strip(b" \t\n\x0b\x0c\r"))
                seen.add(line)
            scripts = {k: int(counts[v].sum()) for k, v in SCRIPTS.items()}
            best = max(scripts, key=lambda k: scripts[k])
            out.append(
                {
                    "n_words": b - a, "word_chars": int(word_chars[b] - word_chars[a]), "n_symbols": int(counts[SYMBOLS].sum()),
                    "n_dup_lines": dup, "n_repeat_words": int((np.cumsum(repeated)[: b - a] > 0).sum()), "script": best if scripts[best] else "none",
                }
            )
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Figures of every row: doc_id, lang, script, the counts and the three token figures."""
    state: list[Vocabulary] = []
    paths = [f"{p.tokenizers}/{name}" for name in (p.vocabulary, p.pieces)]

    def rows(got: dict[str, list]) -> dict[str, list]:
        if not state:
            state.append(Vocabulary(*paths))
        base = base_figures(got["text"])
        tokens = [state[0].figures(t or "") for t in got["text"]]
        out = {"doc_id": got["doc_id"], "lang": got["lang"]} | {c: [x[c] for x in base] for c in ("script", *COUNTS)}
        return out | {m[0]: [t[i] for t in tokens] for i, m in enumerate(p.bands)}

    schema = "doc_id bigint, lang string, script string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", " + ", ".join(f"{m[0]} double" for m in p.bands)
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    return map_rows(docs, ["doc_id", "text", "lang"], schema, rows)


def base_failed(p: Params = Params()) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(figures: DataFrame, p: Params = Params()) -> DataFrame:
    """(band, metric, low, high) for every language and script of enough documents, and for all
    documents."""
    names = [m[0] for m in p.bands]
    cells = (
        figures.filter(~base_failed(p))
        .select(F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"), F.lit("all"))).alias("band"), *names)
        .filter(F.col("band").isNotNull())
        .select("band", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(n) * 1000).cast("long").alias("bin")) for n in names])).alias("m"))
        .groupBy("band", "m.metric", "m.bin").agg(F.count("*").alias("n"))
    )
    whole = Window.partitionBy("band", "metric")
    ranked = cells.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("total", F.sum("n").over(whole))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin"))) / 1000
    found = ranked.groupBy("band", "metric").agg(F.max("total").alias("docs"), *[quartile(q).alias(f"q{q}") for q in (1, 2, 3)]).filter((F.col("docs") >= p.min_docs) | (F.col("band") == "all"))
    below, above, floor = (F.create_map(*[F.lit(x) for m in p.bands for x in (m[0], float(m[k]))])[F.col("metric")] for k in (1, 2, 3))
    spread = F.col("q3") - F.col("q1")
    return found.select("band", "metric", (F.col("q2") - F.greatest(below * spread, floor)).alias("low"), (F.col("q2") + F.greatest(above * spread, floor)).alias("high"))


def judge(figures: DataFrame, p: Params = Params()) -> DataFrame:
    """Figures with base_failed, kept, and the names of the bands left."""
    limits = cut(bands(figures, p).groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("limits")))  # a value a metric
    few = limits.count() <= MOST_BANDS
    own = lambda key, to: (F.broadcast if few else lambda t: t)(limits.select(F.col("band").alias(key), F.col("limits").alias(to)))
    joined = (
        figures.withColumn("_lb", F.concat(F.lit("lang:"), "lang")).withColumn("_sb", F.concat(F.lit("script:"), "script")).withColumn("_ab", F.lit("all"))
        .join(own("_lb", "_ll"), "_lb", "left").join(own("_sb", "_sl"), "_sb", "left")
        .join(F.broadcast(limits.filter("band = 'all'").select(F.col("band").alias("_ab"), F.col("limits").alias("_al"))), "_ab", "left")  # one row
        .withColumn("_limits", F.coalesce("_ll", "_sl", "_al"))
    )
    out = [F.when((F.col(m[0]) < F.col("_limits")[m[0]]["low"]) | (F.col(m[0]) > F.col("_limits")[m[0]]["high"]), m[0]) for m in p.bands]
    left = F.array_compact(F.array(*out))
    return joined.select(
        *[f"`{c}`" for c in figures.columns], base_failed(p).alias("base_failed"), (~base_failed(p) & (F.size(left) == 0)).alias("kept"), F.array_join(left, ",").alias("left_bands")
    )


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures are written once and read twice: for the bands and for the verdicts."""
    figures = cut(measure(table(spark, sf_dir, "documents")))
    return judge(figures).select("doc_id", *COUNTS, "base_failed", "kept", "script", "chars_per_token", "byte_share", "entropy_share", "left_bands")

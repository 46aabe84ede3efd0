"""The corpus pipeline: five stages over documents, each applied to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontamination, ngram_jaccard, pii_feistel, piece_lattice, quality_compression
from siltstone.llm.common import cut, drop_cut, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_compression", quality_compression.keep_quality),
    ("ngram_jaccard", ngram_jaccard.keep_one),
    ("winnowing", decontamination.drop_contaminated),
    ("pii_feistel", pii_feistel.hide_pii),
    ("piece_lattice", piece_lattice.encode_stage),
]

#: Compressed sizes, keyed permutations and piece lattices have no SQL form; tests/llm hold run()
#: against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each one's result is written to the shared folder, so
    lost executors never repeat an earlier stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)

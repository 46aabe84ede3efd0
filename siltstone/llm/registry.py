"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import (
    decontamination,
    ngram_jaccard,
    paragraph_minhash,
    pii_feistel,
    piece_lattice,
    quality_compression,
    quality_fertility,
    reply_trees,
    warc_zstd,
    wrapper_induction,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_lattice": piece_lattice.op1_piece_lattice,
    "op2_reply_trees": reply_trees.op2_reply_trees,
    "op3_pii_feistel": pii_feistel.op3_pii_feistel,
    "op4_tokeniser_fertility": quality_fertility.op4_tokeniser_fertility,
    "op5_winnowing": decontamination.op5_winnowing,
    "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
    "op7_wrapper_induction": wrapper_induction.op7_wrapper_induction,
    "op8_paragraph_minhash": paragraph_minhash.op8_paragraph_minhash,
    "op9_warc_zstd": warc_zstd.op9_warc_zstd,
    "op10_quality_compression": quality_compression.op10_quality_compression,
}

SQL: dict[str, str] = {
    "op2_reply_trees": reply_trees.chat_sql(),
    "op5_winnowing": decontamination.window_sql(),
    "op6_ngram_jaccard": ngram_jaccard.jaccard_sql(),
    "op9_warc_zstd": warc_zstd.warc_sql(),
}

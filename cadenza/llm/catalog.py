"""The queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cadenza.llm import (
    align, bm25, contamination, fim, jaccard, mixing, nearest, pii, quality, secrets, suffixes, tokens, warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        quality.op1_quality,
        pii.op2_personal_data,
        suffixes.op3_remove_repeats,
        bm25.op4_bm25_top10,
        secrets.op5_secrets,
        warc.op6_warc_roundtrip,
        contamination.op7_contamination,
        jaccard.op8_jaccard_join,
        mixing.op9_mix_sources,
        tokens.op10_token_counts,
        align.op11_align_tokenizers,
        fim.op12_fill_in_middle,
        nearest.op13_nearest_vectors,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {
        "op6_warc_roundtrip": warc.OP6_SQL,
        "op12_fill_in_middle": fim.OP12_SQL,
        "op13_nearest_vectors": nearest.OP13_SQL,
    }

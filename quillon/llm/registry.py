"""Queries over the training-data operators, with SQL where it can express one."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import fingerprints, jpeg, line_dedup, mixing, near_dedup, packing, pii, toxicity, url_filter, warc


def queries():
    return {
        "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
        "op2_media_columns": jpeg.op2_media_columns,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_warc": warc.op7_warc,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_pii": pii.op9_pii,
        "op10_mixing": mixing.op10_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op4_url_filter": url_filter.op4_sql(),
        "op7_warc": warc.OP7_SQL,
    }

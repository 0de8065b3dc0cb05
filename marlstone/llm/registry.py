"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from marlstone.llm import blocks, debruijn, decontaminate, licenses, minhash, oracle, packing, pii, quality, suffixes, vectors


def queries():
    return {
        "op1_quality_classifier": quality.op1,
        "op2_license_scans": licenses.op2,
        "op3_html_extraction": blocks.op3,
        "op4_embedding_near_dedup": vectors.op4,
        "op5_substring_dedup": debruijn.op5,
        "op6_suffix_dedup": suffixes.op6,
        "op7_pii_weak_supervision": pii.op7,
        "op8_minhash_near_dedup": minhash.op8,
        "op9_benchmark_decontamination": decontaminate.op9,
        "op10_best_fit_packing": packing.op10,
    }


def oracle_sql():
    return oracle.oracle_sql()

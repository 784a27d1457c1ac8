"""The operators' queries and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

import corpus_pipeline
from fernpath.llm import bpe, classifier, ctw, jaccard_join, licences, neighbours, packing, pii, quality_rules, suffix_dedup


def queries() -> dict:
    return {
        "op1_compression_classifier": classifier.op1_compression_classifier,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_bpe": bpe.op4_bpe,
        "op5_licence_rules": licences.op5_licence_rules,
        "op6_bootstrapped_pii": pii.op6_bootstrapped_pii,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_context_tree": ctw.op8_context_tree,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_block_matrix_neighbours": neighbours.op10_block_matrix_neighbours,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op3_quality_rules": quality_rules.ORACLE, "op7_jaccard_join": jaccard_join.ORACLE, "op10_block_matrix_neighbours": neighbours.ORACLE}

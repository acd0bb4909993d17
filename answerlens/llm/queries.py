"""The registered queries of this subpackage: name -> (Spark callable, DuckDB statement or None)."""

from __future__ import annotations

from answerlens.llm import (
    context_tree, decontaminate, hard_negatives, outliers, packing, periodic_runs, prefix_counts, quality, secret_scan, shards, simhash, substrings, toxicity,
)

QUERIES: dict = {
    "op1_mcd_outliers": (outliers.op1_mcd_outliers, None),
    "op2_context_tree": (context_tree.op2_context_tree, None),
    "op3_simhash_trie": (simhash.op3_simhash_trie, None),
    "op4_counterfactual_toxicity": (toxicity.op4_counterfactual_toxicity, None),
    "op5_lexical_packing": (packing.op5_lexical_packing, None),
    "op6_fm_index": (decontaminate.op6_fm_index, decontaminate.SQL),
    "op7_run_length_index": (substrings.op7_run_length_index, None),
    "op8_compression_quality": (quality.op8_compression_quality, None),
    "op9_randomness_battery": (secret_scan.op9_randomness_battery, None),
    "op10_sampled_splitters": (shards.op10_sampled_splitters, None),
    "op11_gnat_hard_negatives": (hard_negatives.op11_gnat_hard_negatives, hard_negatives.SQL),
    "op12_prefix_token_counts": (prefix_counts.op12_prefix_token_counts, None),
    "op13_basic_factor_runs": (periodic_runs.op13_basic_factor_runs, None),
}

"""The training-data queries and their SQL; __spark_entry__ adds them where this subpackage exists."""

from __future__ import annotations

from tumbler.llm import contamination, jaccard_join, lm_score, mixing, packing, periodic_runs, quality_rules, repeats, sharding, spelling, token_counts, token_store, warc


def queries() -> dict:
    found = [token_counts.op1_word_pieces, quality_rules.op2_quality_rules, jaccard_join.op3_group_matrix, mixing.op4_mix_flow, warc.op5_warc_revisits, repeats.op6_previous_factors, token_store.op7_token_shards, lm_score.op8_ppm_score, sharding.op9_shard_matrix, contamination.op10_suffix_automaton, periodic_runs.op11_block_convolution, spelling.op12_search_schemes, packing.op13_differencing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.sql(), "op3_group_matrix": jaccard_join.sql(), "op5_warc_revisits": warc.sql(), "op10_suffix_automaton": contamination.sql()}

"""The registered queries of this subpackage, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from . import attention, chat, divergence, exact, htmltext, langid, mixing, nearset, periodic, pieces, quality, sstable, toxicity

QUERIES = {
    "op1_entropy_mixing": mixing.query,
    "op2_sorted_string_table": sstable.query,
    "op3_exact_dedup": exact.query,
    "op4_sentencepiece": pieces.query,
    "op5_site_style_tree": htmltext.query,
    "op6_quality_rules": quality.query,
    "op7_chosen_path_join": nearset.query,
    "op8_language_mixture": langid.query,
    "op9_attention_scores": attention.query,
    "op10_chat_format": chat.query,
    "op11_source_divergence": divergence.query,
    "op12_periodic_runs": periodic.query,
    "op13_toxicity": toxicity.query,
}

ORACLES = {
    "op3_exact_dedup": exact.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}

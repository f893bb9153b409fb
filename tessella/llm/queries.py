"""Queries of the training-data operators, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tessella.llm import byte_bpe, decontaminate, exact_dedup, fill_in_middle, hard_negatives, html_extract, language_id, ngram_jaccard, quality_rules, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_language_id": language_id.op2_language_id,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op6_ngram_jaccard": ngram_jaccard.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}

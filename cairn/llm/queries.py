"""The queries of the training-data operators."""

from __future__ import annotations

from cairn.llm import conversations, exact_dedup, html_text, licenses, near_dedup, packing, pieces, quality_rules, repeated_phrases, spelling, suffix_dedup, token_files, toxicity
from cairn.llm.common import table

QUERIES = {
    "op1_html_extraction": lambda spark, d: html_text.extract(table(spark, d, "pages")),
    "op2_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op3_suffix_dedup": lambda spark, d: suffix_dedup.suffix_spans(table(spark, d, "documents")),
    "op4_toxicity": lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_quality_rules": lambda spark, d: quality_rules.judged(table(spark, d, "documents")),
    "op6_sentencepiece": lambda spark, d: pieces.piece_digests(table(spark, d, "documents")),
    "op7_near_dedup": lambda spark, d: near_dedup.near_groups(table(spark, d, "documents"), words=4),
    "op8_license_scan": lambda spark, d: licenses.license_scan(table(spark, d, "documents")),
    "op9_token_files": lambda spark, d: token_files.token_files(table(spark, d, "documents")),
    "op10_exact_dedup": lambda spark, d: exact_dedup.exact_groups(table(spark, d, "documents")),
    "op11_spelling_variants": lambda spark, d: spelling.variants(table(spark, d, "documents")),
    "op12_conversation_repair": lambda spark, d: conversations.repair(table(spark, d, "conversations")),
    "op13_repeated_phrases": lambda spark, d: repeated_phrases.phrase_digests(table(spark, d, "documents")),
}
ORACLE_SQL = {"op10_exact_dedup": exact_dedup.SQL, "op11_spelling_variants": spelling.SQL, "op12_conversation_repair": conversations.SQL, "op13_repeated_phrases": repeated_phrases.SQL}

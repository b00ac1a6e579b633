"""The numbered queries over the tables of texts, pages and vectors, and the SQL of those that SQL can express."""

from __future__ import annotations

from ondula.llm import bpe, exact_dedup, html_extract, ngram_join, packing, passage_dedup, pii, quality_rules, search, site_quality, token_files, toxicity, whitening

QUERIES = {
    "op1_site_quality": site_quality.op1,
    "op2_pii": pii.op2,
    "op3_ngram_join": ngram_join.op3,
    "op4_passage_dedup": passage_dedup.op4,
    "op5_toxicity": toxicity.op5,
    "op6_packing": packing.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_bpe": bpe.op9,
    "op10_token_files": token_files.op10,
    "op11_whitening": whitening.op11,
    "op12_search": search.op12,
    "op13_html": html_extract.op13,
}
ORACLE_SQL = {"op3_ngram_join": ngram_join.OP3_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op12_search": search.OP12_SQL}

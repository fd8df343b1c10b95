"""The queries of this subpackage and, where SQL can say the same, their SQL counterparts."""

from __future__ import annotations

from cartolith.llm import alignment, collocations, embedding_dedup, language, licences, mixing, packing, pivot_search, quality, secrets, simhash, token_counts, url_lists

QUERIES = {
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_embedding_near_dedup": embedding_dedup.op3_embedding_near_dedup,
    "op7_pivot_top_k": pivot_search.op7_pivot_top_k,
    "op9_language_id": language.op9_language_id,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op1_url_filters": url_lists.op1_url_filters,
    "op6_license_scans": licences.op6_license_scans,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_quality_classifier": quality.op12_quality_classifier,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_url_filters": url_lists.OP1_SQL,
    "op6_license_scans": licences.OP6_SQL,
    "op13_collocations": collocations.OP13_SQL,
}

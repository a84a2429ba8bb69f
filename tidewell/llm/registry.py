"""The corpus operators' queries, by the names the driver uses, and their SQL where SQL can say the same."""

from tidewell.llm import fingerprints, language_id, line_dedup, mixing, near_dedup, packing, quality, substring_dedup, topk, toxicity

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_line_dedup": line_dedup.query,
    "op3_language_id": language_id.query,
    "op4_exact_top_k": topk.query,
    "op5_fingerprints": fingerprints.query,
    "op6_best_fit_packing": packing.query,
    "op7_toxicity": toxicity.query,
    "op8_minhash_near_dedup": near_dedup.query,
    "op9_suffix_array_dedup": substring_dedup.query,
    "op10_quality": quality.query,
}
SQL: dict[str, str] = {"op2_line_dedup": line_dedup.SQL, "op4_exact_top_k": topk.SQL, "op8_minhash_near_dedup": near_dedup.SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)

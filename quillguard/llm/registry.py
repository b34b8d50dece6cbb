"""The training-data queries by name, with their SQL twins."""

from __future__ import annotations

from quillguard.llm import collocations, decontamination, lm_scoring, media, mixing, near_dedup, packing, periodic_runs, quality, quality_rules, secrets, token_counts, url_filters

QUERIES = {
    "op1_media_columns": media.query,
    "op2_quality_classifier": quality.query,
    "op3_secret_scans": secrets.query,
    "op4_best_fit_packing": packing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_lm_scoring": lm_scoring.query,
    "op7_minhash_near_dedup": near_dedup.query,
    "op8_url_filters": url_filters.query,
    "op9_token_counts": token_counts.query,
    "op10_source_mixing": mixing.query,
    "op11_benchmark_decontamination": decontamination.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_phrase_collocations": collocations.query,
}
ORACLES: dict[str, str] = {"op11_benchmark_decontamination": decontamination.ORACLE, "op13_phrase_collocations": collocations.ORACLE}

"""The registered queries: each applies an operator to its whole table."""

from __future__ import annotations

from tablecraft.llm import conversations, decontaminate, fingerprints, jaccard_join, license_scan, line_dedup, lm_score, mixing, quality_knn, quality_rules, secret_scan, substring_dedup, whitening
from tablecraft.llm.columns import table


def over(fn, *names: str):
    """A query that hands whole tables to an operator."""
    return lambda spark, sf_dir: fn(*(table(spark, sf_dir, name) for name in names))


QUERIES = {
    "op1_line_dedup": (over(line_dedup.op1_line_dedup, "documents"), line_dedup.SQL),
    "op2_quality_knn": (over(quality_knn.op2_quality_knn, "documents", "labels"), None),
    "op3_mixing": (over(mixing.op3_mixing, "documents"), mixing.SQL),
    "op4_substring_dedup": (over(substring_dedup.op4_substring_dedup, "documents"), substring_dedup.SQL),
    "op5_lm_score": (over(lm_score.op5_lm_score, "documents"), None),
    "op6_license_scan": (over(license_scan.op6_license_scan, "documents"), None),
    "op7_quality_rules": (over(quality_rules.op7_quality_rules, "documents", "labels"), None),
    "op8_jaccard_join": (over(jaccard_join.op8_jaccard_join, "documents"), None),
    "op9_decontamination": (over(decontaminate.op9_decontamination, "documents", "benchmark"), decontaminate.SQL),
    "op10_secret_scan": (over(secret_scan.op10_secret_scan, "documents"), None),
    "op11_conversations": (over(conversations.op11_conversations, "conversations"), None),
    "op12_whitening": (over(whitening.op12_whitening, "embeddings"), None),
    "op13_fingerprints": (over(fingerprints.op13_fingerprints, "documents"), None),
}

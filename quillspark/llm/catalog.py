"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, licenses, linededup, neardup, packing, phrases, quality, secrets, sharding, simhash, substrings, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_secret_spans": secrets.op2_secret_spans,
        "op3_license_windows": licenses.op3_license_windows,
        "op4_host_quality": quality.op4_host_quality,
        "op5_toxicity_scores": toxicity.op5_toxicity_scores,
        "op6_fingerprint_runs": substrings.op6_fingerprint_runs,
        "op7_edit_matches": decontaminate.op7_edit_matches,
        "op8_bin_slack_packing": packing.op8_bin_slack_packing,
        "op9_sketch_neardup": neardup.op9_sketch_neardup,
        "op10_sampled_sharding": sharding.op10_sampled_sharding,
        "op11_anchor_simhash": simhash.op11_anchor_simhash,
        "op12_phrase_growth": phrases.op12_phrase_growth,
        "quality_by_ending": quality.quality_by_ending,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.OP1_SQL,
        "op4_host_quality": quality.OP4_SQL,
        "op6_fingerprint_runs": substrings.OP6_SQL,
        "op9_sketch_neardup": neardup.OP9_SQL,
        "op12_phrase_growth": phrases.OP12_SQL,
        "quality_by_ending": quality.BY_ENDING_SQL,
    }

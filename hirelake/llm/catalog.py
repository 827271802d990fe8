"""Registry of the training-data queries and of the SQL that must give the same rows."""

from __future__ import annotations

from hirelake.llm import canonical, mixing, names, neardup, subjects, survivorship, tokens, truncation


def queries() -> dict:
    return {
        "p1_found": truncation.p1_found,
        "p1_rates": truncation.p1_rates,
        "p1_limits": truncation.p1_limits,
        "p2_found": canonical.p2_found,
        "p2_candidates": canonical.p2_candidates,
        "p2_unmatched": canonical.p2_unmatched,
        "p3_found": survivorship.p3_found,
        "p3_survivors": survivorship.p3_survivors,
        "p4_found": neardup.p4_found,
        "p4_classes": neardup.p4_classes,
        "p6_found": names.p6_found,
        "p6_entities": names.p6_entities,
        "p7_ids": tokens.p7_ids,
        "p7_lengths": tokens.p7_lengths,
        "p8_documents": mixing.p8_documents,
        "p8_shares": mixing.p8_shares,
        "p9_found": subjects.p9_found,
        "p9_composition": subjects.p9_composition,
        "p3_votes": survivorship.p3_votes,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_limits": truncation.P1_LIMITS_SQL, "p3_votes": survivorship.P3_VOTES_SQL}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import decontaminate, language_id, license_scan, mixing, quality_rules, simhash_dedup, suffix_dedup, token_count, twins, url_filter, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_license_scan": license_scan.op1,
        "op2_warc": warc.op2,
        "op3_mixing": mixing.op3,
        "op4_token_count": token_count.op4,
        "op5_language_id": language_id.op5,
        "op6_decontaminate": decontaminate.op6,
        "op7_suffix_dedup": suffix_dedup.op7,
        "op8_url_filter": url_filter.op8,
        "op9_simhash_near_dedup": simhash_dedup.op9,
        "op10_quality_rules": quality_rules.op10,
    }


def oracle_sql() -> dict[str, str]:
    """SQL twins; the other queries are held against brute force in tests."""
    return dict(twins.SQL)

"""Column functions for use in any query: null-propagating arithmetic, ranks, tails, tiers and canonical texts."""
from __future__ import annotations

from ..operators.evidence import two_sided_p
from ..operators.exprs import average_rank, finite_or_null, mid_percentile, ref, rolling_full, rolling_partial, safe_div, safe_log, zscore
from ..operators.facts import ex_right_reference, tier
from ..operators.reference import in_segments, is_a_share, is_abnormal, is_st_name
from ..sources.ingest import canonical_json, exchange_code
from ..sources.tables import content_hash

__all__ = [
    "average_rank", "canonical_json", "content_hash", "ex_right_reference", "exchange_code", "finite_or_null", "in_segments", "is_a_share", "is_abnormal",
    "is_st_name", "mid_percentile", "ref", "rolling_full", "rolling_partial", "safe_div", "safe_log", "tier", "two_sided_p", "zscore",
]

"""Reusable DataFrame operators. No table is hard-wired; every one takes column names."""

from ordersight.operators.audit import (
    conflicts,
    join_inflation,
    label_variant_error,
    missing_from,
    null_exposure,
)
from ordersight.operators.bitmaps import count_members, member_bitmaps, merge_bitmaps
from ordersight.operators.customers import (
    cohort_share,
    frequency_segments,
    lapsing,
    only_in_period,
    period_retention,
    reorder_gap,
)
from ordersight.operators.periods import (
    distinct_in_periods,
    period_growth,
    period_kpis,
    spike_drivers,
    spikes,
    with_every_period,
    with_previous,
)
from ordersight.operators.ranking import (
    cut_to_ranks,
    global_rank,
    rank_table,
    top_k,
    with_group_sizes,
)
from ordersight.operators.scoring import linear_fit, rating_spread, weighted_score
from ordersight.operators.shares import conditional_rate, share_of_total, with_total

__all__ = [
    "cohort_share",
    "conditional_rate",
    "conflicts",
    "count_members",
    "cut_to_ranks",
    "distinct_in_periods",
    "frequency_segments",
    "global_rank",
    "join_inflation",
    "label_variant_error",
    "lapsing",
    "linear_fit",
    "member_bitmaps",
    "merge_bitmaps",
    "missing_from",
    "null_exposure",
    "only_in_period",
    "period_growth",
    "period_kpis",
    "period_retention",
    "rank_table",
    "rating_spread",
    "reorder_gap",
    "share_of_total",
    "spike_drivers",
    "spikes",
    "top_k",
    "weighted_score",
    "with_every_period",
    "with_group_sizes",
    "with_previous",
    "with_total",
]

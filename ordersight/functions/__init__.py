"""Column expressions: text keys, dates and exact rounding. All run inside the JVM."""

from ordersight.functions.dates import (
    GRAINS,
    is_weekend,
    month_of,
    parse_iso_date,
    parse_mixed_date,
    period_of,
)
from ordersight.functions.numbers import (
    exact_ratio,
    mean,
    mean_of,
    per_count,
    percent,
    sample_variance,
    variance,
    wide_mean,
)
from ordersight.functions.text import bucketize, impute, normalize_key, title_key

__all__ = [
    "GRAINS",
    "bucketize",
    "exact_ratio",
    "impute",
    "is_weekend",
    "mean",
    "mean_of",
    "month_of",
    "normalize_key",
    "parse_iso_date",
    "parse_mixed_date",
    "per_count",
    "percent",
    "period_of",
    "sample_variance",
    "title_key",
    "variance",
    "wide_mean",
]

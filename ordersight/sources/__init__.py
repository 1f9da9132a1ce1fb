"""Readers, cleaning and writers for the five logical tables."""

from ordersight.sources.star import star_tables
from ordersight.sources.tables import (
    Tables,
    months_of,
    overwrite_months,
    read_clean,
    read_raw,
    refresh_late,
    refresh_months,
    write_clean,
)

__all__ = [
    "Tables",
    "months_of",
    "overwrite_months",
    "read_clean",
    "read_raw",
    "refresh_late",
    "refresh_months",
    "star_tables",
    "write_clean",
]

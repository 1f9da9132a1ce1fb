"""Canonical keys for dirty text, default values and labelled ranges."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(text: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Lower-case ``text`` without surrounding spaces; then replace known aliases."""
    key = F.lower(F.trim(text))
    if not aliases:
        return key
    replaced = None
    for alias, canonical in aliases.items():
        hit = key == F.lit(alias)
        replaced = F.when(hit, canonical) if replaced is None else replaced.when(hit, canonical)
    return replaced.otherwise(key)


def title_key(text: Column) -> Column:
    """Display form of a key: trimmed, each run of letters and digits capitalised."""
    runs = F.regexp_extract_all(F.trim(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def impute(value: Column, fill) -> Column:
    return F.coalesce(value, F.lit(fill))


def bucketize(
    value: Column, lower_bounds: Sequence[int], labels: Sequence[str], other: str
) -> Column:
    """Label of the half-open range that ``value`` falls in.

    ``labels`` has one entry more than ``lower_bounds``: the first is for values below every
    bound. NULL gets ``other``.
    """
    if len(labels) != len(lower_bounds) + 1:
        raise ValueError("need one label more than there are bounds")
    label = F.when(value.isNull(), other)
    for bound, name in zip(lower_bounds, labels):
        label = label.when(value < F.lit(bound), name)
    return label.otherwise(labels[-1])

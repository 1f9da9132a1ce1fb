"""Distinct counts that roll up: exact bitmaps of whole-number identifiers.

Identifiers fall into buckets of 32,768; a key holds one 4 KB bitmap for each bucket it meets. Bitmaps of
finer keys merge into those of coarser ones, so the facts are read once for all of them.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_bitmaps(facts: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    """``keys``, ``bucket`` and ``members``: which identifiers occur. NULL is none; its bitmap is empty.

    Identifiers travel, not bitmaps of 4 KB that hold a few of them: a key's bitmap is built where all of its
    rows are.
    """
    bucket = F.bitmap_bucket_number(identifier).alias("bucket")
    position = F.bitmap_bit_position(F.col(identifier)).alias("_position")
    gathered = facts.select(*keys, bucket, position).repartition(*keys, "bucket")
    return gathered.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_position").alias("members"))


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence) -> DataFrame:
    """Bitmaps under coarser keys."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("members").alias("members"))


def count_members(bitmaps: DataFrame, keys: Sequence, name: str = "members") -> DataFrame:
    """Distinct identifiers per key, for keys as fine as those of ``bitmaps`` or coarser; keys without any are left out."""
    merged = merge_bitmaps(bitmaps, [F.col(k) if isinstance(k, str) else k for k in keys])
    names = [c for c in merged.columns if c not in ("bucket", "members")]
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("members")).alias(name)).filter(F.col(name) > 0)

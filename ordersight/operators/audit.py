"""Data-quality checks: missing and conflicting rows, label variants, inflation, NULL exposure."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_from(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` without any partner in ``right``."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def conflicts(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column) -> DataFrame:
    """Joined rows that contradict each other; a NULL on either side is no contradiction."""
    return left.join(right, list(on)).filter(condition)


def label_variant_error(
    df: DataFrame, raw: str, clean: str, value: str, *, spelling: str, canonical: str
) -> DataFrame:
    """Total under the canonical label, under one raw spelling, and the difference.

    Empty unless both labels occur.
    """
    is_clean = F.col(clean) == F.lit(canonical)
    is_raw = F.col(raw) == F.lit(spelling)
    return (
        df.agg(
            F.sum(F.when(is_clean, F.col(value))).alias("cleaned_revenue"),
            F.sum(F.when(is_raw, F.col(value))).alias("naive_revenue"),
            F.count_if(is_clean).alias("_clean_rows"),
            F.count_if(is_raw).alias("_raw_rows"),
        )
        .filter((F.col("_clean_rows") > 0) & (F.col("_raw_rows") > 0))
        .select(
            "cleaned_revenue",
            "naive_revenue",
            (F.col("cleaned_revenue") - F.col("naive_revenue")).alias("undercount"),
        )
    )


def rows_per(df: DataFrame, key: str, name: str = "child_rows") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def join_inflation(fact: DataFrame, child: DataFrame, on: str, value: str) -> DataFrame:
    """Sum of a fact after a one-to-many outer join, at its own grain, and the excess.

    The children are counted per key and never joined row by row.
    """
    joined = fact.join(rows_per(child, on), on, "left")
    copies = F.coalesce(F.col("child_rows"), F.lit(1))
    return joined.agg(
        F.sum(F.col(value) * copies).alias("naive_revenue"),
        F.sum(value).alias("order_grain_revenue"),
    ).withColumn("inflation", F.col("naive_revenue") - F.col("order_grain_revenue"))


def null_exposure(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows without a value per key, priced at the key's average known value (DOUBLE)."""
    stats = df.groupBy(*keys).agg(
        F.sum(value).cast("double").alias("_sum"),
        F.count(value).alias("_known"),
        F.count_if(F.col(value).isNull()).alias("missing_orders"),
    )
    average = F.col("_sum") / F.nullif(F.col("_known").cast("double"), F.lit(0.0))
    return stats.filter(F.col("missing_orders") > 0).select(
        *keys,
        average.alias("avg_order_amount"),
        "missing_orders",
        (average * F.col("missing_orders")).alias("potential_missing_revenue"),
    )

"""Totals beside every row, shares and conditional rates.

A grand total is one aggregated row joined by broadcast: ``sum(..) over ()`` would pull all
rows into one task.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions import percent
from ordersight.operators.branches import for_branches


def with_total(df: DataFrame, *totals: Column) -> DataFrame:
    """Every row of an aggregate beside global aggregates of it (alias each of them)."""
    rows = for_branches(df)
    return rows.crossJoin(F.broadcast(rows.agg(*totals)))


def share_of_total(df: DataFrame, value: str, name: str, places: int = 2) -> DataFrame:
    """Add ``value`` as a percentage of its sum over all rows."""
    return (
        with_total(df, F.sum(value).alias("_total"))
        .withColumn(name, percent(F.col(value), F.col("_total"), places))
        .drop("_total")
    )


def conditional_rate(
    df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column], places: int = 2
) -> DataFrame:
    """Rows meeting each named condition per key, and their percentages of all rows of the key.

    Condition ``x`` gives the columns ``x_count`` and ``x_pct``.
    """
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(c).alias(f"{name}_count") for name, c in conditions.items()],
    )
    rates = [
        percent(F.col(f"{name}_count"), F.col("_rows"), places).alias(f"{name}_pct")
        for name in conditions
    ]
    return counts.select(*keys, *[f"{name}_count" for name in conditions], *rates)

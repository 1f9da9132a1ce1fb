"""Customer behaviour over time. One aggregate per customer instead of row-level windows."""

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions import bucketize, per_count, percent
from ordersight.operators.branches import for_branches
from ordersight.operators.shares import share_of_total, with_total


def period_retention(
    facts: DataFrame,
    key: str,
    period: str,
    first: date,
    last: date,
    *,
    labels: tuple[str, str] = ("retained", "churned"),
    **measures: Column,
) -> DataFrame:
    """Keys active in ``first``, labelled by whether they were active in ``last`` too or not.

    One pass: both memberships are conditional aggregates, so no set is joined to another.
    ``measures`` are further aggregates over all rows of the key.
    """
    seen = facts.groupBy(key).agg(
        F.max(F.col(period) == F.lit(first)).alias("_first"),
        F.max(F.col(period) == F.lit(last)).alias("_last"),
        *[m.alias(n) for n, m in measures.items()],
    )
    status = F.when(F.col("_last"), labels[0]).otherwise(labels[1])
    return seen.filter("_first").select(key, status.alias("retention_status"), *measures)


def only_in_period(
    facts: DataFrame, key: str, period: str, only: date, flag: Column, name: str = "flagged"
) -> DataFrame:
    """Keys whose every dated row lies in one period, and whether any row there had ``flag``."""
    in_period = F.col(period) == F.lit(only)
    spans = facts.groupBy(key).agg(
        F.min(period).alias("_first"),
        F.max(period).alias("_last"),
        F.max(F.when(in_period & flag, 1).otherwise(0)).alias(name),
    )
    return spans.filter(
        (F.col("_first") == F.lit(only)) & (F.col("_last") == F.lit(only))
    ).select(key, name)


def reorder_gap(
    facts: DataFrame, key: str, day: str, amount: str, spend: str = "total_spend"
) -> DataFrame:
    """First and second order date per key, the days between them, and the spend.

    Rows are merged per key and day first, and of those only the first two days of a key are dealt
    out for its dates: a rank limit that Spark applies before the shuffle as well as after it.
    """
    days = for_branches(
        facts.groupBy(key, day).agg(F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_spend"))
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(day).asc_nulls_last()))
    again = F.col(day).isNotNull() & ((F.col("_place") == 2) | (F.col("_rows") > 1))
    firsts = days.withColumn("_place", place).filter(F.col("_place") <= 2).groupBy(key).agg(
        F.min(day).alias("first_order_date"), F.min(F.when(again, F.col(day))).alias("_second")
    )
    spends = days.groupBy(F.col(key).alias("_key")).agg(F.sum("_spend").alias(spend))
    second = F.col("_second")
    return spends.join(firsts, F.col("_key").eqNullSafe(F.col(key)), "left").select(
        F.col("_key").alias(key),
        "first_order_date",
        second.alias("second_order_date"),
        spend,
        F.datediff(second, F.col("first_order_date")).alias("days_to_reorder"),
    )


def frequency_segments(
    per_key: DataFrame,
    count: str,
    amount: str,
    lower_bounds: Sequence[int],
    labels: Sequence[str],
    name: str = "customer_type",
) -> DataFrame:
    """Sum ``amount`` by a label of how often each key occurs, with the share of the total.

    Takes one row per key. Keys below the first bound belong to no segment.
    """
    segment = F.when(
        F.col(count) >= lower_bounds[0],
        bucketize(F.col(count), lower_bounds[1:], labels, labels[-1]),
    )
    segments = per_key.groupBy(segment.alias(name)).agg(F.sum(amount).alias("segment_revenue"))
    return share_of_total(segments, "segment_revenue", "revenue_share_pct")


def lapsing(
    facts: DataFrame, key: str, day: str, amount: str, min_total, idle_days: int
) -> DataFrame:
    """Keys above a total whose last row lies more than ``idle_days`` before the newest row."""
    per_key = facts.groupBy(key).agg(
        F.max(day).alias("last_order_date"), F.sum(amount).alias("total_spent")
    )
    return (
        with_total(per_key, F.max("last_order_date").alias("_end"))
        .filter(F.col("total_spent") > F.lit(min_total))
        .filter(F.datediff("_end", "last_order_date") > idle_days)
        .drop("_end")
    )


def cohort_share(per_cohort: DataFrame, shares: Mapping[str, str]) -> DataFrame:
    """Add ``new_name: column`` percentages of each column's total over all cohorts."""
    totals = [F.sum(c).alias(f"_total_{c}") for c in shares.values()]
    out = with_total(per_cohort, *totals)
    for new, c in shares.items():
        out = out.withColumn(new, percent(F.col(c), F.col(f"_total_{c}")))
    return out.drop(*[f"_total_{c}" for c in shares.values()])


def average_of(df: DataFrame, column: str, name: str, places: int = 2) -> DataFrame:
    """One row: how many values there are and their rounded average."""
    return df.agg(
        F.count(column).alias(f"{name}_count"),
        per_count(F.sum(column), F.count(column), places).alias(name),
    )

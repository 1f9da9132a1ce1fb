"""KPIs by calendar period, growth against the period before, and daily spikes.

Windows without partition keys are used only over rows that are one per day or per month:
a calendar bounds their number whatever the size of the facts.
"""

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions import GRAINS, mean_of, percent, period_of
from ordersight.operators.branches import for_branches

FACTS = ("revenue", "orders", "avg_order_value", "active_customers")


def period_kpis(
    orders: DataFrame,
    keys: Sequence[str],
    facts: Sequence[str] = FACTS,
    *,
    grain: str | None = None,
    day: str = "order_dt",
    period: str = "period",
    every: bool = False,
    amount: str = "order_amount",
    order: str = "order_id",
    customer: str = "customer_id",
) -> DataFrame:
    """Revenue, orders, average order value and active customers per key.

    With a ``grain`` (day, week, month, quarter, year) also per ``period`` of ``day``, named by its first day;
    ``every`` adds the periods in which a key has no orders. The average skips orders without an amount;
    the order count does not.
    """
    known = {
        "revenue": F.sum(amount),
        "orders": F.count(order),
        "avg_order_value": mean_of(orders.schema[amount].dataType)(F.col(amount), 2),
        "active_customers": F.count_distinct(customer),
    }
    by = [*keys] if grain is None else [*keys, period_of(F.col(day), grain).alias(period)]
    kpis = orders.groupBy(*by).agg(*[known[f].alias(f) for f in facts])
    if every and grain is not None:
        kpis = with_every_period(kpis, keys, period, grain, [f for f in facts if f != "avg_order_value"])
    return kpis


def with_every_period(
    rows: DataFrame, keys: Sequence[str], period: str, grain: str, counts: Sequence[str]
) -> DataFrame:
    """One row per key and period, also for periods between the first and last of all rows that have none.

    There ``counts`` are 0 and other columns NULL. Rows of an unknown period stay. The calendar is
    one row, as long as the periods between two dates, and meets every combination of ``keys`` by broadcast.
    """
    rows = for_branches(rows)
    calendar = rows.agg(
        F.sequence(F.min(period), F.max(period), F.expr(GRAINS[grain])).alias("_calendar")
    )
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    spine = groups.crossJoin(F.broadcast(calendar)).select(*keys, F.explode("_calendar").alias(period))
    facts = [c for c in rows.columns if c not in keys and c != period]
    found = rows.withColumn("_found", F.lit(True)).unionByName(spine, allowMissingColumns=True)
    merged = found.groupBy(*keys, period).agg(F.max("_found").alias("_found"), *[F.max(f).alias(f) for f in facts])
    return merged.select(
        *keys,
        period,
        *[
            F.when(F.col("_found"), F.col(f)).otherwise(F.lit(0)).alias(f) if f in counts else F.col(f)
            for f in facts
        ],
    )


def with_previous(df: DataFrame, period: str, **columns: str) -> DataFrame:
    """Add ``new_name=column`` values of the row one period earlier (one row per period)."""
    earlier = Window.orderBy(F.col(period).asc_nulls_last())
    return df.withColumns({new: F.lag(old).over(earlier) for new, old in columns.items()})


def period_growth(
    df: DataFrame, period: str, value: str, name: str = "growth_rate_pct", places: int | None = 2
) -> DataFrame:
    """Add the percentage change against the row one period earlier.

    NULL for the first period or after a zero. ``places=None`` leaves it unrounded, as DOUBLE.
    """
    change = F.col(value) - F.col("_previous")
    if places is None:
        rate = (
            F.lit(100.0)
            * change.cast("double")
            / F.nullif(F.col("_previous").cast("double"), F.lit(0.0))
        )
    else:
        rate = percent(change, F.col("_previous"), places)
    return with_previous(df, period, _previous=value).withColumn(name, rate).drop("_previous")


def spike_drivers(
    facts: DataFrame, day: str, *, order: str = "order_id", amount: str = "order_amount"
) -> DataFrame:
    """Revenue and order volume of every active day beside those of the active day before.

    The two changes tell whether volume or order value moved the revenue.
    """
    daily = (
        facts.filter(F.col(day).isNotNull())
        .groupBy(F.col(day).alias("spike_date"))
        .agg(F.count(order).alias("current_volume"), F.sum(amount).alias("current_revenue"))
    )
    out = with_previous(
        daily, "spike_date", previous_volume="current_volume", previous_revenue="current_revenue"
    )
    for what in ("volume", "revenue"):
        change = F.col(f"current_{what}") - F.col(f"previous_{what}")
        out = out.withColumn(f"{what}_change", change).withColumn(
            f"{what}_change_pct", percent(F.col(f"{what}_change"), F.col(f"previous_{what}"))
        )
    return out


def spikes(
    facts: DataFrame,
    day: str,
    detail: str,
    *,
    order: str = "order_id",
    amount: str = "order_amount",
    k: int | None = None,
) -> DataFrame:
    """Days by revenue change against the active day before, with detail rows of both days.

    The change looks at the previous *active* day; detail rows come from the day itself and
    the *calendar* day before it. ``k`` keeps only days whose dense rank is at most k.
    """
    per_detail = for_branches(
        facts.filter(F.col(day).isNotNull())
        .groupBy(day, detail)
        .agg(F.count(order).alias("order_volume"), F.sum(amount).alias("detail_revenue"))
    )
    daily = per_detail.groupBy(F.col(day).alias("spike_date")).agg(
        F.sum("detail_revenue").alias("current_revenue")
    )
    changes = (
        with_previous(daily, "spike_date", previous_revenue="current_revenue")
        .withColumn("absolute_change", F.col("current_revenue") - F.col("previous_revenue"))
        .withColumn("change_pct", percent(F.col("absolute_change"), F.col("previous_revenue")))
        .withColumn(
            "_exact_pct",
            F.col("absolute_change").cast("double")
            / F.nullif(F.col("previous_revenue").cast("double"), F.lit(0.0)),
        )
        .withColumn(
            "spike_rank",
            F.dense_rank().over(Window.orderBy(F.col("_exact_pct").desc_nulls_last())),
        )
        .drop("_exact_pct")
    )
    if k is not None:
        changes = changes.filter(F.col("spike_rank") <= k)
    both_days = changes.withColumn(
        "_day", F.explode(F.array("spike_date", F.date_sub("spike_date", 1)))
    )
    return (
        per_detail.join(both_days, F.col(day) == F.col("_day"))
        .select(
            "spike_date",
            "previous_revenue",
            "current_revenue",
            "absolute_change",
            "change_pct",
            F.col(day).alias("detail_date"),
            detail,
            "order_volume",
            "detail_revenue",
            "spike_rank",
        )
        .orderBy("spike_rank", "detail_date", F.col("detail_revenue").desc_nulls_first(), detail)
    )


def distinct_in_periods(
    facts: DataFrame,
    keys: Sequence[str],
    period: str,
    members: Mapping[str, date],
    identifier: str,
    sums: Sequence[str] = (),
) -> DataFrame:
    """Distinct identifiers per key in each named period, beside sums of other columns.

    Three COUNT DISTINCTs would copy every row three times first; rows are merged per
    identifier once instead.
    """
    once = facts.groupBy(identifier, period, *keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in sums]
    )
    counts = [
        F.count(F.when(F.col(period) == F.lit(start), F.col(identifier))).alias(name)
        for name, start in members.items()
    ]
    return once.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *counts)

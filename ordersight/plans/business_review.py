"""The quarterly review: monthly KPIs, drivers, regions, one city in depth, churn."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions import per_count, percent
from ordersight.operators import (
    period_growth,
    period_kpis,
    period_retention,
    with_every_period,
    with_previous,
    with_total,
)
from ordersight.plans.common import attempt_weight, delivered, ratings_by
from ordersight.sources.tables import Tables

MONTH = "order_month"


def _by_month(df: DataFrame, *before: str) -> DataFrame:
    """Months as the output column ``month``, sorted with unknown dates last."""
    return df.withColumnRenamed(MONTH, "month").orderBy(
        *before, F.col("month").asc_nulls_last()
    )


def monthly_kpis(t: Tables) -> DataFrame:
    return _by_month(period_kpis(delivered(t.orders), [MONTH]))


def monthly_growth(t: Tables) -> DataFrame:
    revenue = period_kpis(delivered(t.orders), [MONTH], ["revenue"])
    return _by_month(period_growth(revenue, MONTH, "revenue"))


def monthly_volume(t: Tables) -> DataFrame:
    return _by_month(period_kpis(delivered(t.orders), [MONTH], ["orders", "avg_order_value"]))


def kpis_by_period(t: Tables, grain: str = "week", every: bool = False) -> DataFrame:
    """All KPIs by week, quarter or another grain."""
    kpis = period_kpis(delivered(t.orders), [], grain=grain, every=every)
    return kpis.orderBy(F.col("period").asc_nulls_last())


def growth_by_period(t: Tables, grain: str = "day", every: bool = True) -> DataFrame:
    """Revenue and growth against the calendar period before, one without orders included."""
    revenue = period_kpis(delivered(t.orders), [], ["revenue", "orders"], grain=grain, every=every)
    return period_growth(revenue, "period", "revenue").orderBy(F.col("period").asc_nulls_last())


def orders_by_region_period(t: Tables, grain: str = "quarter", every: bool = True) -> DataFrame:
    """Orders and revenue per restaurant city and period, periods without orders included."""
    facts = ["orders", "revenue"]
    regions = t.restaurants.select("restaurant_id", F.col("city_key").alias("region"))
    regional = (
        period_kpis(delivered(t.orders), ["restaurant_id"], facts, grain=grain)
        .join(regions, "restaurant_id")
        .groupBy("region", "period")
        .agg(*[F.sum(f).alias(f) for f in facts])
    )
    if every:
        regional = with_every_period(regional, ["region"], "period", grain, facts)
    return regional.orderBy("region", F.col("period").asc_nulls_last())


def _regional(t: Tables, fact: str, total: str) -> DataFrame:
    """One additive KPI per restaurant city and month."""
    regions = t.restaurants.select("restaurant_id", F.col("city_key").alias("region"))
    per_restaurant = period_kpis(delivered(t.orders), ["restaurant_id", MONTH], [fact])
    return (
        per_restaurant.join(regions, "restaurant_id")
        .groupBy("region", MONTH)
        .agg(F.sum(fact).alias(total))
    )


def orders_by_region(t: Tables) -> DataFrame:
    return _by_month(_regional(t, "orders", "orders"), "region")


def revenue_by_region(t: Tables) -> DataFrame:
    return _by_month(_regional(t, "revenue", "revenue"), "region")


def _city_restaurants(t: Tables, city: str) -> DataFrame:
    return t.restaurants.filter(F.col("city_key") == city).select(
        "restaurant_id", "restaurant_name"
    )


def city_frequency(t: Tables, city: str = "chennai") -> DataFrame:
    """Active customers, orders and orders per customer by month, for one restaurant city."""
    places = _city_restaurants(t, city).select("restaurant_id")
    per_restaurant = (
        delivered(t.orders)
        .groupBy("restaurant_id", MONTH, "customer_id")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    monthly = (
        per_restaurant.join(places, "restaurant_id")
        .groupBy(MONTH, "customer_id")
        .agg(F.sum("orders").alias("orders"))
        .groupBy(MONTH)
        .agg(
            F.count("customer_id").alias("active_customers"), F.sum("orders").alias("orders")
        )
    )
    return _by_month(
        monthly.withColumn(
            "orders_per_customer", per_count(F.col("orders"), F.col("active_customers"), 2)
        )
    )


def city_restaurant_orders(t: Tables, city: str = "chennai") -> DataFrame:
    """Orders per restaurant and month, for one city."""
    per_restaurant = period_kpis(delivered(t.orders), ["restaurant_id", MONTH], ["orders"])
    named = (
        per_restaurant.join(_city_restaurants(t, city), "restaurant_id")
        .groupBy("restaurant_id", "restaurant_name", MONTH)
        .agg(F.sum("orders").alias("orders"))
    )
    return _by_month(named, "restaurant_name")


def churn_vs_service(
    t: Tables,
    first: date = date(2024, 1, 1),
    last: date = date(2024, 3, 1),
    grain: str = "delivery",
) -> DataFrame:
    """Order value, rating and minutes of churned and retained customers.

    All delivered orders of a customer count, once per attempt at ``grain='delivery'`` and
    once at ``'order'``. Membership and measures come from one aggregate per customer.
    """
    weight = attempt_weight() if grain == "delivery" else F.lit(1)
    amount, minutes = F.col("order_amount"), F.col("delivery_time_minutes")
    measures = {
        "_amount": (amount * weight, F.when(amount.isNotNull(), weight)),
        "_rating": (F.col("rating_sum"), F.col("rated")),
        "_minutes": (minutes * weight, F.when(minutes.isNotNull(), weight)),
    }
    sums = {}
    for name, (value, rows) in measures.items():
        sums[name] = F.sum(value)
        sums[f"{name}_rows"] = F.sum(rows)
    facts = (
        delivered(t.orders)
        .select("order_id", "customer_id", MONTH, "order_amount", "delivery_time_minutes")
        .join(ratings_by(t.deliveries, "order_id"), "order_id", "left")
    )
    known = facts.filter(F.col("customer_id").isNotNull())
    seen = period_retention(known, "customer_id", MONTH, first, last, **sums)

    def average(name: str):
        return per_count(F.sum(name), F.sum(f"{name}_rows"), 2)

    return seen.groupBy(F.col("retention_status").alias("customer_status")).agg(
        average("_amount").alias("avg_order_value"),
        average("_rating").alias("avg_rating"),
        average("_minutes").alias("avg_delivery_minutes"),
    )


def driver_decomposition(t: Tables) -> DataFrame:
    """Monthly revenue, its two drivers, and how each moved since the month before."""
    monthly = period_kpis(
        delivered(t.orders), [MONTH], ["revenue", "orders", "avg_order_value"]
    )
    facts = ("revenue", "orders", "avg_order_value")
    compared = with_previous(monthly, MONTH, **{f"_{f}": f for f in facts})
    changes = [(F.col(f) - F.col(f"_{f}")).alias(f"{f}_change") for f in facts]
    return _by_month(compared.select(MONTH, *facts, *changes))


def decline_concentration(
    t: Tables, first: date = date(2024, 1, 1), last: date = date(2024, 3, 1)
) -> DataFrame:
    """Each region's part in the loss of orders and revenue between two months."""
    regions = t.restaurants.select("restaurant_id", F.col("city_key").alias("region"))
    months = delivered(t.orders).filter(F.col(MONTH).isin(first, last))
    per_restaurant = period_kpis(months, ["restaurant_id", MONTH], ["orders", "revenue"])
    side = F.when(F.col(MONTH) == F.lit(first), 1).otherwise(-1)
    losses = (
        per_restaurant.join(regions, "restaurant_id")
        .groupBy("region")
        .agg(
            F.sum(F.col("orders") * side).alias("order_loss"),
            F.sum(F.coalesce("revenue", F.lit(0)) * side).alias("revenue_loss"),
        )
    )
    totals = with_total(
        losses, F.sum("order_loss").alias("_orders"), F.sum("revenue_loss").alias("_revenue")
    )
    return totals.select(
        "region",
        "order_loss",
        percent(F.col("order_loss"), F.col("_orders")).alias("order_loss_pct"),
        "revenue_loss",
        percent(F.col("revenue_loss"), F.col("_revenue")).alias("revenue_loss_pct"),
    ).orderBy(F.col("order_loss").desc(), "region")


def city_decline_by_restaurant(
    t: Tables,
    city: str = "chennai",
    first: date = date(2024, 1, 1),
    last: date = date(2024, 3, 1),
) -> DataFrame:
    """Each restaurant's part in a city's loss of orders and revenue between two months."""
    months = delivered(t.orders).filter(F.col(MONTH).isin(first, last))
    side = F.when(F.col(MONTH) == F.lit(first), 1).otherwise(-1)
    per_restaurant = months.groupBy("restaurant_id").agg(
        F.sum(side).alias("order_loss"),
        F.coalesce(F.sum(F.col("order_amount") * side), F.lit(0)).alias("revenue_loss"),
    )
    losses = (
        per_restaurant.join(_city_restaurants(t, city), "restaurant_id")
        .groupBy("restaurant_id", "restaurant_name")
        .agg(F.sum("order_loss").alias("order_loss"), F.sum("revenue_loss").alias("revenue_loss"))
    )
    totals = with_total(
        losses, F.sum("order_loss").alias("_orders"), F.sum("revenue_loss").alias("_revenue")
    )
    return totals.select(
        "restaurant_id",
        "restaurant_name",
        "order_loss",
        percent(F.col("order_loss"), F.col("_orders")).alias("order_loss_pct"),
        "revenue_loss",
        percent(F.col("revenue_loss"), F.col("_revenue")).alias("revenue_loss_pct"),
    ).orderBy(F.col("revenue_loss").desc(), "restaurant_id")

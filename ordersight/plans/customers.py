"""Who the customers are: signups, retention, re-ordering, segments and churn."""

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions import (
    bucketize,
    month_of,
    normalize_key,
    per_count,
    percent,
)
from ordersight.operators import (
    cohort_share,
    lapsing,
    only_in_period,
    period_retention,
    reorder_gap,
    top_k,
    with_total,
)
from ordersight.operators.branches import for_branches
from ordersight.operators.customers import average_of
from ordersight.plans.common import (
    CITY_ALIASES,
    customer_names,
    delivered,
    is_cancelled,
    merge_sales,
    sales_by,
)
from ordersight.sources.tables import Tables


def signups_by_month(t: Tables) -> DataFrame:
    return (
        t.customers.groupBy(month_of(F.col("signup_dt")).alias("signup_month"))
        .agg(F.count("customer_id").alias("signup_count"))
        .orderBy(F.col("signup_month").asc_nulls_last())
    )


def peak_signup_month(t: Tables) -> DataFrame:
    """Names of the months sharing the highest number of signups."""
    return top_k(signups_by_month(t), "signup_count", 1, ties="dense").select(
        F.date_format("signup_month", "MMMM").alias("month_name"), "signup_count"
    )


def repeat_buckets(t: Tables) -> DataFrame:
    """Customers by no order, one order, more than one order."""
    counts = t.orders.groupBy("customer_id").agg(F.count("order_id").alias("_orders"))
    per_customer = (
        t.customers.select("customer_id")
        .join(counts, "customer_id", "left")
        .groupBy("customer_id")
        .agg(F.coalesce(F.sum("_orders"), F.lit(0)).alias("orders"))
    )
    bucket = bucketize(F.col("orders"), (1, 2), ("0", "=1", ">1"), "0")
    return per_customer.groupBy(bucket.alias("order_bucket")).agg(
        F.count("customer_id").alias("customer_count")
    )


def _order_counts(t: Tables) -> DataFrame:
    """All and cancelled orders per known customer; orders of unknown ones under NULL."""
    counts = t.orders.groupBy("customer_id").agg(
        F.count("order_id").alias("_all"),
        F.count(F.when(is_cancelled(), F.col("order_id"))).alias("_cancelled"),
    )
    names = customer_names(t.customers).withColumnRenamed("customer_id", "_known")
    return (
        counts.join(names, F.col("customer_id") == F.col("_known"), "left")
        .groupBy(F.col("_known").alias("customer_id"), "customer_name")
        .agg(
            F.sum("_all").alias("total_orders"),
            F.sum("_cancelled").alias("cancelled_orders"),
        )
    )


def cancel_rate(t: Tables) -> DataFrame:
    """Cancelled share per customer: the fraction is rounded to 2 places, then made a percentage."""
    fraction = per_count(F.col("cancelled_orders"), F.col("total_orders"), 2)
    return _order_counts(t).withColumn("cancellation_rate_pct", fraction * 100)


def cancel_rate_min_orders(
    t: Tables, min_orders: int = 3, above: int | None = None
) -> DataFrame:
    """Whole-percent cancelled share (cut, not rounded) of customers with enough orders.

    ``above`` keeps customers whose exact share is more than so many percent.
    """
    whole_percent = F.call_function(
        "div", F.col("cancelled_orders") * 100, F.nullif(F.col("total_orders"), F.lit(0))
    )
    enough = F.col("total_orders") >= min_orders
    if above is not None:
        enough &= F.col("cancelled_orders") * 100 > F.col("total_orders") * above
    return (
        _order_counts(t)
        .filter(enough)
        .withColumn("cancellation_rate_pct", whole_percent)
        .orderBy(F.col("cancellation_rate_pct").desc_nulls_first(), "customer_id")
    )


def favourite_restaurant(t: Tables) -> DataFrame:
    """Restaurants a repeat customer ordered from most, all of them where several tie."""
    # Dealt by customer for the maximum, the join with it and the names alike.
    pairs = for_branches(
        t.orders.groupBy("customer_id", "restaurant_id")
        .agg(F.count("order_id").alias("restaurant_orders"))
        .repartition("customer_id")
    )
    most = pairs.groupBy("customer_id").agg(
        F.sum("restaurant_orders").alias("_orders"), F.max("restaurant_orders").alias("_most")
    )
    return (
        pairs.join(most.filter(F.col("_orders") > 1), "customer_id")
        .filter(F.col("restaurant_orders") >= F.col("_most"))  # "=" would become a join key
        .join(customer_names(t.customers), "customer_id")
        .join(t.restaurants.select("restaurant_id", "restaurant_name"), "restaurant_id", "left")
        .select(
            "customer_id",
            "customer_name",
            "restaurant_id",
            "restaurant_name",
            "restaurant_orders",
            F.lit(1).cast("long").alias("rnk"),
        )
    )


def signup_cohorts(t: Tables) -> DataFrame:
    """Delivered orders and revenue by signup year, with shares of the whole."""
    customers = t.customers.select("customer_id", F.year("signup_dt").alias("signup_year"))
    sales = sales_by(delivered(t.orders), "customer_id")
    cohorts = merge_sales(customers.join(sales, "customer_id", "left"), "signup_year").withColumn(
        "orders", F.coalesce("orders", F.lit(0))
    )
    return cohort_share(
        cohorts, {"order_volume_pct": "orders", "revenue_pct": "revenue"}
    ).select(
        "signup_year",
        F.col("revenue").alias("cohort_revenue"),
        per_count(F.col("revenue"), F.col("priced_orders"), 2).alias("avg_order_value"),
        F.col("orders").alias("cohort_orders"),
        "order_volume_pct",
        "revenue_pct",
    )


# Labels of customers who came back and who did not.
RETENTION_LABELS = ("retained_customer", "churned_customer")


def churned_customers(
    t: Tables,
    first: date = date(2024, 1, 1),
    last: date = date(2024, 3, 1),
    labels: tuple[str, str] = RETENTION_LABELS,
) -> DataFrame:
    """Customers with a delivered order in the first month and none in the last, and how many."""
    months = delivered(t.orders).filter(F.col("order_month").isin(first, last))
    churned = (
        period_retention(months, "customer_id", "order_month", first, last, labels=labels)
        .filter(F.col("retention_status") == labels[1])
        .join(customer_names(t.customers), "customer_id")
        .select("customer_id", "customer_name", "retention_status")
        .distinct()
    )
    return with_total(churned, F.count(F.lit(1)).alias("churned_customers"))


def reorder_gaps(t: Tables) -> DataFrame:
    """First and second delivered order per customer; the gap is NULL after a single order."""
    return reorder_gap(delivered(t.orders), "customer_id", "order_dt", "order_amount").orderBy(
        F.col("total_spend").desc_nulls_first(), "customer_id"
    )


def average_reorder_gap(t: Tables) -> DataFrame:
    """Average gap over customers with a second order, beside their number."""
    gaps = reorder_gap(delivered(t.orders), "customer_id", "order_dt", "order_amount")
    return average_of(gaps, "days_to_reorder", "avg_days_to_reorder")


def reorder_speed_vs_spend(t: Tables, lower_bounds: tuple[int, int] = (31, 91)) -> DataFrame:
    """Customers and their spend by how soon they ordered again."""
    gaps = reorder_gap(delivered(t.orders), "customer_id", "order_dt", "order_amount")
    speed = bucketize(F.col("days_to_reorder"), lower_bounds, ("soon", "later", "late"), "never")
    return (
        gaps.groupBy(speed.alias("reorder_speed"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count("total_spend").alias("_known"),
            F.sum("total_spend").alias("total_spend"),
        )
        .withColumn("avg_spend", per_count(F.col("total_spend"), F.col("_known"), 2))
        .drop("_known")
    )


def lapsing_high_value(t: Tables, min_total: int = 2000, idle_days: int = 45) -> DataFrame:
    """Customers who spent much and then fell silent before the end of the data."""
    return lapsing(
        t.orders, "customer_id", "order_dt", "order_amount", min_total, idle_days
    ).select("customer_id")


def lapsing_by_city(
    t: Tables,
    min_total: int = 2000,
    idle_days: int = 45,
    aliases: Mapping[str, str] = CITY_ALIASES,
) -> DataFrame:
    """How many such customers each city has."""
    cities = t.customers.select("customer_id", normalize_key(F.col("city"), aliases).alias("city"))
    return (
        lapsing_high_value(t, min_total, idle_days)
        .join(cities, "customer_id", "left")
        .groupBy("city")
        .agg(F.count(F.lit(1)).alias("lapsing_customers"))
    )


def cancellation_before_churn(
    t: Tables, only: date = date(2024, 1, 1), scope: tuple[date, date] | None = None
) -> DataFrame:
    """Customers who ordered in one month only, and how many of them cancelled there.

    ``scope`` restricts the orders to whole days from the first to the second date.
    """
    orders = t.orders
    if scope is not None:
        months = [day.replace(day=1) for day in scope]  # these prune partitions
        orders = orders.filter(
            F.col("order_dt").between(*scope) & F.col("order_month").between(*months)
        )
    lost = only_in_period(
        orders, "customer_id", "order_month", only, is_cancelled(), "had_cancellation"
    )
    return lost.agg(
        F.count(F.lit(1)).alias("one_month_customers"),
        F.sum("had_cancellation").alias("with_cancellation"),
    ).withColumn(
        "cancellation_pct", percent(F.col("with_cancellation"), F.col("one_month_customers"))
    )

"""Where revenue comes from: totals, leaders, concentration, spikes and growth."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions import impute, is_weekend, mean, per_count, percent, title_key
from ordersight.operators import (
    frequency_segments,
    global_rank,
    null_exposure,
    period_growth,
    period_kpis,
    share_of_total,
    spike_drivers,
    spikes,
    top_k,
    with_total,
)
from ordersight.operators.branches import for_branches
from ordersight.plans.common import (
    customer_names,
    delivered,
    merge_sales,
    restaurant_names,
    sales_by,
)
from ordersight.sources.tables import Tables


def total_revenue(t: Tables) -> DataFrame:
    """Sum of every known amount, whatever the status."""
    return t.orders.agg(F.sum("order_amount").alias("total_revenue"))


def top_spenders(
    t: Tables, k: int = 5, status: str | None = "delivered", fill: int | None = None
) -> DataFrame:
    """The ``k`` customers who spent most; ``fill`` prices orders without an amount."""
    orders = t.orders if status is None else t.orders.filter(F.col("status_key") == status)
    amount = F.col("order_amount") if fill is None else impute(F.col("order_amount"), fill)
    spend = orders.groupBy("customer_id").agg(F.sum(amount).alias("_spend"))
    named = (
        spend.join(customer_names(t.customers), "customer_id")
        .groupBy("customer_id", "customer_name")
        .agg(F.sum("_spend").alias("total_spend"))
    )
    return top_k(named, "total_spend", k, ties="none", tie_break=["customer_id"])


def top_city_revenue(t: Tables) -> DataFrame:
    """The restaurant city with the highest delivered revenue, one row."""
    cities = t.restaurants.select("restaurant_id", title_key(F.col("city")).alias("city_name"))
    by_city = merge_sales(
        sales_by(delivered(t.orders), "restaurant_id").join(cities, "restaurant_id"), "city_name"
    ).select("city_name", F.col("revenue").alias("total_revenue"))
    return top_k(by_city, "total_revenue", 1, ties="none", tie_break=["city_name"])


def top_restaurant(t: Tables) -> DataFrame:
    """Restaurants sharing the highest delivered revenue."""
    named = merge_sales(
        sales_by(delivered(t.orders), "restaurant_id").join(
            restaurant_names(t.restaurants), "restaurant_id"
        ),
        "restaurant_id",
        "restaurant_name",
    ).select("restaurant_id", "restaurant_name", F.col("revenue").alias("total_revenue"))
    return top_k(named, "total_revenue", 1)


def top_category_revenue(t: Tables) -> DataFrame:
    """Categories sharing the highest delivered revenue; unknown restaurants form category NULL."""
    categories = t.restaurants.select("restaurant_id", "category")
    by_category = merge_sales(
        sales_by(delivered(t.orders), "restaurant_id").join(categories, "restaurant_id", "left"),
        "category",
    ).select("category", F.col("revenue").alias("total_revenue"))
    return top_k(by_category, "total_revenue", 1)


def monthly_revenue(t: Tables) -> DataFrame:
    """Delivered revenue per calendar month under the month's short name, oldest first."""
    return (
        period_kpis(delivered(t.orders), ["order_month"], ["revenue"])
        .orderBy(F.col("order_month").asc_nulls_last())
        .select(
            F.date_format("order_month", "MMM").alias("month_name"),
            F.col("revenue").alias("monthly_revenue"),
        )
    )


def top_city_order_value(t: Tables) -> DataFrame:
    """Customer cities sharing the highest average delivered order value."""
    cities = t.customers.select("customer_id", "city_key")
    by_city = merge_sales(
        sales_by(delivered(t.orders), "customer_id").join(cities, "customer_id"), "city_key"
    ).select(
        "city_key",
        per_count(F.col("revenue"), F.col("priced_orders"), 2).alias("avg_order_value"),
    )
    return top_k(by_city, "avg_order_value", 1)


def weekday_weekend(t: Tables) -> DataFrame:
    day_type = F.when(is_weekend(F.col("order_dt")), "weekend").otherwise("weekday")
    return (
        delivered(t.orders)
        .groupBy(day_type.alias("day_type"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("order_amount").alias("total_revenue"),
            mean(F.col("order_amount"), 2).alias("avg_order_value"),
        )
    )


def weekday_weekend_per_day(t: Tables) -> DataFrame:
    """Orders and revenue of an average active day, weekend against weekday: five days meet two."""
    day_type = F.when(is_weekend(F.col("order_dt")), "weekend").otherwise("weekday")
    daily = sales_by(delivered(t.orders).filter(F.col("order_dt").isNotNull()), "order_dt")
    return daily.groupBy(day_type.alias("day_type")).agg(
        F.count("order_dt").alias("active_days"),
        per_count(F.sum("orders"), F.count("order_dt"), 2).alias("orders_per_day"),
        per_count(F.sum("revenue"), F.count("order_dt"), 2).alias("revenue_per_day"),
        per_count(F.sum("revenue"), F.sum("priced_orders"), 2).alias("avg_order_value"),
    )


def high_value_orders(t: Tables, threshold: int = 1000) -> DataFrame:
    """Delivered orders above a threshold per restaurant, and their share of all revenue."""
    high = F.col("order_amount") > threshold
    per_restaurant = (
        delivered(t.orders)
        .groupBy("restaurant_id")
        .agg(
            F.count(F.when(high, F.col("order_id"))).alias("high_orders"),
            F.sum(F.when(high, F.col("order_amount"))).alias("_high_revenue"),
            F.sum("order_amount").alias("_revenue"),
        )
    )
    totals = with_total(
        per_restaurant,
        F.sum("high_orders").alias("total_high_orders"),
        F.sum("_high_revenue").alias("_all_high"),
        F.sum("_revenue").alias("_all"),
    )
    return (
        totals.filter(F.col("_high_revenue").isNotNull())
        .select(
            "restaurant_id",
            "high_orders",
            "total_high_orders",
            percent(F.col("_all_high"), F.col("_all")).alias("revenue_pct"),
        )
        .orderBy(F.col("high_orders").desc(), "restaurant_id")
    )


def agent_revenue_rank(t: Tables) -> DataFrame:
    """Delivered order revenue each agent handled (once per attempt), with rank."""
    orders = delivered(t.orders).select("order_id", "order_amount")
    per_agent = (
        t.deliveries.select("order_id", "agent_id")
        .join(orders, "order_id")
        .groupBy("agent_id")
        .agg(F.sum("order_amount").alias("agent_revenue"))
    )
    return global_rank(per_agent, "agent_revenue")


def restaurant_revenue(t: Tables) -> DataFrame:
    """Delivered revenue of every restaurant; NULL for one that sold nothing."""
    sales = sales_by(delivered(t.orders), "restaurant_id").select("restaurant_id", "revenue")
    return (
        restaurant_names(t.restaurants)
        .join(sales, "restaurant_id", "left")
        .groupBy("restaurant_id", "restaurant_name")
        .agg(F.sum("revenue").alias("restaurant_revenue"))
    )


def top_restaurants_share(t: Tables, k: int = 3, nulls: str | None = None) -> DataFrame:
    """Restaurants whose dense revenue rank is at most ``k``, with their share of all revenue.

    Restaurants without sales have NULL revenue and rank first unless ``nulls='last'``.
    """
    shares = share_of_total(restaurant_revenue(t), "restaurant_revenue", "revenue_pct")
    return top_k(shares, "restaurant_revenue", k, ties="dense", nulls=nulls)


def top_restaurants_offline(t: Tables, k: int = 3) -> DataFrame:
    """Revenue with and without the ``k`` best-selling revenue ranks."""
    per_restaurant = restaurant_revenue(t)
    top = top_k(per_restaurant, "restaurant_revenue", k, ties="dense", nulls="last").agg(
        F.count(F.lit(1)).alias("top_restaurants"),
        F.sum("restaurant_revenue").alias("top_revenue"),
    )
    remaining = F.col("total_revenue") - F.col("top_revenue")
    return (
        per_restaurant.agg(F.sum("restaurant_revenue").alias("total_revenue"))
        .crossJoin(F.broadcast(top))
        .select(
            "top_restaurants",
            "total_revenue",
            "top_revenue",
            remaining.alias("remaining_revenue"),
            percent(F.col("top_revenue"), F.col("total_revenue")).alias("lost_pct"),
        )
    )


def customer_lifetime_value(t: Tables, k: int = 10) -> DataFrame:
    """Customers whose average order value times order count ranks within ``k`` (dense).

    The order count includes orders without an amount on both sides of the product, so the
    product is the spend itself; it is taken as such rather than through a rounded average.
    """
    per_customer = sales_by(delivered(t.orders), "customer_id").select(
        "customer_id",
        (F.col("revenue").cast("double") / F.col("orders")).alias("avg_order_value"),
        F.col("orders").alias("order_count"),
        F.col("revenue").alias("clv"),
    )
    return top_k(per_customer, "clv", k, ties="dense")


def revenue_spikes(t: Tables, k: int | None = None) -> DataFrame:
    """Every active day by revenue change, beside restaurant sales of that day and the one before."""
    return spikes(delivered(t.orders), "order_dt", "restaurant_id", k=k).drop("spike_rank")


def revenue_spike_drivers(t: Tables) -> DataFrame:
    """Volume and revenue changes of every active day."""
    return spike_drivers(delivered(t.orders), "order_dt").orderBy("spike_date")


def clv_among_top_spenders(t: Tables, places: int = 10, k: int = 5) -> DataFrame:
    """How many customers the lifetime-value list and the list of top spenders share."""
    spend = for_branches(
        delivered(t.orders).groupBy("customer_id").agg(F.sum("order_amount").alias("spend"))
    )
    # A plain equality would push a NULL filter into this branch and scan the orders again.
    named = t.customers.filter("customer_id is not null").select(F.col("customer_id").alias("_id"))
    known = spend.join(named, F.col("customer_id").eqNullSafe(F.col("_id")), "left_semi")
    clv = top_k(spend, "spend", places, ties="dense")
    top = top_k(known, "spend", k, ties="none", tie_break=["customer_id"])
    both = (
        clv.select("customer_id", F.lit(1).alias("_clv"), F.lit(0).alias("_top"))
        .union(top.select("customer_id", F.lit(0), F.lit(1)))
        .groupBy("customer_id")
        .agg(F.max("_clv").alias("_clv"), F.max("_top").alias("_top"))
    )
    return both.agg(
        F.count_if(F.col("_clv") == 1).alias("clv_customers"),
        F.count_if(F.col("_top") == 1).alias("top_spenders"),
        F.count_if((F.col("_clv") == 1) & (F.col("_top") == 1)).alias("in_both"),
    )


# Labels of customers by how often they ordered.
FREQUENCY_LABELS = ("One_time_customer", "Occasional_customer", "Regular_customer")


def frequency_segment_share(t: Tables, labels: Sequence[str] = FREQUENCY_LABELS) -> DataFrame:
    """Revenue share of customers with 1, 2-3, and 4 or more delivered orders."""
    sales = sales_by(delivered(t.orders), "customer_id")
    return frequency_segments(sales, "orders", "revenue", (1, 2, 4), labels)


def missing_revenue_exposure(t: Tables) -> DataFrame:
    return null_exposure(t.orders, ["restaurant_id"], "order_amount")


def missing_revenue_policies(t: Tables) -> DataFrame:
    """One row: revenue without the orders that have no amount, and with these at an average amount.

    The average is that of the order's restaurant or of all orders, to the cent. Orders of restaurants
    without any amount stay out of the first and are counted.
    """
    places = sales_by(t.orders, "restaurant_id")
    missing = F.col("orders") - F.col("priced_orders")
    average = per_count(F.col("revenue"), F.col("priced_orders"), 2)
    totals = places.agg(
        F.sum("revenue").alias("known_revenue"),
        F.sum(missing).alias("missing_orders"),
        F.sum(F.when(F.col("priced_orders") == 0, missing).otherwise(0)).alias("orders_without_average"),
        F.sum("orders").alias("_orders"),
        F.sum("priced_orders").alias("_priced"),
        F.sum(average * missing).alias("_at_restaurant"),
    )
    overall = per_count(F.col("known_revenue"), F.col("_priced"), 2)
    return totals.select(
        "known_revenue",
        "missing_orders",
        percent(F.col("missing_orders"), F.col("_orders")).alias("missing_pct"),
        "orders_without_average",
        (F.col("known_revenue") + F.col("_at_restaurant")).alias("revenue_at_restaurant_average"),
        (F.col("known_revenue") + overall * F.col("missing_orders")).alias("revenue_at_overall_average"),
    )


# Labels of the second and third month of a quarter.
GROWTH_LABELS = ("jan-feb", "feb-march")


def growth_labelled(
    t: Tables,
    second: date = date(2024, 2, 1),
    third: date = date(2024, 3, 1),
    labels: tuple[str, str] = GROWTH_LABELS,
) -> DataFrame:
    """Unrounded monthly growth of delivered revenue, two months of which carry a label."""
    label = F.when(F.col("order_month") == F.lit(second), labels[0]).when(
        F.col("order_month") == F.lit(third), labels[1]
    )
    monthly = period_kpis(delivered(t.orders), ["order_month"], ["revenue"])
    return period_growth(monthly, "order_month", "revenue", "revenue_growth", None).select(
        label.alias("cohort"), "revenue_growth"
    )


def growth_clean_vs_naive(t: Tables) -> DataFrame:
    """Monthly growth over all orders beside growth over delivered orders with an amount."""
    clean = (F.col("status_key") == "delivered") & F.col("order_amount").isNotNull()
    monthly = t.orders.groupBy("order_month").agg(
        F.sum("order_amount").alias("naive_revenue"),
        F.sum(F.when(clean, F.col("order_amount"))).alias("clean_revenue"),
    )
    both = period_growth(monthly, "order_month", "naive_revenue", "naive_growth_pct")
    return period_growth(both, "order_month", "clean_revenue", "clean_growth_pct").orderBy(
        F.col("order_month").asc_nulls_last()
    )

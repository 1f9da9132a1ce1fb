"""Marts by day and restaurant city, and the KPIs that roll up from them at any grain.

``sales`` holds sums and counts, ``active`` bitmaps of the customers. Both are built from the orders once;
months, quarters, cities and their active customers come from the marts alone.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.functions import per_count, period_of
from ordersight.operators import count_members, member_bitmaps
from ordersight.operators.branches import for_branches
from ordersight.plans.common import delivered, merge_sales, sales_by
from ordersight.sources.tables import Tables, overwrite_months

MONTH = "order_month"
KEYS = ("order_month", "order_dt", "city_key")
NAMES = ("sales", "active")


@dataclass(frozen=True)
class Marts:
    sales: DataFrame
    active: DataFrame


def build_marts(t: Tables, city: str | None = None) -> Marts:
    """Marts of the delivered orders, of all or of one city; an unknown restaurant's city is NULL, as an
    unknown day is."""
    cities = t.restaurants.select("restaurant_id", "city_key")
    if city is not None:
        cities = cities.filter(F.col("city_key") == city)
    orders = delivered(t.orders).select(
        MONTH, "order_dt", "restaurant_id", "customer_id", "order_id", "order_amount"
    )
    placed = for_branches(orders.join(cities, "restaurant_id", "left" if city is None else "inner"))  # joined once for both
    return Marts(sales_by(placed, *KEYS), member_bitmaps(placed, KEYS, "customer_id"))


def write_marts(marts: Marts, root: str, months: list | None = None) -> None:
    """Store both marts by month, or only write ``months`` anew; see ``overwrite_months``."""
    for name in NAMES:
        overwrite_months(getattr(marts, name), f"{root}/{name}", MONTH, months)


def read_marts(spark: SparkSession, root: str) -> Marts:
    return Marts(*[spark.read.parquet(f"{root}/{name}") for name in NAMES])


def _period(grain: str):
    return period_of(F.col("order_dt"), grain).alias("period")


def kpis_from_marts(marts: Marts, grain: str, *keys: str) -> DataFrame:
    """Revenue, orders, average order value and active customers by period, and by city if named a key."""
    sales = merge_sales(marts.sales, _period(grain), *keys)
    active = count_members(marts.active, [_period(grain), *keys], "active_customers")
    # One row a period on either side: put together by key, NULL included.
    both = sales.unionByName(active, allowMissingColumns=True).groupBy("period", *keys)
    return both.agg(
        F.max("revenue").alias("revenue"),
        F.max("orders").alias("orders"),
        F.max(per_count(F.col("revenue"), F.col("priced_orders"), 2)).alias("avg_order_value"),
        F.coalesce(F.max("active_customers"), F.lit(0)).alias("active_customers"),
    )


def kpis_of_marts(t: Tables, grain: str = "month") -> DataFrame:
    """The KPIs of all orders by month, quarter or another grain."""
    return kpis_from_marts(build_marts(t), grain).orderBy(F.col("period").asc_nulls_last())


def regional_kpis_of_marts(t: Tables, grain: str = "quarter") -> DataFrame:
    """KPIs by restaurant city and period."""
    kpis = kpis_from_marts(build_marts(t), grain, "city_key")
    return kpis.orderBy("city_key", F.col("period").asc_nulls_last())


def city_frequency_of_marts(t: Tables, city: str = "chennai", grain: str = "month") -> DataFrame:
    """Active customers, orders and orders per customer of one restaurant city."""
    return (
        kpis_from_marts(build_marts(t, city), grain)
        .select(
            "period",
            "active_customers",
            "orders",
            per_count(F.col("orders"), F.col("active_customers"), 2).alias("orders_per_customer"),
        )
        .orderBy(F.col("period").asc_nulls_last())
    )

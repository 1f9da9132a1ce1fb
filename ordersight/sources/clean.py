"""Canonical columns beside the raw ones.

Each function only adds columns and leaves a frame that already has them alone, so the same
plans run on raw tables and on a stored clean layer.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions import month_of, normalize_key, parse_iso_date, parse_mixed_date


def clean_orders(orders: DataFrame) -> DataFrame:
    if "order_month" in orders.columns:
        return orders
    day = parse_iso_date(F.col("order_date"))
    return orders.select(
        "*",
        normalize_key(F.col("status")).alias("status_key"),
        day.alias("order_dt"),
        month_of(day).alias("order_month"),
    )


def clean_customers(customers: DataFrame) -> DataFrame:
    if "signup_dt" in customers.columns:
        return customers
    return customers.select(
        "*",
        normalize_key(F.col("city")).alias("city_key"),
        parse_mixed_date(F.col("signup_date")).alias("signup_dt"),
    )


def clean_places(places: DataFrame) -> DataFrame:
    """Restaurants or agents."""
    if "city_key" in places.columns:
        return places
    return places.withColumn("city_key", normalize_key(F.col("city")))


def clean_deliveries(deliveries: DataFrame) -> DataFrame:
    if "delivery_status_key" in deliveries.columns:
        return deliveries
    return deliveries.withColumn("delivery_status_key", normalize_key(F.col("delivery_status")))


CLEANERS = {
    "orders": clean_orders,
    "customers": clean_customers,
    "restaurants": clean_places,
    "deliveries": clean_deliveries,
    "delivery_agents": clean_places,
}

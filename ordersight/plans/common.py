"""Shapes the analyses share.

Facts are aggregated by their join key before they meet another table. That keeps a hot
customer, restaurant or order from travelling as raw rows, and leaves at most one row per key
to join. The result is grouped once more afterwards, which needs no further shuffle on the
same key and stays right should a key occur twice in the other table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status keys as they read after cleaning.
DELIVERED = "delivered"
CANCELLED = "cancelled"
FAILED = "failed"

# Fixed value: the one city alias known to occur, alias -> canonical key.
CITY_ALIASES = {"pondy": "pondicherry"}


def delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status_key") == DELIVERED)


def delivered_attempts(deliveries: DataFrame) -> DataFrame:
    return deliveries.filter(F.col("delivery_status_key") == DELIVERED)


def is_cancelled() -> Column:
    return F.col("status_key") == CANCELLED


def sales_by(orders: DataFrame, *keys: str) -> DataFrame:
    """Revenue, orders and priced orders (those with an amount) per key."""
    return orders.groupBy(*keys).agg(
        F.sum("order_amount").alias("revenue"),
        F.count("order_id").alias("orders"),
        F.count("order_amount").alias("priced_orders"),
    )


def merge_sales(sales: DataFrame, *keys) -> DataFrame:
    """Add up ``sales_by`` rows under coarser keys."""
    return sales.groupBy(*keys).agg(
        F.sum("revenue").alias("revenue"),
        F.sum("orders").alias("orders"),
        F.sum("priced_orders").alias("priced_orders"),
    )


def ratings_by(deliveries: DataFrame, *keys: str) -> DataFrame:
    """Attempts, rated attempts and the sum of ratings per key."""
    return deliveries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum("delivery_rating").alias("rating_sum"),
        F.count("delivery_rating").alias("rated"),
    )


def attempt_weight() -> Column:
    """How many rows an order becomes in an outer join with its delivery attempts."""
    return F.coalesce(F.col("attempts"), F.lit(1))


def restaurant_names(restaurants: DataFrame) -> DataFrame:
    return restaurants.select("restaurant_id", "restaurant_name")


def customer_names(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", "customer_name")

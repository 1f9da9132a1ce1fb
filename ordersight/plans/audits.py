"""Data-quality audits over the five tables."""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions import normalize_key
from ordersight.operators import conflicts, join_inflation, label_variant_error, missing_from
from ordersight.plans.common import CITY_ALIASES, delivered, is_cancelled
from ordersight.sources.tables import Tables


def delivered_without_delivery(t: Tables) -> DataFrame:
    """Orders called delivered that no delivery row mentions."""
    orders = delivered(t.orders).select("order_id", F.col("status_key").alias("cleaned_status"))
    return missing_from(orders, t.deliveries, "order_id").select(
        "order_id", "cleaned_status", F.lit(None).cast("long").alias("delivery_id")
    )


def uncleaned_city_error(
    t: Tables, spelling: str = "Chennai", canonical: str = "chennai"
) -> DataFrame:
    """Revenue of a city once cleaned, under one raw spelling only, and what that misses."""
    spend = t.orders.groupBy("customer_id").agg(F.sum("order_amount").alias("revenue"))
    cities = t.customers.select("customer_id", "city", "city_key")
    return label_variant_error(
        spend.join(cities, "customer_id"),
        "city",
        "city_key",
        "revenue",
        spelling=spelling,
        canonical=canonical,
    )


def cancelled_with_delivery(t: Tables) -> DataFrame:
    """Delivery rows of cancelled orders."""
    orders = t.orders.select("order_id", "status", "status_key")
    attempts = t.deliveries.select("order_id", "delivery_status")
    return conflicts(attempts, orders, ["order_id"], is_cancelled()).select(
        "delivery_status", "order_id", "status"
    )


def cross_city_orders(t: Tables, aliases: Mapping[str, str] = CITY_ALIASES) -> DataFrame:
    """Orders whose restaurant is not in the customer's home city."""
    homes = t.customers.select(
        "customer_id", normalize_key(F.col("city"), aliases).alias("customer_city")
    )
    places = t.restaurants.select("restaurant_id", F.col("city_key").alias("restaurant_city"))
    located = t.orders.select("order_id", "customer_id", "restaurant_id").join(
        homes, "customer_id"
    )
    differ = F.col("customer_city") != F.col("restaurant_city")
    return (
        conflicts(located, places, ["restaurant_id"], differ)
        .select("customer_id", "order_id", "customer_city", "restaurant_city")
        .orderBy("customer_id", "order_id")
    )


def join_inflated_revenue(t: Tables) -> DataFrame:
    """Revenue summed after joining orders to delivery attempts, against order-grain revenue."""
    return join_inflation(
        t.orders.select("order_id", "order_amount"), t.deliveries, "order_id", "order_amount"
    )


def cross_city_agents(t: Tables) -> DataFrame:
    """Deliveries by an agent registered in another city than the restaurant's."""
    places = t.restaurants.select("restaurant_id", F.col("city_key").alias("restaurant_city"))
    bases = t.agents.select("agent_id", F.col("city_key").alias("agent_city"))
    orders = t.orders.select("order_id", "restaurant_id").join(places, "restaurant_id")
    attempts = t.deliveries.select("order_id", "agent_id").join(bases, "agent_id")
    differ = F.col("agent_city") != F.col("restaurant_city")
    return conflicts(attempts, orders, ["order_id"], differ).select(
        "order_id", "agent_id", "agent_city", "restaurant_city"
    )

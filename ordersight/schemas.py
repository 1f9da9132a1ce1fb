"""Declared schemas of the five logical tables, as they arrive (raw text kept as text)."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(12, 2)

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("restaurant_id", T.LongType()),
        T.StructField("order_date", T.StringType()),
        T.StructField("order_amount", AMOUNT),
        T.StructField("status", T.StringType()),
        T.StructField("delivery_time_minutes", T.IntegerType()),
    ]
)

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("signup_date", T.StringType()),
    ]
)

RESTAURANTS = T.StructType(
    [
        T.StructField("restaurant_id", T.LongType()),
        T.StructField("restaurant_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("city", T.StringType()),
    ]
)

DELIVERIES = T.StructType(
    [
        T.StructField("delivery_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("agent_id", T.LongType()),
        T.StructField("delivery_status", T.StringType()),
        T.StructField("delivery_rating", T.IntegerType()),
    ]
)

AGENTS = T.StructType(
    [
        T.StructField("agent_id", T.LongType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("city", T.StringType()),
    ]
)

# Columns the cleaning step adds; see sources/clean.py.
CLEAN_ORDERS = T.StructType(
    ORDERS.fields
    + [
        T.StructField("status_key", T.StringType()),
        T.StructField("order_dt", T.DateType()),
        T.StructField("order_month", T.DateType()),
    ]
)
CLEAN_CUSTOMERS = T.StructType(
    CUSTOMERS.fields
    + [T.StructField("city_key", T.StringType()), T.StructField("signup_dt", T.DateType())]
)
CLEAN_RESTAURANTS = T.StructType(RESTAURANTS.fields + [T.StructField("city_key", T.StringType())])
CLEAN_DELIVERIES = T.StructType(
    DELIVERIES.fields + [T.StructField("delivery_status_key", T.StringType())]
)
CLEAN_AGENTS = T.StructType(AGENTS.fields + [T.StructField("city_key", T.StringType())])

RAW = {
    "orders": ORDERS,
    "customers": CUSTOMERS,
    "restaurants": RESTAURANTS,
    "deliveries": DELIVERIES,
    "delivery_agents": AGENTS,
}
CLEAN = {
    "orders": CLEAN_ORDERS,
    "customers": CLEAN_CUSTOMERS,
    "restaurants": CLEAN_RESTAURANTS,
    "deliveries": CLEAN_DELIVERIES,
    "delivery_agents": CLEAN_AGENTS,
}

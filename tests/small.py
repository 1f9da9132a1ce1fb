"""Literal tables of a few rows, with defaults for columns a test does not care about."""

from decimal import Decimal

from ordersight import Tables, schemas

DEFAULTS = {
    "orders": {
        "order_id": 1,
        "customer_id": 1,
        "restaurant_id": 1,
        "order_date": "2024-01-10",
        "order_amount": 100,
        "status": "Delivered",
        "delivery_time_minutes": 30,
    },
    "customers": {
        "customer_id": 1,
        "customer_name": "Asha",
        "city": "Chennai",
        "signup_date": "2022-03-14",
    },
    "restaurants": {
        "restaurant_id": 1,
        "restaurant_name": "Dosa Corner",
        "category": "South",
        "city": "Chennai",
    },
    "deliveries": {
        "delivery_id": 1,
        "order_id": 1,
        "agent_id": 1,
        "delivery_status": "delivered",
        "delivery_rating": 4,
    },
    "delivery_agents": {"agent_id": 1, "agent_name": "Ravi", "city": "Chennai"},
}


def table(spark, name, rows):
    """Rows given as dicts; the key column counts up where a row leaves it out."""
    defaults = DEFAULTS[name]
    key = next(iter(defaults))
    complete = []
    for position, row in enumerate(rows, start=1):
        full = {**defaults, key: position, **row}
        if full.get("order_amount") is not None and name == "orders":
            full["order_amount"] = Decimal(full["order_amount"])
        complete.append(tuple(full[f] for f in schemas.RAW[name].names))
    return spark.createDataFrame(complete, schemas.RAW[name])


def tables(spark, **rows):
    return Tables.of(
        **{name: table(spark, name, rows.get(name, [{}])) for name in schemas.RAW}
    )


def values(df, *columns):
    """Rows as tuples, decimals as floats, in the order given by the frame."""
    picked = df.select(*columns) if columns else df
    return [
        tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in picked.collect()
    ]

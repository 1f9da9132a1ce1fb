"""Business analytics over order-and-delivery data, written as Spark DataFrame plans."""

from ordersight.sources.tables import Tables

__all__ = ["Tables"]

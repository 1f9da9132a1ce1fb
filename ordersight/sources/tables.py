"""The five tables as one object, with readers and writers for the raw and the clean layer."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ordersight import schemas
from ordersight.sources.clean import CLEANERS

NAMES = tuple(schemas.RAW)


@dataclass(frozen=True)
class Tables:
    """Cleaned logical tables. Frames are made on first use and cost nothing until read."""

    load: Callable[[str], DataFrame]

    def table(self, name: str) -> DataFrame:
        return CLEANERS[name](self.load(name))

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def customers(self) -> DataFrame:
        return self.table("customers")

    @property
    def restaurants(self) -> DataFrame:
        return self.table("restaurants")

    @property
    def deliveries(self) -> DataFrame:
        return self.table("deliveries")

    @property
    def agents(self) -> DataFrame:
        return self.table("delivery_agents")

    @classmethod
    def of(cls, **frames: DataFrame) -> "Tables":
        """From frames named orders, customers, restaurants, deliveries, delivery_agents."""
        return cls(frames.__getitem__)

    def with_orders(self, change: Callable[[DataFrame], DataFrame]) -> "Tables":
        """The same tables with the orders changed, for example restricted to a date range."""
        load = self.load

        def changed(name: str) -> DataFrame:
            frame = load(name)
            return change(CLEANERS[name](frame)) if name == "orders" else frame

        return replace(self, load=changed)


def read_raw(spark: SparkSession, root: str, fmt: str = "parquet", **options) -> Tables:
    """Read ``root/<table>`` in any file format Spark knows, under the declared schema."""

    def load(name: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**options).schema(schemas.RAW[name])
        return reader.load(f"{root}/{name}")

    return Tables(load)


def read_clean(spark: SparkSession, root: str) -> Tables:
    """Read what ``write_clean`` wrote: filters on keys and months reach the files."""
    return Tables(lambda name: spark.read.schema(schemas.CLEAN[name]).parquet(f"{root}/{name}"))


def write_clean(tables: Tables, root: str, mode: str = "errorifexists") -> None:
    """Store the clean layer as parquet, orders in one folder per month."""
    for name in NAMES:
        frame = tables.table(name)
        if name == "orders":
            by_month(frame, "order_month").mode(mode).parquet(f"{root}/{name}")
        else:
            frame.write.mode(mode).parquet(f"{root}/{name}")


def by_month(frame: DataFrame, month: str) -> DataFrameWriter:
    """A writer with one folder per month.

    The rebalance hint gathers a month into few files and still splits a month that is too
    large for one task.
    """
    return frame.hint("rebalance", F.col(month)).write.partitionBy(month)


def overwrite_months(
    frame: DataFrame, path: str, month: str, months: Sequence[date | None] | None = None
) -> None:
    """Write ``frame`` by month, or only its rows of ``months`` over what was stored for them.

    Files of other months stay as they are, so running it again changes no row. A month without rows is left empty.
    ``frame`` must not read from ``path``.
    """
    if months is None:
        by_month(frame, month).mode("overwrite").parquet(path)
        return
    asked = list(dict.fromkeys(months))
    known = [m for m in asked if m is not None]
    wanted = F.col(month).isin(known) if known else F.lit(False)
    if None in asked:
        wanted = wanted | F.col(month).isNull()
    rows = frame.filter(wanted)
    by_month(rows, month).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    stored = frame.sparkSession.read.schema(frame.schema).parquet(path).filter(wanted)
    left = {r[0] for r in rows.select(month).distinct().collect()}
    # Dynamic overwriting passes over months that have no rows any more.
    for gone in {r[0] for r in stored.select(month).distinct().collect()} - left:
        folder = "__HIVE_DEFAULT_PARTITION__" if gone is None else gone.isoformat()
        rows.drop(month).limit(0).write.mode("overwrite").parquet(f"{path}/{month}={folder}")


def months_of(orders: DataFrame) -> list[date | None]:
    """The months that some clean orders belong to; a calendar bounds their number."""
    return [r[0] for r in orders.select("order_month").distinct().collect()]


def refresh_months(tables: Tables, root: str, months: Sequence[date | None]) -> None:
    """Write the orders of some months of the clean layer anew from ``tables``."""
    overwrite_months(tables.orders, f"{root}/orders", "order_month", months)


def refresh_late(tables: Tables, late: DataFrame, root: str) -> list[date | None]:
    """Re-open the months of ``late`` orders, which ``tables`` already holds, and no others."""
    months = months_of(CLEANERS["orders"](late))
    refresh_months(tables, root, months)
    return months

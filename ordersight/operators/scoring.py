"""Rating spread and weighted scores."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.functions import exact_ratio


def rating_spread(df: DataFrame, rating: str) -> list[Column]:
    """Count, sum and sum of squares of a rating: enough for mean and variance.

    The rating must be a whole number or a decimal with up to three places.
    """
    kind = df.schema[rating].dataType
    if isinstance(kind, T.IntegralType):
        value = F.col(rating).cast("long")
    elif isinstance(kind, T.DecimalType) and kind.scale <= 3:
        value = F.col(rating)
    else:
        raise TypeError(f"{rating} is {kind.simpleString()}: cast it to an integer or a decimal")
    return [
        F.count(value).alias("rated"),
        F.sum(value).alias("rating_sum"),
        F.sum(value * value).alias("rating_squares"),
    ]


def weighted_score(weights: Mapping[str, str], places: int) -> Column:
    """Weighted sum of decimal components; NULL if any component is NULL.

    Weights are decimal text (``'0.50'``), so the sum is exact before it is rounded.
    """
    total = None
    for component, weight in weights.items():
        part = F.col(component) * F.lit(weight).cast("decimal(4,2)")
        total = part if total is None else total + part
    return F.round(total, places)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: how many rows have both values, the slope of ``y`` over ``x`` and their correlation.

    Whole numbers or decimals with up to two places. All sums are exact; NULL without spread.
    """
    both = df.select(F.col(x).cast("decimal(18,2)").alias("x"), F.col(y).cast("decimal(18,2)").alias("y")).dropna()
    sums = both.agg(
        F.count("x").alias("pairs"),
        *[F.sum(F.col(a) * F.col(b)).alias(f"_{a}{b}") for a, b in ("xx", "xy", "yy")],
        *[F.sum(a).alias(f"_{a}") for a in "xy"],
    )

    def spread(a: str, b: str) -> Column:
        return F.col("pairs").cast("decimal(18,0)") * F.col(f"_{a}{b}") - F.col(f"_{a}") * F.col(f"_{b}")

    width = F.sqrt(spread("x", "x").cast("double")) * F.sqrt(spread("y", "y").cast("double"))
    return sums.select(
        "pairs",
        exact_ratio(spread("x", "y"), spread("x", "x"), 4).alias("slope"),
        (spread("x", "y").cast("double") / F.nullif(width, F.lit(0.0))).alias("correlation"),
    )

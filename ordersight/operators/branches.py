"""Reading one aggregate in several branches of a plan."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_branches(df: DataFrame) -> DataFrame:
    """``df`` with every column in use, whatever a branch selects from it later.

    Column pruning would give each branch its own, slightly narrower aggregate and so its own
    scan and shuffle of the facts. The condition holds for every row; it only mentions all
    columns, so that the branches plan the same aggregate and reuse its exchange. Use it on
    aggregates, and on raw rows only where all branches need nearly all of their columns.
    """
    return df.filter(F.hash(*df.columns) >= F.lit(-(2**31)))

"""Ranks and top-k with ties.

A rank window over all rows, or over one hot group, would bring every tied row into a single
task. Here the distinct values are counted first (partial aggregation collapses ties before
the shuffle), the few best values get their rank, and the rows pick their rank up by an
equality join. Ranked columns must be exact types (integer, decimal, date, text).

NULL sorts as the largest value, first when descending and last when ascending, unless
``nulls`` says otherwise.
"""

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.operators.branches import for_branches

Ties = Literal["none", "rank", "dense"]


def sort_order(by: str, descending: bool = True, nulls: str | None = None) -> Column:
    nulls = nulls or ("first" if descending else "last")
    direction = "desc" if descending else "asc"
    return getattr(F.col(by), f"{direction}_nulls_{nulls}")()


def rank_table(
    df: DataFrame,
    by: str,
    k: int,
    *,
    ties: Ties = "rank",
    within: Sequence[str] = (),
    descending: bool = True,
    nulls: str | None = None,
    weight: str | None = None,
    name: str = "rnk",
) -> DataFrame:
    """Values of ``by`` whose rank is at most ``k``, one row each, with that rank.

    ``weight`` counts a row as that many rows. The result holds at most ``k`` rows for every
    ``within`` group, however many rows tie.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    values = df.groupBy(*within, by).agg(rows.alias("_rows"))
    order = sort_order(by, descending, nulls)
    ordered = Window.partitionBy(*within).orderBy(order)
    if within:
        best = values.withColumn("_place", F.row_number().over(ordered)).filter(
            F.col("_place") <= k
        )
    else:
        best = values.orderBy(order).limit(k).withColumn("_place", F.row_number().over(ordered))
    if ties == "rank":
        ahead = F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        rank = (F.coalesce(ahead, F.lit(0)) + 1).cast("long")
    else:
        rank = F.col("_place").cast("long")
    return best.select(*within, by, rank.alias(name)).filter(F.col(name) <= k)


def join_ranks(
    df: DataFrame, ranks: DataFrame, by: str, *, within: Sequence[str] = (), name: str = "rnk"
) -> DataFrame:
    """Rows of ``df`` whose value is in ``ranks``, with its rank; NULL equals NULL."""
    keys = [*within, by]
    renamed = ranks.select(*[F.col(c).alias(f"_r_{c}") for c in keys], name)
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(renamed, match).select(*df.columns, name)


def cut_to_ranks(df: DataFrame, ranks: DataFrame, by: str, *, descending: bool = True) -> DataFrame:
    """Rows of ``df`` whose value is among ``ranks``, the best values of ``by`` over all rows.

    The best values reach from the first to the last of them, so one row with the last cuts any frame that
    holds ``by``: before its joins, without a shuffle by a column of few values.
    """
    last = F.min(by) if descending else F.max(by)
    edge = ranks.agg(last.alias("_last"), F.max(F.col(by).isNull()).alias("_with_null"))
    inside = F.col(by) >= F.col("_last") if descending else F.col(by) <= F.col("_last")
    kept = F.when(F.col(by).isNull(), F.col("_with_null")).otherwise(inside)
    return df.crossJoin(F.broadcast(edge)).filter(kept).select(*df.columns)


def with_group_sizes(df: DataFrame, **sizes: str) -> DataFrame:
    """Add ``name=column``: how many rows share the row's value of each column, NULL included.

    Counted by aggregate and join, so that a value of very many rows is never in one task's window.
    """
    out = df
    for name, column in sizes.items():
        # NULL as a key of its own, in plain columns: the counts are dealt as the rows are.
        keys = {"_none": F.col(column).isNull(), "_key": F.coalesce(F.col(column).cast("string"), F.lit(""))}
        counts = df.select(*[e.alias(k) for k, e in keys.items()]).groupBy(*keys)
        out = out.withColumns(keys).join(counts.agg(F.count(F.lit(1)).alias(name)), list(keys)).drop(*keys)
    return out


def top_k(
    df: DataFrame,
    by: str,
    k: int,
    *,
    ties: Ties = "rank",
    within: Sequence[str] = (),
    descending: bool = True,
    nulls: str | None = None,
    tie_break: Sequence[str] = (),
    name: str = "rnk",
) -> DataFrame:
    """The ``k`` best rows of an aggregate by one column, over all rows or within groups.

    ``ties='none'`` cuts at exactly ``k`` rows in the order ``by, *tie_break`` and adds no
    column; ``'rank'`` and ``'dense'`` keep every row whose rank is at most ``k``.
    """
    if ties == "none":
        order = [sort_order(by, descending, nulls), *tie_break]
        if not within:
            return df.orderBy(*order).limit(k)
        place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
    rows = for_branches(df)
    ranks = rank_table(
        rows, by, k, ties=ties, within=within, descending=descending, nulls=nulls, name=name
    )
    return join_ranks(rows, ranks, by, within=within, name=name)


def global_rank(
    df: DataFrame,
    by: str,
    *,
    descending: bool = True,
    nulls: str | None = None,
    name: str = "rnk",
    parts: int = 256,
) -> DataFrame:
    """Every row of an aggregate with its rank over all rows, without a single-task window.

    Distinct values (numbers or dates) are cut into ``parts`` ranges at approximate quantiles
    and numbered inside their range; the offset of a range is the row count of those before
    it. One row carries the cuts together with the offsets they lead to, so both always belong
    together, and neither where the cuts fall nor a lost executor changes a rank.
    """
    order = sort_order(by, descending, nulls)
    df = for_branches(df)
    values = for_branches(df.groupBy(by).agg(F.count(F.lit(1)).alias("_rows")))
    shares = [i / parts for i in range(1, parts)]
    cuts = values.agg(F.percentile_approx(by, shares, 20 * parts).alias("_cuts"))

    def in_parts(one_row: DataFrame) -> DataFrame:
        below = F.size(F.filter("_cuts", lambda cut: cut < F.col(by)))
        part = F.when(F.col(by).isNotNull(), below)  # NULL is a range of its own
        return values.crossJoin(F.broadcast(one_row)).withColumn("_part", part)

    sizes = in_parts(cuts).groupBy("_part").agg(
        F.sum("_rows").alias("_size"), F.first("_cuts").alias("_cuts")
    )
    # One row per range, so this window is as small as their number.
    before = Window.orderBy(sort_order("_part", descending, nulls)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offset = F.struct(
        F.coalesce("_part", F.lit(-1)).alias("part"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("rows"),
    )
    offsets = sizes.select("_cuts", offset.alias("_offset")).agg(
        F.first("_cuts").alias("_cuts"),
        F.map_from_entries(F.collect_list("_offset")).alias("_offsets"),
    )
    ahead = (
        Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("_rows").over(ahead), F.lit(0))
    offset_of = F.col("_offsets")[F.coalesce("_part", F.lit(-1))]
    ranks = in_parts(offsets).select(
        F.col(by).alias("_value"), (offset_of + inside + 1).cast("long").alias(name)
    )
    return df.join(ranks, F.col(by).eqNullSafe(F.col("_value"))).select(*df.columns, name)

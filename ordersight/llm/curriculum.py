"""Mixing sources to target weights along a curriculum that changes over time.

Every source has a weight, a target number of words, and a schedule: its relative weight as a
piecewise linear function of training time 0 to 1. The integral of the schedule, scaled to the
words taken, is the source's cumulative demand. Documents of a source stand in a fixed random
order; the place of a copy in that order, counted in words and over the epochs, is put through
the inverse of the demand and gives its training position.

Targets: the words of all sources are shared by weight; a target stops at ``most`` times its
source's words and the excess is shared again by weight among the rest until none is above.
Whole documents are taken: every one ``floor(target / words)`` times, then once more those first
in order whose middle lies before what is left. So a source is off its target by at most half a
document and no document is taken more than ``ceil(most)`` times.

NULL text has no words. NULL is a source of its own, the last. Ids decide the order (md5, then
size, then a hash of the text); a NULL id counts as an empty one. Repeated rows are documents of
their own. An empty table gives an empty result. Columns with the names that are added are
replaced.

Sums along the order are made in slices of the order: totals per source and slice, offsets from
those totals, and a window inside a slice only, so a source with most rows spreads over its slices.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.store import same, stored

WORD = r"[^\x20\x09-\x0D]+"
Schedule = Sequence[tuple[float, float]]

ADDED = ("size", "source_size", "target", "copies", "taken", "positions")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Segments ``(t0, w0, t1, w1, area before)`` of a piecewise linear weight, total area 1."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1:
        raise ValueError("a schedule runs from time 0 to time 1")
    segments, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("times must increase and weights must not be negative")
        segments.append((t0, w0, t1, w1, area))
        area += (w0 + w1) / 2 * (t1 - t0)
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    return [(t0, w0 / area, t1, w1 / area, a / area) for t0, w0, t1, w1, a in segments]


def invert(share: Column, schedule: Schedule) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its total."""
    time = F.lit(1.0)
    for t0, w0, t1, w1, before in reversed(integral(schedule)):
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(share - before, F.lit(0.0))
        # w0 x + slope x^2 / 2 = rest, solved without dividing by a slope near 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (root + w0))
        after = before + (w0 + w1) / 2 * (t1 - t0)
        time = F.when(share < after, F.lit(t0) + x).otherwise(time)
    return F.least(time, F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``target`` from ``source, source_size`` rows.

    The windows without keys see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.array(*[F.lit(w).cast("long") for w in weights])[turn])
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    # Sources meet their cap in the order of cap to weight; each is tried with those before at theirs.
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    none = F.lit(0).cast("long")
    tried = ranked.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), none)).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none)).alias("open"),
    ).withColumn("full", F.col("left") * F.col("weight") > F.col("cap") * F.col("open"))
    left = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(none)).over(every)
    open_ = F.sum(F.when(F.col("full"), none).otherwise(F.col("weight"))).over(every)
    shared = (F.col("weight") * left).cast("double") / open_.cast("double")
    return tried.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    schedules: Mapping[int, Schedule] | None = None,
    slices: int = 1 << 16,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` and ``positions`` added.

    ``positions`` holds one training position for each copy. ``schedules`` gives a schedule by
    weight; other weights are constant over time.
    """
    docs = docs.drop(*ADDED)
    hashed = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")))
    # The leading 32 bits of the order, cut into equal slices.
    part = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") * slices / (1 << 32)).cast("int")
    sized = docs.select(
        "*",
        word_count(F.col(text)).alias("size"),
        hashed.alias("_order"),
        part.alias("_slice"),
    )
    totals = stored(
        sized.groupBy(F.col(source).alias("source"), F.col("_slice").alias("slice")).agg(
            F.sum("size").alias("words")
        ),
        "mix-totals",
    )
    targets = source_targets(
        totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most
    )
    before = (
        Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan = ahead.join(
        targets.withColumnRenamed("source", "_s"), same(F.col("source"), F.col("_s"))
    ).select(
        F.col("source").alias("_p_source"),
        F.col("slice").alias("_p_slice"),
        F.col("ahead").alias("_ahead"),
        F.col("source_size"),
        F.col("weight").alias("_weight"),
        F.col("target"),
    )
    inside = (
        Window.partitionBy("_p_source", "_p_slice")
        .orderBy("_order", "size", F.xxhash64(text))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.join(
        plan, same(F.col(source), F.col("_p_source")) & (F.col("_slice") == F.col("_p_slice"))
    ).withColumn(
        "_begin", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    epochs = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(F.lit(0))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    extra = (F.col("size") > 0) & (2 * F.col("_begin") + F.col("size") <= 2 * rest)
    counted = placed.withColumn("_epochs", epochs.cast("long")).withColumn(
        "copies", F.col("_epochs") + F.when(extra, F.lit(1)).otherwise(F.lit(0))
    )
    share = lambda e: F.when(
        F.col("target") > 0,
        (e * F.col("source_size") + F.col("_begin") + F.col("size") / 2) / F.col("target"),
    ).otherwise(F.lit(0.0))

    def time(u: Column) -> Column:
        out = u
        for weight, schedule in (schedules or {}).items():
            out = F.when(F.col("_weight") == weight, invert(u, schedule)).otherwise(out)
        return F.least(out, F.lit(1.0))

    shares = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.col("copies") - 1, F.lit(0))), share
    )
    positions = F.when(F.col("copies") > 0, F.transform(shares, time)).otherwise(
        F.array().cast("array<double>")
    )
    return counted.select(
        *[c for c in docs.columns],
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        positions.alias("positions"),
    )


def training_order(mixed: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """One row per copy with its ``position``, range-sorted by it; ``id`` splits equal positions."""
    rows = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return rows.orderBy("position", id)

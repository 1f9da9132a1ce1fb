"""Connected components of an edge table, and comparing the members of groups in bounded blocks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is its smallest node.

    In each round every node with a smaller neighbour points to its smallest one; pointers are
    followed to their ends, and both ends of every edge are replaced by those. Edges inside
    a component vanish, so rounds are few. A node with very many edges is pre-aggregated in the
    minimum, and the joins on it are split by adaptive execution. NULLs are ignored.
    """
    left = stored(
        edges.filter("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    label = stored(
        left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("component")),
        "labels",
    )
    while True:
        left = left.filter("a > b")
        points = stored(left.groupBy("a").agg(F.min("b").alias("b")), "pointers")
        if points.isEmpty():
            return label
        while True:  # follow pointers to the ends, twice as far each time
            ends = points.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
            moved = points.join(ends, points["b"] == ends["_a"], "left").select(
                "a", F.coalesce("_b", "b").alias("b"), F.col("_b").isNotNull().alias("moved")
            )
            moved = stored(moved, "pointers")
            points = moved.select("a", "b")
            if moved.filter("moved").isEmpty():
                break
        to = points.select(F.col("a").alias("_from"), F.col("b").alias("_to"))

        def follow(df: DataFrame, column: str, to: DataFrame = to) -> DataFrame:
            return (
                df.join(to, df[column] == to["_from"], "left")
                .withColumn(column, F.coalesce("_to", column))
                .drop("_from", "_to")
            )

        label = stored(follow(label, "component"), "labels")
        moved_edges = follow(follow(left, "a"), "b").filter("a <> b")
        left = stored(
            moved_edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
        )


def in_blocks(members: DataFrame, chunk: int, reach: int = 0) -> DataFrame:
    """``members (group, member, band)`` dealt so that any two of a group whose bands differ by
    ``reach`` at most meet in some ``(group, low, high)``; ``cell`` tells them apart.

    A group of up to ``chunk`` members is one block. A larger one is cut by band, and a band into cells of
    about ``chunk`` members; a block holds one or two cells. No block grows with its group.
    """
    wide = Window.partitionBy("group")  # a row for each band of a group
    bands = members.groupBy("group", "band").agg(F.count(F.lit(1)).alias("n"))
    bands = bands.withColumn("whole", F.sum("n").over(wide) <= chunk)
    plan = stored(  # a plain table, so that the join splits a group of very many members
        bands.select(
            F.col("group").alias("_group"),
            F.col("band").alias("_band"),
            F.when(F.col("whole"), F.lit(1)).otherwise(F.ceil(F.col("n") / chunk)).cast("int").alias("_cells"),
            F.when(F.col("whole"), F.lit(0)).otherwise(F.col("band")).alias("_used"),
        ),
        "block-plan",
    )
    cells = plan.select(
        F.col("_group").alias("g"), F.col("_used").alias("u"), F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("c")
    ).distinct()
    name = lambda u, c: F.shiftleft(F.col(u).cast("long"), 32) + F.col(c)
    cells = cells.select("g", "u", name("u", "c").alias("cell"))
    other = cells.select(F.col("g").alias("g2"), F.col("u").alias("u2"), F.col("cell").alias("cell2"))
    blocks = stored(
        cells.join(other, (F.col("g") == F.col("g2")) & (F.abs(F.col("u") - F.col("u2")) <= reach)).select(
            F.col("g").alias("_g"),
            F.col("cell").alias("_c"),
            F.least("cell", "cell2").alias("low"),
            F.greatest("cell", "cell2").alias("high"),
        ),
        "blocks",
    )
    dealt = members.join(
        plan, (F.col("group") == F.col("_group")) & (F.col("band") == F.col("_band"))
    ).select(
        "group",
        "member",
        (
            F.shiftleft(F.col("_used").cast("long"), 32)
            + F.pmod(F.xxhash64("member", F.lit(7)), F.col("_cells"))
        ).alias("cell"),
    )
    return dealt.join(
        blocks, (F.col("group") == F.col("_g")) & (F.col("cell") == F.col("_c"))
    ).select("group", "member", "cell", "low", "high")

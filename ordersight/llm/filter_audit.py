"""How document filters interact: what each removes at every place of every order.

A document's failed filters are a bit mask, so a part of the corpus is described by the counts of its
mask cells. A recursive CTE then extends filter prefixes by each unused letter, joins the cells of
the part and carries the bits applied so far; every level works out its step's figures.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.store import stored, with_package

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_CAPITALS_PCT = 2
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails; A is the lowest."""
    data = text.encode()
    words = data.split()  # of bytes: cuts at the blanks of ASCII and nowhere else
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PCT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS_PCT * len(text)) << 2
        | (len(data.translate(None, SYMBOLS)) < len(data)) << 3
    )


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, keys = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            masks.append(text_mask(text))
            keys.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())],
            ["doc_id", "part", "mask", "text_key"],
        )


def failed_filters(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` of every row of ``docs`` (doc_id, text, source).

    A: fewer than 200 words. B: distinct words below half of all. C: capitals above 2 % of the code
    points. D: any of ``#$%&*|``. E: the text of a smaller doc_id. A NULL text is empty, a
    NULL source is the part ''. Rows that repeat an id with its text fail E together or not at all; a NULL id
    neither fails E nor makes another row fail.

    The first id of a text is found with partial aggregation and joined by text and id together, so that rows of
    a text with very many copies spread over all partitions.
    """
    read = with_package(docs).select(
        "doc_id", "text", F.coalesce("source", F.lit("")).alias("part")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    flags = stored(
        read.mapInArrow(_masks, f"doc_id {kind}, part string, mask int, text_key binary"), "filter-masks"
    )
    firsts = (
        flags.groupBy("text_key")
        .agg(F.min("doc_id").alias("doc_id"))
        .filter(F.col("doc_id").isNotNull())
        .withColumn("first", F.lit(True))
    )
    named = flags.filter(F.col("doc_id").isNotNull()).join(firsts, ["text_key", "doc_id"], "left")
    copies = F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))
    return named.select("doc_id", "part", F.col("mask").bitwiseOR(copies).alias("mask")).unionByName(
        flags.filter(F.col("doc_id").isNull()).select("doc_id", "part", "mask")
    )


def mask_cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part with its cells: mask, documents, and how many are labelled good or toxic.

    ``labels`` (doc_id, quality, toxic) may miss documents; of several rows of an id, any that says so counts.
    """
    judged = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    cells = (
        failed.join(judged, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )
    # At most 2 ** len(LETTERS) cells a part.
    return cells.groupBy("part").agg(
        F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells")
    )


def _sum(count: str, condition: str) -> str:
    return f"aggregate(c.cells, 0L, (n, x) -> n + if({condition}, x.{count}, 0L))"


def audit_sql(letters: str) -> str:
    """The recursion over ``{cells}`` as text: prefixes of ``letters`` with the figures of their steps."""
    pairs = ", ".join(f"struct('{x}' as letter, {1 << i} as bit)" for i, x in enumerate(letters))
    fails, earlier = "(x.mask & l.bit) != 0", "(x.mask & s.applied) != 0"
    removed = f"{fails} and not ({earlier})"
    figures = {
        "kept": _sum("docs", "(x.mask & (s.applied | l.bit)) = 0"),
        "removed": _sum("docs", removed),
        "redundant": _sum("docs", f"{fails} and {earlier}"),
        "unique_fails": _sum("docs", "x.mask = l.bit"),
        "good_lost": _sum("good", removed),
        "toxic_lost": _sum("toxic", removed),
    }
    columns = ", ".join(f"{value} as {name}" for name, value in figures.items())
    empty = "array<struct<letter: string, " + ", ".join(f"{n}: bigint" for n in figures) + ">>"
    return f"""
    with recursive prefixes(part, filter_order, applied, step, steps) as (
      select part, '', 0, 0, cast(array() as {empty}) from {{cells}}
      union all
      select s.part, concat(s.filter_order, l.letter), s.applied | l.bit, s.step + 1,
             concat(s.steps, array(struct(l.letter as letter, {columns})))
      from prefixes s join {{cells}} c on s.part = c.part
      lateral view inline(filter(array({pairs}), p -> (s.applied & p.bit) = 0)) l as letter, bit
    )
    select part, filter_order, steps from prefixes where step = {len(letters)}"""


def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every order of ``letters`` on every part of ``cells``, one row per step.

    ``shapley`` is what the step's filter removes, added up over all orders at any place.
    An empty table gives no rows. The recursion has one row per part and prefix, 326 a part for five letters.
    """
    cells = stored(cells, "mask-cells")
    conf, limit = cells.sparkSession.conf, "spark.sql.cteRecursionRowLimit"
    usual = conf.get(limit)
    conf.set(limit, "-1")  # the rows grow with the parts, the levels do not
    try:
        orders = stored(cells.sparkSession.sql(audit_sql(letters), cells=cells), "filter-orders")
    finally:
        conf.set(limit, usual)
    steps = orders.select("part", "filter_order", F.posexplode("steps").alias("place", "s"))
    of_filter = Window.partitionBy("part", "s.letter")
    return steps.select(
        "part",
        "filter_order",
        (F.col("place") + 1).alias("step"),
        *[F.col(f"s.{name}").alias(name) for name in FIGURES],
        F.sum("s.removed").over(of_filter).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit_orders(mask_cells(failed_filters(docs), labels))

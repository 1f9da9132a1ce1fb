"""Lines that many documents share are dropped everywhere. Built-in expressions only.

Each line is normalised and hashed to 128 bits; documents are counted per hash with partial
aggregation, so a line of every document arrives as one row per task. The positions of lines
over the threshold go back to their documents, whose other lines are joined in order.

Every row counts as a document of its own. A NULL or empty text is one empty line. Lines whose
key is shorter than ``min_chars`` stay. Rows equal in id and text get the same result, NULL ids
included; an empty table gives an empty result. Other columns are passed through unchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm.store import BLANKS, ascii_lower, same, stored, unused


def line_keys(text: Column, min_chars: int) -> Column:
    """One hash pair per line, NULL where the key is too short to count."""
    keys = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: ascii_lower(F.btrim(line, F.lit(BLANKS))),
    )
    return F.transform(
        keys,
        lambda key: F.when(
            F.length(key) >= min_chars,
            F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")),
        ),
    )


def drop_common_lines(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """``docs`` with ``text`` rewritten, and the columns ``n_lines`` and ``n_dropped`` added.

    Columns of those two names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    mark, lines, where = (unused(docs, c) for c in ("text_hash", "lines", "positions"))
    keyed = docs.select(
        F.col(id).alias("id"),
        F.xxhash64(text).alias("hash"),
        line_keys(F.col(text), min_chars).alias("keys"),
    )
    common = stored(  # a plain table, so that the join splits a line of very many documents
        keyed.select(F.explode(F.array_distinct("keys")).alias("key"))
        .filter("key is not null")
        .groupBy(F.col("key.h1").alias("c1"), F.col("key.h2").alias("c2"))
        .agg(F.count(F.lit(1)).alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .select("c1", "c2"),
        "common-lines",
    )
    placed = keyed.select("id", "hash", F.posexplode("keys").alias("pos", "key")).filter(
        "key is not null"
    )
    dropped = (
        placed.select("id", "hash", "pos", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"))
        .join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
        .groupBy(F.col("id").alias("_drop_id"), F.col("hash").alias("_drop_hash"))
        .agg(F.collect_set("pos").alias("_drop_at"))
    )
    split = docs.withColumns(
        {mark: F.xxhash64(text), lines: F.split(F.coalesce(F.col(text), F.lit("")), "\n")}
    ).drop(text)
    found = split.join(
        dropped,
        same(F.col(id), F.col("_drop_id")) & (F.col(mark) == F.col("_drop_hash")),
        "left",
    ).withColumn(
        where, F.coalesce(F.col("_drop_at"), F.array().cast("array<int>"))
    )
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(where))
    kept = F.array_join(F.transform(rest, lambda i: F.col(lines)[i]), "\n")
    values = {text: kept}
    return found.select(
        *[values.get(c, F.col(c)).alias(c) for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.size(where).cast("long").alias("n_dropped"),
    )

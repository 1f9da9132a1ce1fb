"""Quality rules: statistics of a text, and lines that too many documents of a host share.

One pass in Python gives each document its word statistics and a 64-bit hash and word count for
every normalised line; these small rows are stored. Lines are counted per host over documents
with different texts (copies of one text count once; they are a duplicate finder's business):
first one row per host, line and text, then a count, both with partial aggregation. Lines found
in more than ``max_docs`` texts of a host are removed from the documents of that host, and a document that
keeps less than ``min_left`` of its words is rejected.

Words are runs of anything but ASCII white space. NULL text has no words. A NULL host is a host of
its own. Rows equal in id, text and host get the same verdict. An empty table gives an empty
result. Texts are read whole. ``kept`` is never NULL.
"""

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.store import same, stored, with_package

SYMBOLS = "#*$%&|<>"

STATS = (
    "id bigint, host string, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, lines array<struct<key:bigint,words:int>>"
)
ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("host", pa.string()),
        ("text_hash", pa.int64()),
        *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("lines", pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int32())]))),
    ]
)


def repeated_words(words: list) -> int:
    """Words that lie in a window of three that occurs more than once."""
    seen: dict = {}
    covered = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        first = seen.setdefault(window, i)
        if first != i:
            covered[first : first + 3] = b"\1\1\1"
            covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)


def text_stats(text: str) -> tuple[int, int, int, int, int, list[dict]]:
    """Word count, characters in words, symbols, duplicate lines, repeated words, lines."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines, seen, repeats = [], set(), 0
    for line in raw.split(b"\n"):
        n = len(line.split())
        if n:
            repeats += line in seen
            seen.add(line)
            key = xxhash.xxh64_intdigest(b" ".join(line.lower().split()))
            lines.append({"key": key - (1 << 63), "words": n})
    return (
        len(words),
        len(text) - blanks,
        sum(map(text.count, SYMBOLS)),
        repeats,
        repeated_words(words),
        lines,
    )


def batch_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            stats = [text_stats(t or "") for t in part.column("text").to_pylist()]
            columns = list(zip(*stats))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("id", "host", "text_hash")]
                + [pa.array(c, f.type) for c, f in zip(columns, list(ARROW)[3:])],
                schema=ARROW,
            )


def document_stats(docs: DataFrame, *, id: str, text: str, host: str) -> DataFrame:
    """One small row per document, see ``STATS``."""
    return with_package(docs).select(
        F.col(id).cast("long").alias("id"),
        F.col(host).cast("string").alias("host"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
    ).mapInArrow(batch_stats, STATS)


def quality_verdicts(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = 100,
    min_left: float = 0.3,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """``id, host, text_hash``, the statistics, ``words_left``, ``base_failed`` and ``kept``."""
    stats = stored(document_stats(docs, id=id, text=text, host=host), "quality-stats")
    lines = stats.select("id", "host", "text_hash", F.explode("lines").alias("line")).select(
        "id", "host", "text_hash", F.col("line.key").alias("key"), F.col("line.words").alias("words")
    )
    common = stored(  # a plain table, so that the join splits a line of very many documents
        lines.groupBy("host", "key", "text_hash")
        .agg(F.lit(1).alias("one"))
        .groupBy(F.col("host").alias("_host"), F.col("key").alias("_key"))
        .agg(F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") > max_docs)
        .select("_host", "_key"),
        "quality-common",
    )
    removed = (
        lines.join(common, (F.col("key") == F.col("_key")) & same(F.col("host"), F.col("_host")))
        .groupBy(
            F.col("id").alias("_id"), F.col("host").alias("_h"), F.col("text_hash").alias("_hash")
        )
        # Rows equal in all three have the same lines: count one of them.
        .agg(F.sum("words").alias("_words"))
    )
    copies = stats.groupBy("id", "host", "text_hash").agg(
        *[F.first(c).alias(c) for c in STAT_COLUMNS], F.count(F.lit(1)).alias("rows")
    )
    judged = copies.join(
        removed,
        same(F.col("id"), F.col("_id"))
        & same(F.col("host"), F.col("_h"))
        & (F.col("text_hash") == F.col("_hash")),
        "left",
    ).withColumn(
        "words_left",
        F.col("n_words") - F.coalesce(F.col("_words") / F.col("rows"), F.lit(0)).cast("long"),
    )
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    return judged.select(
        "id",
        "host",
        "text_hash",
        "rows",
        *STAT_COLUMNS,
        "words_left",
        failed.alias("base_failed"),
        (~failed & (F.col("words_left") >= min_left * F.col("n_words"))).alias("kept"),
    )


STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    id, text, host = (rules.get(k, v) for k, v in (("id", "doc_id"), ("text", "text"), ("host", "source")))
    good = (
        quality_verdicts(docs, **rules)
        .filter("kept")
        .select(*[F.col(c).alias(f"_good_{c}") for c in ("id", "host", "text_hash")])
    )
    return docs.join(
        good,
        same(docs[id].cast("long"), F.col("_good_id"))
        & same(docs[host].cast("string"), F.col("_good_host"))
        & (F.xxhash64(docs[text]) == F.col("_good_text_hash")),
        "left_semi",
    )

"""Token counts of whole texts: a broadcast table of frequent pieces, worker caches for the rest.

A tokenizer that drops white space and never merges across it gives a text the tokens of its pieces
between white space. The pieces found most often, with their token counts, go to all workers as one small table;
a worker encodes what the table misses once and remembers it. No piece is ever shuffled.
"""

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core already

import pyarrow as pa  # noqa: E402
from pyspark import Broadcast  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from ordersight.llm.store import stored, with_package  # noqa: E402

#: The broadcast table holds at most FREQUENT pieces of at most SHORT characters, under 2 MB.
FREQUENT = 16_384
SHORT = 32
#: Of each task's pieces, this many are counted at once and FREQUENT are handed on.
COUNTED = 8 * FREQUENT
#: Characters that a worker's cache may hold.
CACHED_CHARS = 32_000_000
AT_ONCE = 4096
#: White space for str.split, yet text for the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def cuts_at_blanks(tokenizer: Tokenizer) -> bool:
    """Whether texts may be counted by their pieces, tried on pieces that other tokenizers merge with blanks."""
    trial = ["word", "7", ",", "'s", "\u0301", "x\u0301", "\U0001f600", "\xdf", "."]
    blanks = ["  ", "\t ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in SEPARATORS)]
    joined = [(a, b, a + blank + b) for a in trial for b in trial for blank in blanks]

    def ids(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]

    alone = dict(zip(trial, ids(trial)))
    whole = zip(joined, ids([text for _, _, text in joined]))
    return all(got == alone[a] + alone[b] for (a, b, _), got in whole) and not any(ids(blanks))


class PieceCounter:
    """Token counts of texts with the tokenizer of a file; special strings count as the library has them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = cuts_at_blanks(self.tokenizer)
        self.cache: dict[str, int] = {}
        self.chars = 0

    def encoded(self, texts: list[str]) -> Iterator[int]:
        for begin in range(0, len(texts), AT_ONCE):
            part = texts[begin : begin + AT_ONCE]
            for found in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                yield len(found.ids)

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        self.cache.update(zip(new, self.encoded(new)))
        self.chars += sum(map(len, new))

    def count(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        if not self.by_piece:
            return list(self.encoded(texts))
        counts = [0] * len(texts)
        for i, text in enumerate(texts):
            if self.chars > CACHED_CHARS:
                self.cache.clear()
                self.chars = 0
            if any(c in text for c in SEPARATORS):
                counts[i] = next(self.encoded([text]))
                continue
            pieces = text.split()
            found = list(map(frequent.get, pieces))
            if None in found:
                missed = [p for p, n in zip(pieces, found) if n is None]
                self.learn({p for p in missed if p not in self.cache})
                found = [n for n in found if n is not None]
                found.extend(map(self.cache.__getitem__, missed))
            counts[i] = sum(found)
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One for each worker process, kept between tasks."""
    return PieceCounter(path)


def _common_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that a task meets most often, and under NULL how many it met.

    Beyond COUNTED different ones, the rarer ones start anew.
    """
    counts: Counter[str] = Counter()
    total = 0
    for batch in batches:
        for value in batch.column(0):
            pieces = (value.as_py() or "").split()
            total += len(pieces)
            counts.update(pieces)
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(FREQUENT)))
    best = [(p, n) for p, n in counts.most_common(FREQUENT) if len(p) <= SHORT]
    yield pa.RecordBatch.from_arrays(
        [pa.array([None, *(p for p, _ in best)], pa.string()), pa.array([total, *(n for _, n in best)], pa.int64())],
        ["piece", "n"],
    )


def frequent_pieces(docs: DataFrame) -> list[str]:
    """Pieces that are at least one in FREQUENT of all pieces of all texts: FREQUENT at most.

    A task hands on at most FREQUENT pieces, so what is shuffled grows with the tasks and not with their texts.
    Which pieces these are only matters for speed.
    """
    counted = stored(docs.select("text").mapInArrow(_common_pieces, "piece string, n bigint"), "frequent-pieces")
    total = counted.filter(F.col("piece").isNull()).agg(F.sum("n")).first()[0] or 0
    sums = counted.filter(F.col("piece").isNotNull()).groupBy("piece").agg(F.sum("n").alias("n"))
    return [row.piece for row in sums.filter(F.col("n") * FREQUENT >= total).select("piece").collect()]


class Frequent:
    """Pieces and their token counts, packed: one text and one number each."""

    def __init__(self, pieces: list[str], path: str):
        self.pieces = "\n".join(pieces)
        self.counts = bytes(min(n, 255) for n in PieceCounter(path).encoded(pieces))

    def table(self) -> dict[str, int]:
        """Without what has no room for its count."""
        return {p: n for p, n in zip(self.pieces.split("\n"), self.counts) if p and n < 255}


def _count(
    batches: Iterator[pa.RecordBatch], path: str, frequent: Broadcast, limit: int
) -> Iterator[pa.RecordBatch]:
    table, pieces = frequent.value.table(), counter(path)
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        counts = pieces.count(texts, table)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """``doc_id``, bytes, tokens and whether they exceed ``limit``, for every row of ``docs``.

    A NULL text is empty: no bytes, no tokens. Repeated rows and NULL ids stay. ``tokenizer`` is a file of
    the tokenizers library; one that merges across white space is applied to whole texts instead.
    """
    docs = with_package(docs).select("doc_id", "text")
    frequent = docs.sparkSession.sparkContext.broadcast(Frequent(frequent_pieces(docs), tokenizer))
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return sized.mapInArrow(
        lambda batches: _count(batches, tokenizer, frequent, limit),
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )

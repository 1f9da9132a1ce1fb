"""Documents packed into token sequences, with bounds that certify the number of sequences.

Whole documents are tokenized and closed with ``end_id``; only longer ones than a sequence are
cut, the first piece taking the remainder. Pieces are dealt evenly into groups. A group is packed by
best-fit decreasing, and dual feasible functions bound the sequences its pieces need from below. Where both
agree the group is certified and final. Groups with a gap exchange their pieces: all of them
are dealt anew into fewer, larger groups, and packed again, until bound and count
agree, a round saves nothing, or one round has run at the largest group size.

A group holds at most ``max_group`` pieces, whatever the input. Numbers of groups follow the
input, and pieces are dealt by row number, so repeated rows, equal lengths and hot sources spread.

A NULL text is a document of the end id alone. NULL and repeated ids are allowed; a row is a document.
An empty table gives an empty result.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.store import stored, with_package
from ordersight.llm.tokens import encoder, slices

AT_ONCE = 1024  # texts that are encoded together
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
PACKED = PIECES + ", bin bigint, offset bigint, bins bigint, bound bigint, deal bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def batch_pieces(
    batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int
) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], "<u4").tobytes()
    rows: list = []
    for batch in batches:
        for part in slices(batch, "text", AT_ONCE):
            rows = []
            found = encoder(tokenizer).ids(pc.fill_null(part.column("text"), ""))
            for doc_id, ids in zip(part.column("id").to_pylist(), found):
                ids = memoryview(ids + end)
                for k, (start, size) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    rows.append((doc_id, k, start, size, crc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*rows), PIECES_ARROW)], schema=PIECES_ARROW
            )
    if rows:
        encoder(tokenizer).forget()  # the worker lives on, and other operators need the room


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int,
    *,
    id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
) -> DataFrame:
    """``doc_id, piece, start, length`` and ``ids_crc32`` of every piece. Ids must be integers."""
    return (
        with_package(docs)
        .select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        .mapInArrow(
            partial(batch_pieces, tokenizer=tokenizer, end_id=end_id, capacity=capacity), PIECES
        )
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.

    Items go longest first into the fullest bin that has room. Bins with equal room are alike, so
    all items of one length are placed by groups of bins instead of one by one.
    """
    order = np.argsort(-lengths, kind="stable")
    values, counts = np.unique(lengths, return_counts=True)
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    open_bins: dict[int, list[np.ndarray]] = defaultdict(list)  # by room
    used = at = 0

    def put(items: np.ndarray, into: np.ndarray, room: int, size: int) -> None:
        """Items fill the bins in turn, as many in each as have room; what is open is kept."""
        each = room // size
        spots = np.arange(len(items))
        bins[items] = into[spots // each]
        offsets[items] = capacity - room + spots % each * size
        full, rest = divmod(len(items), each)
        if full:
            open_bins[room - each * size].append(into[:full])
        if rest:
            open_bins[room - rest * size].append(into[full : full + 1])
        if len(into) > full + bool(rest):
            open_bins[room].append(into[full + bool(rest) :])

    for size, count in zip(values[::-1].tolist(), counts[::-1].tolist()):
        items = order[at : at + count]
        at += count
        for room in sorted(r for r in open_bins if r >= size):
            if not len(items):
                break
            into = np.concatenate(open_bins.pop(room))
            n = min(len(items), len(into) * (room // size))
            put(items[:n], into, room, size)
            items = items[n:]
        if len(items):
            new = -(-len(items) // (capacity // size))
            put(items, np.arange(used, used + new), capacity, size)
            used += new
    return bins, offsets, used


def bins_needed(lengths: np.ndarray, capacity: int, most: int = 40) -> int:
    """A number of bins that no packing can undercut.

    Every function ``u_k`` (a size is rounded to k-ths of a bin) is dual feasible, and so is its
    composition with the one that counts items over ``capacity - e`` as a whole bin and those
    under ``e`` as nothing. The best over all k and e is returned.
    """
    if not len(lengths):
        return 0
    amount = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    cuts = np.arange(0, capacity // 2 + 1)
    above = np.cumsum(amount[::-1])[::-1]  # items at least so long
    best = 0
    for k in range(0, most + 1):
        if k == 0:
            value = size / capacity
        else:
            scaled = (k + 1) * size
            value = np.where(scaled % capacity == 0, size / capacity, (scaled // capacity) / k)
        upto = np.concatenate([[0.0], np.cumsum(amount * value)])
        whole = np.concatenate([above, [0]])[capacity - cuts + 1]
        bound = whole + upto[capacity - cuts + 1] - upto[cuts]
        best = max(best, int(np.ceil(bound.max() * (1 - 1e-12) - 1e-6)))
    return best


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    lengths = rows["length"].to_numpy(np.int64)
    bins, offsets, used = best_fit_decreasing(lengths, capacity)
    rows = rows.drop(columns="row")
    return rows.assign(
        bin=bins, offset=offsets, bins=used, bound=bins_needed(lengths, capacity)
    )[[c.split()[0] for c in PACKED.split(", ")]]


def pack_pieces(
    pieces: DataFrame,
    capacity: int,
    *,
    group: int = 1 << 14,
    max_group: int = 1 << 20,
    grow: int = 8,
    max_rounds: int = 8,
) -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset`` and ``certified`` added.

    ``certified``: the sequences of the piece's group are as few as its pieces allow.
    """
    pool = stored(pieces, "pack-pieces")
    done: list[DataFrame] = []
    before: int | None = None
    last: DataFrame | None = None
    for round_ in range(max_rounds):
        n = pool.count()
        if n == 0:
            break
        groups = -(-n // min(group * grow**round_, max_group))
        # The stored rows keep their place, so this numbering is the same in every attempt.
        row = F.monotonically_increasing_id()
        dealt = pool.withColumn("row", row).withColumn("deal", F.abs(F.xxhash64("row")) % groups)
        packed = stored(
            dealt.groupBy("deal").applyInPandas(partial(pack_group, capacity=capacity), PACKED),
            "pack-round",
        )
        # Counted by group: one row each.
        found = packed.groupBy("deal").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        total = found.agg(
            F.sum("bins"), F.sum(F.when(F.col("bins") > F.col("bound"), F.col("bins")))
        ).first()
        if before is not None and total[0] >= before:
            break  # the exchange saved nothing: the packing before it stands
        named = packed.withColumn("round", F.lit(round_).cast("long"))
        final = named.filter("bins = bound")
        last = named.filter("bins > bound")
        before = total[1]
        done.append(final)
        if before is None:
            last = None
            break
        if round_ and group * grow**(round_ - 1) >= max_group:
            break
        pool = last.select(*[c.split()[0] for c in PIECES.split(", ")])
    parts = [*done, *([last] if last is not None else [])]
    if not parts:
        return pool.select(
            "*",
            F.lit(0).cast("long").alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
            F.lit(True).alias("certified"),
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    number = (
        F.shiftleft(F.col("round"), 58) + F.shiftleft(F.col("deal"), 24) + F.col("bin")
    )
    return out.select(
        *[c.split()[0] for c in PIECES.split(", ")],
        number.alias("sequence_id"),
        "offset",
        (F.col("bins") == F.col("bound")).alias("certified"),
    )

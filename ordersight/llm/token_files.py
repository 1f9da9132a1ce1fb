"""Token ids of a corpus in Simple-8b frames, written in ascending id order and read back.

Documents are range-partitioned by id and sorted; each task encodes its texts and writes frames
of about ``frame_ids`` ids (``simple8b``), one per row of a Parquet table, because Spark's writers
reach any store and commit only whole attempts. Beside the frame, a row holds its shard (the task
that wrote it), its place there and the ids before it in the shard, so a reader needs one total per shard
to know every document's start.

A NULL text has no ids of its own; a NULL id comes first. Rows with equal ids follow each other,
ordered by text. An empty table gives an empty file and an empty result. ``end_id`` closes every document.
"""

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordersight.llm.simple8b import read_frame, write_frame
from ordersight.llm.store import with_package
from ordersight.llm.tokens import encoder, slices

FILE = "shard int, place int, before bigint, n_ids bigint, frame binary"
FILE_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("place", pa.int32()),
        ("before", pa.int64()),
        ("n_ids", pa.int64()),
        ("frame", pa.binary()),
    ]
)
READ_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def write_frames(
    batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, frame_ids: int
) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    end = np.array([end_id], "<u4").tobytes()
    doc_ids, pieces, held, place, before = [], [], 0, 0, 0

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(pieces), "<u4")
        frame = write_frame(doc_ids, [len(p) // 4 for p in pieces], ids)
        row = [[shard], [place], [before], [len(ids)], [frame]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(row, FILE_ARROW)], schema=FILE_ARROW
        )

    for batch in batches:
        for part in slices(batch, "text"):
            found = encoder(tokenizer).ids(pc.fill_null(part.column("text"), ""))
            for doc_id, ids in zip(part.column("id").to_pylist(), found):
                doc_ids.append(doc_id)
                pieces.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= frame_ids:
                    yield flush()
                    place, before = place + 1, before + held
                    doc_ids, pieces, held = [], [], 0
    if doc_ids:
        yield flush()


def read_documents(
    batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], int]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, before, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "before", "frame")]):
            frame = read_frame(data)
            ids = memoryview(frame.ids().astype("<u4").tobytes())
            ends = np.cumsum(frame.lengths, dtype=np.int64)
            starts = ends - frame.lengths
            columns = [
                np.full(len(ends), shard),
                frame.doc_ids,
                starts + before,
                frame.lengths,
                [digest(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(columns, READ_ARROW)], schema=READ_ARROW
            )


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    frame_ids: int = 240_000,
) -> None:
    """Encode ``docs`` into a new folder ``path``. Ids must be integers."""
    (
        with_package(docs)
        .select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(
            partial(write_frames, tokenizer=tokenizer, end_id=end_id, frame_ids=frame_ids), FILE
        )
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids_crc32`` of every document in the files."""
    frames = with_package(spark.read.schema(FILE).parquet(path))
    # One row per shard, that is per task of the writing job: small enough to sum up and to send.
    shards = frames.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select(
        "shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("offset")
    )
    read = frames.select("shard", "before", "frame").mapInArrow(
        partial(read_documents, digest=zlib.crc32),
        "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    )
    return read.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )

"""Alignment of two tokenizers' tokens, and how often ids of one go with ids of the other.

Texts are shuffled by their full text, so that each distinct one is tokenised and aligned once; its
number of copies weighs its id pairs, and what was measured on it is joined to the ids of all copies.

Both tokenizers give a chunk of text between two cuts the same tokens wherever it stands: a cut is a single
space, or a line end, between two characters that are neither blank nor U+2581. A worker aligns each chunk once
and remembers it. A text's alignment is then put together from those of its chunks.
"""

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from ordersight.llm.store import stored, with_package
from ordersight.llm.tokens import byte_level, slices

SPACE = "▁"
#: What a worker may remember of chunks, in bytes; up to twice that while it learns more.
REMEMBERED = 100_000_000
#: Texts, and bytes of them, that are aligned at once. A link takes some hundred bytes meanwhile.
AT_ONCE = 512
TEXT_BYTES = 2_000_000
#: Chunks that are encoded as one text.
TOGETHER = 256
#: Id pairs in one broadcast block of 13 bytes each.
BLOCK = 2_000_000
#: An id pair is one number: the id of A times this, plus the id of B.
PAIR = 1 << 16

CUT = re.compile(rf"(?<=[^\s{SPACE}])(?=[ \n][^\s{SPACE}])")


class Aligner:
    """Tokens of A and B for texts with a space put in front, cut into groups where both end."""

    def __init__(self, path_a: str, path_b: str):
        self.a = byte_level(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        if max(self.a.n_vocab, len(pieces)) > PAIR:
            raise ValueError(f"a vocabulary has more than {PAIR} ids")
        self.len_a = np.array([len(self.a.decode_single_token_bytes(i)) for i in range(self.a.n_vocab)])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        #: How ids read in the groups: inside one, at the end of A's part, at the end of B's part.
        inside, end_a = ([f"{i}{mark}".encode() for i in range(PAIR)] for mark in ",|")
        end_b = [f"{i};".encode() for i in range(len(pieces))]
        self.spelled = [*inside, *end_a, *end_b]
        self.widths = np.fromiter(map(len, self.spelled), np.int64, len(self.spelled))
        #: No piece of B reaches over a cut, and A cuts by its pattern.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) and self.by_pattern()
        self.forget()

    def by_pattern(self) -> bool:
        """Whether A gives two chunks the same tokens together as apart, tried on each kind of character."""
        before = ["word", " 7", ",", " 's", "\xdf", "x\u0301", " ...", "\U0001f600"]
        after = [" word", "\nword", " 's", "\n7", " ,", "\n...", " \u0301", "\n\u0301"]

        ids = self.a.encode_ordinary
        return all(ids(x + y) == ids(x) + ids(y) for x in before for y in after)

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: Per chunk: tokens of A, of B, groups, links, and whether its bytes are those of the text.
        self.sizes = array("i")
        #: Distinct id pairs of all chunks one after the other, how often each is linked, where chunks begin.
        self.pairs, self.times, self.starts = array("q"), array("i"), array("q", [0])
        #: Chunks with blanks at an end, or two in front.
        self.odd: set[str] = set()
        self.chars = 0

    def chunks(self, text: str) -> list[str]:
        """The text cut. A chunk is kept without its space unless more white space follows it; a chunk
        at a line start keeps its line end."""
        if not self.cuts:
            return [" " + text]
        words = text.split()
        if SPACE not in text and words == text.replace("\n", " ").split(" "):
            return text.replace("\n", " \n").split(" ") if "\n" in text else words
        whole = " " + text
        at = [0, *(m.start() for m in CUT.finditer(whole)), len(whole)]
        found = [whole[x:y] for x, y in zip(at, at[1:])]
        found = [c if c[0] == "\n" or c[1:2].isspace() else c[1:] for c in found]
        self.odd.update(c for c in found if c[0] == " " or c[1:2].isspace() or c[-1].isspace())
        return found

    def learn(self, chunks: list[str]) -> None:
        """Align chunks, all at once: one long text whose token ends are compared.

        Chunks that may stand side by side are encoded together, others (blanks at an end) one by one.
        """
        odd = [c for c in chunks if c in self.odd or not self.cuts]
        if odd:
            alone = set(odd)
            chunks = [c for c in chunks if c not in alone]
        chunks += odd
        texts = [c if c[0] in " \n" else " " + c for c in chunks]
        even = len(chunks) - len(odd)
        together = ["".join(texts[i : min(i + TOGETHER, even)]) for i in range(0, even, TOGETHER)] + texts[even:]
        a = np.concatenate([self.a.encode_to_numpy(t, disallowed_special=()) for t in together]).astype(np.int64)
        lists = self.b.encode([t[1:] if t[0] == " " else t for t in together], num_threads=1)
        lists = [ids[1:] if t[0] == "\n" else ids for t, ids in zip(together, lists)]  # B puts a space in front
        data = [t.encode() for t in texts]
        fine = np.ones(len(data), bool)
        if b"".join(map(self.bytes_b.__getitem__, chain.from_iterable(lists))) != b"".join(data):
            lists = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
            lists = [ids[1:] if t[0] == "\n" else ids for t, ids in zip(texts, lists)]
            fine[:] = [b"".join(map(self.bytes_b.__getitem__, ids)) == d for ids, d in zip(lists, data)]
            lists = [ids for ids, good in zip(lists, fine) if good]
        b = np.array(list(chain.from_iterable(lists)), np.int64)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        chunk_a = np.searchsorted(np.cumsum(sizes), np.cumsum(self.len_a[a]))
        chunk_b = np.flatnonzero(fine)[np.searchsorted(np.cumsum(sizes[fine]), np.cumsum(self.len_b[b]))]
        a, chunk_a = a[fine[chunk_a]], chunk_a[fine[chunk_a]]
        self.index.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks))))
        self.chars += int(sizes.sum())
        self.add(a, chunk_a, b, chunk_b, fine)

    def add(self, a: np.ndarray, chunk_a: np.ndarray, b: np.ndarray, chunk_b: np.ndarray, fine: np.ndarray) -> None:
        """Remember what the tokens of chunks, of the same bytes in A and B, have in common."""
        many = len(fine)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # Each stretch between two ends, of whichever tokenizer, lies in one token of A and one of B: a link.
        at_b, at_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
        last_a, last_b = ends_b[at_b] == ends_a, ends_a[at_a] == ends_b
        pairs = np.r_[a * PAIR + b[at_b], a[at_a[~last_b]] * PAIR + b[~last_b]]
        of_link = np.r_[chunk_a, chunk_b[~last_b]]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        counts = [chunk_a, chunk_b, chunk_a[last_a], of_link]
        self.sizes.frombytes(
            np.column_stack([*(np.bincount(x, minlength=many) for x in counts), fine]).astype(np.int32).tobytes()
        )
        links = np.sort(of_link << 32 | pairs)
        first = np.flatnonzero(np.r_[True, links[1:] != links[:-1]][: len(links)])
        before = len(self.pairs)
        self.pairs.frombytes((links[first] & 0xFFFFFFFF).tobytes())
        self.times.frombytes(np.diff(np.r_[first, len(links)]).astype(np.int32).tobytes())
        self.starts.frombytes((before + np.searchsorted(links[first], np.arange(1, many + 1) << 32)).tobytes())
        # A's ids of a group, then B's, each with the mark behind it.
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + PAIR * last_a
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * PAIR * last_b
        written = b"".join(map(self.spelled.__getitem__, order.tolist()))
        tokens = np.searchsorted(chunk_a, np.arange(many + 1)) + np.searchsorted(chunk_b, np.arange(many + 1))
        at = np.r_[0, np.cumsum(self.widths[order])][tokens]
        self.groups.extend(written[x:y] for x, y in pairwise(at.tolist()))

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Columns of the texts' alignments; texts that a tokenizer does not give back have zeros."""
        if 4 * self.chars + 12 * len(self.pairs) + 250 * len(self.index) > REMEMBERED:
            self.forget()
        cut = [self.chunks(text) for text in texts]
        flat = list(chain.from_iterable(cut))
        at = list(map(self.index.get, flat))
        if None in at:
            self.learn(list(dict.fromkeys(chunk for chunk, i in zip(flat, at) if i is None)))
            at = list(map(self.index.__getitem__, flat))
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        found = list(map(self.groups.__getitem__, at))
        at = np.array(at, np.int64)
        begins = np.cumsum(lengths) - lengths
        sizes = np.frombuffer(self.sizes, np.int32).reshape(-1, 5)[at].astype(np.int64)
        fine = np.logical_and.reduceat(sizes[:, 4] == 1, begins)
        totals = np.add.reduceat(sizes[:, :4], begins, axis=0) * fine[:, None]
        hashes = [
            hashlib.sha256(b"".join(found[x : x + many])[:-1]).hexdigest() if good else ""
            for x, many, good in zip(begins.tolist(), lengths.tolist(), fine)
        ]
        pairs, times, sums = self.linked(at, np.repeat(np.arange(len(cut)), lengths), fine)
        return {"totals": totals, "groups_sha256": hashes, "pairs": pairs, "times": times, "ends": sums}

    def linked(self, at: np.ndarray, row: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each row's distinct id pairs and how often they are linked, row after row, and the rows' ends."""
        starts = np.frombuffer(self.starts, np.int64)
        # A row's equal chunks first, so that fewer pairs are written out.
        found = np.sort((row * len(starts) + at)[fine[row]])
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
        count = np.diff(np.r_[first, len(found)])
        row, at = np.divmod(found[first], len(starts))
        many = starts[at + 1] - starts[at]
        source = np.repeat(starts[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        if not len(source):
            return source, source, np.zeros(len(fine), np.int64)
        keys = np.repeat(row, many) << 32 | np.frombuffer(self.pairs, np.int64)[source]
        times = np.repeat(count, many) * np.frombuffer(self.times, np.int32)[source]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) 
        times = np.add.reduceat(times, first)
        keys = keys[first]
        ends = np.searchsorted(keys, np.arange(1, len(fine) + 1) << 32)
        return keys & 0xFFFFFFFF, times, ends


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, kept between tasks."""
    return Aligner(path_a, path_b)


MEASURES = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = (
    "text_key binary, copies bigint, "
    + ", ".join(f"{m} bigint" for m in MEASURES)
    + ", groups_sha256 string, pairs array<bigint>, times array<bigint>"
)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, pa.int64()))


def _align(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    worker = aligner(path_a, path_b)
    for whole in batches:
        for batch in slices(whole, "text", AT_ONCE, TEXT_BYTES):
            got = worker.align(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_key"),
                    batch.column("copies"),
                    *(pa.array(got["totals"][:, i], pa.int64()) for i in range(4)),
                    pa.array(got["groups_sha256"], pa.string()),
                    _lists(got["pairs"], got["ends"]),
                    _lists(got["times"], got["ends"]),
                ],
                ["text_key", "copies", *MEASURES, "groups_sha256", "pairs", "times"],
            )


def distinct_alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every distinct text aligned once: its SHA-256, copies, measures, id pairs and how often each is linked."""
    texts = (
        with_package(docs)
        .filter(F.col("text") != "")
        .groupBy("text")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("text", F.unhex(F.sha2("text", 256)).alias("text_key"), "copies")
    )
    return texts.mapInArrow(lambda batches: _align(batches, path_a, path_b), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best``: whether none of its A id has more."""
    counts = (
        aligned.select(F.explode("pairs").alias("pair"), "copies")
        .groupBy("pair")
        .agg(F.sum("copies").alias("n"))
        .withColumn("a", F.expr(f"pair div {PAIR}"))
    )
    # An id of A has as many rows as B has ids at most.
    most = F.max("n").over(Window.partitionBy("a"))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


class Block:
    """Some id pairs, sorted, with their counts."""

    def __init__(self, rows: pa.Table):
        self.pairs = rows.column("pair").to_numpy()
        self.n = rows.column("n").to_numpy()
        self.best = rows.column("best").to_numpy(zero_copy_only=False)


def _look_up(batches: Iterator[pa.RecordBatch], block: Broadcast) -> Iterator[pa.RecordBatch]:
    table = block.value
    for batch in batches:
        ends = batch.column("pairs").offsets.to_numpy().astype(np.int64)
        pairs, times = (batch.column(c).values.to_numpy()[ends[0] : ends[-1]] for c in ("pairs", "times"))
        at = np.minimum(np.searchsorted(table.pairs, pairs), len(table.pairs) - 1)
        times = times * (table.pairs[at] == pairs)
        sums = [np.r_[0, np.cumsum(times * x[at])] for x in (table.best, table.n)]
        ends = ends - ends[0]
        yield pa.RecordBatch.from_arrays(
            [batch.column("text_key"), *(pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)],
            ["text_key", "n_best", "count_sum"],
        )


def link_sums(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Per text, over its links: how many have the best count of their A id, and the sum of the counts.

    The counts go out in blocks of BLOCK pairs, each under 40 MB and joined to all texts in one pass; the blocks'
    sums are added up. However many pairs there are, a worker holds one block.
    """
    spark = aligned.sparkSession
    blocks = max(1, -(-counts.count() // BLOCK))
    places = counts.withColumn("block", F.pmod(F.xxhash64("pair"), F.lit(blocks)))
    linked = aligned.select("text_key", "pairs", "times")
    out = None
    for i in range(blocks):
        rows = places.filter(F.col("block") == i).drop("block").toArrow().sort_by("pair")
        if not rows.num_rows:
            continue
        block = spark.sparkContext.broadcast(Block(rows))
        part = linked.mapInArrow(
            lambda batches, block=block: _look_up(batches, block), "text_key binary, n_best bigint, count_sum bigint"
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "text_key binary, n_best bigint, count_sum bigint")
    if blocks == 1:
        return out
    return out.groupBy("text_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def token_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Alignment measures of every row of ``docs`` (doc_id, text).

    ``path_a`` is a byte-level file of the tokenizers library, ``path_b`` a sentencepiece model. Texts that are
    NULL or empty, or that a tokenizer does not give back byte by byte with a space in front, have zeros
    and an empty hash. Repeated rows count as documents of their own and come back as often; NULL ids stay.
    """
    docs = docs.select("doc_id", "text")
    aligned = stored(distinct_alignments(docs, path_a, path_b), "alignments")
    sums = link_sums(aligned, stored(pair_counts(aligned), "pair-counts"))
    measured = aligned.select("text_key", *MEASURES, "groups_sha256").join(sums, "text_key", "left")
    keyed = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_key"))
    zero = [F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in (*MEASURES, "n_best", "count_sum")]
    return keyed.join(measured, "text_key", "left").select(
        "doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )

"""Documents whose sets of word shingles overlap by a Jaccard similarity, as connected groups.

1. One pass makes, for slices of documents, each distinct set's key, a small histogram of its
   elements, and its PartEnum signatures (``shingles``), sent to buckets by hash. A bucket sorts what it got, a part of the signatures at a time:
   a signature that few sets share gives them as a group, one that many share names them as crowded. Copies
   share all their signatures, so every bucket finds their group anew; it is written packed, once a bucket.
   Equal groups of all buckets come together by their first set, and only then become pairs.
2. Pairs are dropped if sizes or histograms already prove more differences than allowed.
   Crowded sets (a passage or a large family of near copies) are paired by their prefixes instead: of two similar sets, the first
   elements in any common order, size - ceil(similarity * size) + 1 of them, have one in common;
   the order puts frequent elements last. Where many sets have a prefix element in common, their histograms travel to
   blocks and are compared there; a block returns a row per set that could be linked, not a row per pair.
3. What is connected so far is a cluster of candidates. Every set travels once to its cluster, or a few
   times to blocks of it if it is large (only blocks of like sizes meet), and its similarity to the others is computed exactly. A
   block returns a row per linked set, too. Elements are 48-bit hashes here, made anew from the text when its blocks are known.
4. Components of these links are the groups.

No step loses a pair: signatures and prefixes are complete, histograms only drop what is
too different, and blocks cover all pairs of a cluster. Equal sets share a key and are never paired.

A NULL or empty text, or one without words, has an empty set and is linked with nothing. A row
with a NULL id takes no part and its component is NULL. Rows with the same id count as one
document for the smallest id. Repeated rows give repeated results. An empty table gives an empty result.
"""

import zlib
from collections.abc import Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.components import components, in_blocks
from ordersight.llm.shingles import differences, from_bytes, mix, shingle_sets, signatures, to_bytes
from ordersight.llm.store import forget, stored, unused, with_package

SLICE = 4096
CELLS = 64
FEW = 16  # sets of one signature whose pairs are listed
PARTS = 16  # a bucket is sorted in that many parts, one after the other
PART_SEED = 303  # of the hash that deals groups to parts
CHUNK = 128
WIDE = 512  # the same for histograms, which are short
BAND = 1.12  # ratio of the sizes that stand in one band of a large cluster
COMMON = 50_000  # elements that the prefix order knows as frequent; any number is right

DOC, PAIR, CROWDED = 0, 1, 2
SENT = "bucket bigint, slice bigint, sigs binary, places binary"
SENT_ARROW = pa.schema(
    [("bucket", pa.int64()), ("slice", pa.int64()), ("sigs", pa.binary()), ("places", pa.binary())]
)
FOUND = (
    "kind int, a bigint, b bigint, doc_id bigint, text_hash bigint, n_shingles bigint, key bigint, sketch binary, fine binary"
)
DOC_ROWS = 1 << 40  # from this bucket number on, a row holds the documents of a slice


def set_key(elements: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(elements.tobytes()) - (1 << 63) if len(elements) else 0


def fine_cells(n: int) -> int:
    """Cells of the fine histogram of a set of ``n``: a few elements each, up to 4096 cells."""
    return 1 << min(12, max(6, (n // 4).bit_length()))


def histogram(elements: np.ndarray, cells: int) -> bytes:
    """How many elements fall into each part of the domain, at most 255."""
    place = (elements >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=cells), 255).astype(np.uint8).tobytes()


class Slice:
    """What a slice of documents sends. Parts of it are added one after the other, so that texts and sets go at once."""

    def __init__(self, number: int):
        self.number = number
        self.documents: list[tuple[int, int, int, int, int]] = []  # id, hash of the text, size, key, place
        self.place: dict[int, int] = {}
        self.shown: list[bytes] = []
        self.sigs: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, ids: list, hashes: list, texts: list, width: int, percent: int) -> None:
        for id_, hash_, elements in zip(ids, hashes, shingle_sets(texts, width)):
            key = set_key(elements)
            place = self.place.setdefault(key, len(self.place))
            self.documents.append((id_, hash_, len(elements), key, place))
            if place < len(self.shown):
                continue
            self.shown.append(histogram(elements, fine_cells(len(elements))))
            if len(elements):
                own = signatures(elements, percent)
                self.sigs.append(own)
                self.owners.append(np.full(len(own), place, np.uint16))

    def rows(self, buckets: int) -> pa.RecordBatch:
        table = np.array(self.documents, "<i8").T.tobytes()
        rows = [(DOC_ROWS + self.number, self.number, zlib.compress(b"".join(self.shown), 1), table)]
        if self.sigs:
            sig, owner = np.concatenate(self.sigs), np.concatenate(self.owners)
            self.sigs, self.owners = [], []
            bucket = (sig >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            sig, owner, bucket = sig[order], owner[order], bucket[order]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            low = sig.astype("<u8").view("u1").reshape(-1, 8)[:, :6]
            rows += [
                (int(bucket[x]), self.number, low[x:y].tobytes(), owner[x:y].astype("<u2").tobytes())
                for x, y in zip(cuts, cuts[1:])
            ]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(zip(*rows), SENT_ARROW)], schema=SENT_ARROW
        )


def send(
    batches: Iterator[pa.RecordBatch], width: int, percent: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    """Signatures by bucket and the documents, for each slice of a partition."""
    held = None
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            some = batch.slice(begin, 512)
            number = some.column("slice").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for x, y in zip(cuts, cuts[1:]):
                if held is None or held.number != number[x]:
                    if held is not None:
                        yield held.rows(buckets)
                    held = Slice(int(number[x]))
                part = some.slice(x, y - x)
                held.add(*[part.column(c).to_pylist() for c in ("id", "text_hash", "text")], width, percent)
    if held is not None:
        yield held.rows(buckets)


def distinct_rows(found: np.ndarray) -> np.ndarray:
    order = np.lexsort(found.T[::-1])
    found = found[order]
    fresh = np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)])[: len(found)]
    return found[fresh]


def groups_of(starts: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> dict[int, np.ndarray]:
    """The distinct sets of nodes that runs of ``nodes`` are, as rows by their size, run sizes being small."""
    return {
        int(size): distinct_rows(np.sort(nodes[starts[sizes == size][:, None] + np.arange(size)], axis=1))
        for size in np.unique(sizes)
    }


def together(found: Iterable[dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    by_size: dict[int, list[np.ndarray]] = {}
    for groups in found:
        for size, rows in groups.items():
            by_size.setdefault(size, []).append(rows)
    return {size: distinct_rows(np.concatenate(rows)) for size, rows in by_size.items()}


def pairs_of(groups: dict[int, np.ndarray]) -> np.ndarray:
    """All pairs within the groups, as rows without repeats."""
    out = [rows[:, [i, j]] for size, rows in groups.items() for i in range(size) for j in range(i + 1, size)]
    return distinct_rows(np.concatenate(out)) if out else np.zeros((0, 2), np.int64)


def packed(groups: dict[int, np.ndarray]) -> bytes:
    """Groups of sorted nodes in few bytes: for each size, how many, and the columns of their differences."""
    out = []
    for size, rows in groups.items():
        out += [np.array([size, len(rows)]), np.diff(rows, axis=1, prepend=0).T.ravel()]
    return zlib.compress(np.concatenate(out).astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> dict[int, np.ndarray]:
    found, groups, at = np.frombuffer(zlib.decompress(data), "<i8"), {}, 0
    while at < len(found):
        size, n = found[at : at + 2].tolist()
        groups[size] = np.cumsum(found[at + 2 : at + 2 + size * n].reshape(size, n), axis=0).T
        at += 2 + size * n
    return groups


def dealt(groups: dict[int, np.ndarray], parts: int, seed: int) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
    """The groups by a hash of their first node: a number below ``parts``, and those that have it."""
    of = {size: (mix(rows[:, 0].astype(np.uint64), seed) % np.uint64(parts)).astype(np.int64) for size, rows in groups.items()}
    order = {size: np.argsort(part, kind="stable") for size, part in of.items()}
    for part in np.unique(np.concatenate([*of.values()])).tolist() if of else []:
        some = {}
        for size, rows in groups.items():
            x, y = np.searchsorted(of[size], [part, part + 1], sorter=order[size])
            if x < y:
                some[size] = rows[order[size][x:y]]
        yield part, some


def shared(sent: pd.DataFrame, part: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Groups and crowded sets by the signatures of a bucket whose lowest byte is ``part`` modulo ``PARTS``."""
    sigs, nodes = [], []
    for slice_, low, places in zip(sent["slice"], sent["sigs"], sent["places"]):
        six = np.frombuffer(low, "u1").reshape(-1, 6)
        own = np.flatnonzero(six[:, 0] % PARTS == part)
        sigs.append(from_bytes(six[own].tobytes()))
        nodes.append(np.frombuffer(places, "<u2")[own].astype(np.int64) + slice_ * SLICE)
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)])
    sizes = np.diff(np.concatenate([starts, [len(sig)]]))
    few = (sizes > 1) & (sizes <= FEW)
    return groups_of(starts[few], sizes[few], node), np.unique(node[np.repeat(sizes > FEW, sizes)])


def meet(sent: pd.DataFrame, parts: int = 0) -> pd.DataFrame:
    """Pairs and crowded sets of a bucket, or the documents of a slice. With ``parts``, a row has all groups of
    sets that go to one part, ``a``, for their pairs, or all crowded sets of one slice, ``a``."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    if sent["bucket"].iloc[0] >= DOC_ROWS:
        slice_ = int(sent["slice"].iloc[0])
        doc_id, text_hash, n, key, place = np.frombuffer(sent["places"].iloc[0], "<i8").reshape(5, -1)
        shown = np.frombuffer(zlib.decompress(sent["sigs"].iloc[0]), np.uint8)
        first = np.unique(place, return_index=True)[1]
        ends = np.cumsum([fine_cells(x) for x in n[first].tolist()])
        fine = np.split(shown, ends[:-1])
        coarse = [np.minimum(folded(x, CELLS), 255).astype(np.uint8).tobytes() for x in fine]
        once = np.zeros(len(n), bool)  # a set that several documents have is described once
        once[first] = True
        out = pd.DataFrame(
            {"kind": DOC, "a": slice_ * SLICE + place, "b": 0, "doc_id": doc_id}
            | {"text_hash": text_hash, "n_shingles": n, "key": key}
            | {"sketch": [coarse[p] if o else b"" for p, o in zip(place.tolist(), once)]}
            | {"fine": [fine[p].tobytes() if o else b"" for p, o in zip(place.tolist(), once)]}
        )
        return out[names]
    found = [shared(sent, part) for part in range(PARTS)]  # one part's sorting fits where all would take much more
    groups = together(g for g, _ in found)
    crowded = np.unique(np.concatenate([c for _, c in found]))
    if parts:
        rows = [(PAIR, part, 0, packed(some)) for part, some in dealt(groups, parts, PART_SEED)]
        slices, starts = np.unique(crowded // SLICE, return_index=True)
        places = np.split((crowded % SLICE).astype("<u2"), starts[1:])
        rows += [(CROWDED, slice_, 0, own.tobytes()) for slice_, own in zip(slices.tolist(), places)]
    else:
        rows = [(PAIR, a, b, None) for a, b in pairs_of(groups).tolist()]
        rows += [(CROWDED, a, 0, None) for a in crowded.tolist()]
    out = pd.DataFrame(rows, columns=["kind", "a", "b", "sketch"])
    return out.assign(doc_id=0, text_hash=0, n_shingles=0, key=0, fine=None)[names]


def part_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of the groups that all buckets sent to a part, some of the groups at a time."""
    some: list[list[dict[int, np.ndarray]]] = [[] for _ in range(PARTS)]
    for data in rows["sketch"]:
        for number, groups in dealt(unpacked(data), PARTS, PART_SEED + 1):
            some[number].append(groups)
    pairs = np.concatenate([pairs_of(together(groups)) for groups in some])
    return pd.DataFrame(pairs, columns=["x", "y"])


def crowded_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """The sets of a slice that some bucket calls crowded."""
    places = np.unique(np.concatenate([np.frombuffer(x, "<u2") for x in rows["sketch"]]))
    return pd.DataFrame({"x": places.astype(np.int64) + int(rows["a"].iloc[0]) * SLICE})


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """A histogram with fewer cells; a full one stays recognisable."""
    wide = counts.astype(np.int32).reshape(cells, -1)
    return np.where((wide == 255).any(axis=1), 255, wide.sum(axis=1))


def apart(a: bytes, b: bytes) -> int:
    """Differences that two histograms prove."""
    left, right = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    cells = min(len(left), len(right))
    left, right = folded(left, cells), folded(right, cells)
    return int(np.abs(left - right)[(left < 255) & (right < 255)].sum())


def close_enough(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs that sizes and histograms leave possible."""
    for rows in batches:
        allowed = differences((rows["n_a"] + rows["n_b"]).to_numpy(), 0, percent)
        keep = [x >= apart(a, b) for x, a, b in zip(allowed, rows["sketch_a"], rows["sketch_b"])]
        yield rows.loc[np.array(keep, bool), ["a", "b"]]


def element_sets(
    batches: Iterator[pa.RecordBatch], width: int
) -> Iterator[pa.RecordBatch]:
    """``key, elements`` of every text, and its other columns."""
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            sets = shingle_sets(part.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([to_bytes(s) for s in sets], pa.binary())]
                + [part.column(c) for c in others],
                names=["key", "elements", *others],
            )


def run_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs of each short list of keys."""
    for rows in batches:
        lists = list(rows["keys"])
        nodes = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        sizes = np.array([len(x) for x in lists], np.int64)
        yield pd.DataFrame(pairs_of(groups_of(np.cumsum(sizes) - sizes, sizes, nodes)), columns=["a", "b"])


def often(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Elements that several sets of a partition hold, with their number."""
    for batch in batches:
        sets = [from_bytes(x) for x in batch.column("elements").to_pylist()]
        elements, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else ([], [])
        keep = np.asarray(counts) >= least
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(elements)[keep].astype(np.int64) if len(elements) else [], pa.int64())]
            + [pa.array(np.asarray(counts)[keep], pa.int64())],
            names=["element", "sets"],
        )


def prefixes(
    batches: Iterator[pa.RecordBatch], percent: int, common: np.ndarray, rank: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """``element, key`` for the prefix of every set; ``common`` is sorted and stands last by rank."""
    for batch in batches:
        elements, keys = [], []
        for key, data in zip(batch.column("key").to_pylist(), batch.column("elements").to_pylist()):
            own = from_bytes(data)
            n = len(own) + (-len(own) * percent // 100) + 1
            at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
            frequent = common[at] == own if len(common) else np.zeros(len(own), bool)
            place = np.where(frequent, rank[at] + 1 if len(common) else 0, 0)
            first = own[np.lexsort((own, place))[:n]]
            elements.append(first.astype(np.int64))
            keys.append(np.full(len(first), key, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (elements, keys)],
            names=["element", "key"],
        )


def block_candidates(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``a, b``: every set of the block whose histogram lets it be like another's, with the smallest of those it is connected to."""
    keys, cell, n = rows["key"].to_numpy(), rows["cell"].to_numpy(), rows["n"].to_numpy()
    shapes = [np.frombuffer(x, np.uint8) for x in rows["fine"]]
    cells = np.array([len(x) for x in shapes])
    widths = np.unique(cells).tolist()
    # Whatever has more cells is folded once for each smaller number of them.
    at = {w: np.flatnonzero(cells >= w) for w in widths}
    shown = {w: np.array([folded(shapes[i], w) for i in at[w].tolist()], np.int32) for w in widths}
    across = rows["low"].iloc[0] != rows["high"].iloc[0]
    cluster = np.arange(len(keys))
    for i in range(len(keys)):
        # Sets with as many cells or more are told at those of set i; those with fewer tell it when their turn comes.
        others = at[cells[i]]
        ok = cluster[others] != cluster[i]
        ok &= 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
        if across:
            ok &= cell[others] != cell[i]
        if not ok.any():
            continue
        left, right = folded(shapes[i], cells[i]), shown[cells[i]][ok]
        proven = np.where((left < 255) & (right < 255), np.abs(left - right), 0).sum(axis=1)
        linked = others[ok][proven <= differences(n[others[ok]] + n[i], 0, percent)]
        old = np.unique(cluster[np.append(linked, i)])
        if len(old) > 1:
            cluster[np.isin(cluster, old)] = old[0]
    return smallest(keys, cluster)


def smallest(keys: np.ndarray, cluster: np.ndarray) -> pd.DataFrame:
    frame = pd.DataFrame({"a": keys, "cluster": cluster})
    frame["b"] = frame.groupby("cluster")["a"].transform("min")
    return frame.loc[frame["a"] != frame["b"], ["a", "b"]]


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``a, b``: every set of the block that is linked, with the smallest of those it is connected to."""
    sets = [from_bytes(x) for x in rows["elements"]]
    keys, cell = rows["key"].to_numpy(), rows["cell"].to_numpy()
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    cluster = np.arange(len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets)
    by_element = np.argsort(elements, kind="stable")
    elements, owner = elements[by_element], owner[by_element]
    across = rows["low"].iloc[0] != rows["high"].iloc[0]
    for i in order.tolist():
        # How many elements of set i every set holds, by looking each up among all elements.
        low, high = np.searchsorted(elements, sets[i]), np.searchsorted(elements, sets[i], "right")
        spans = high - low
        ends = np.cumsum(spans)
        at = np.arange(ends[-1]) - np.repeat(ends - spans, spans) + np.repeat(low, spans)
        common = np.bincount(owner[at], minlength=len(sets))
        linked = 100 * common >= percent * (sizes[i] + sizes - common)
        if across:
            linked &= cell != cell[i]
        linked[i] = True
        old = np.unique(cluster[linked])
        if len(old) > 1:
            cluster[np.isin(cluster, old)] = old[0]
    return smallest(keys, cluster)


def jaccard_groups(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash`` for every row; ``text_hash`` is
    Spark's ``xxhash64`` of the text. Ids must be integers."""
    base = with_package(docs).select(
        F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    known = base.filter("id is not null")
    buckets = max(1, -(-docs.count() // (2 * SLICE)))
    numbered = known.withColumn(
        "slice", F.floor(F.monotonically_increasing_id() / SLICE).cast("long")
    )
    found = stored(
        numbered.mapInArrow(partial(send, width=width, percent=percent, buckets=buckets), SENT)
        .groupBy("bucket")
        .applyInPandas(lambda rows: meet(rows, buckets), FOUND),
        "jaccard-found",
    )
    documents = found.filter(F.col("kind") == DOC).drop("kind", "b")
    nodes = (
        documents.filter("octet_length(sketch) > 0 and n_shingles > 0")
        .groupBy("a")
        .agg(*[F.first(c).alias(c) for c in ("key", "n_shingles", "sketch", "fine")])
    )

    pairs = (
        found.filter(F.col("kind") == PAIR)
        .select("a", "sketch")
        .groupBy("a")
        .applyInPandas(lambda rows: part_pairs(rows), "x bigint, y bigint")
        .distinct()
    )
    key_of = lambda name: nodes.select(F.col("a").alias(f"_{name}"), F.col("key").alias(name))
    keyed = pairs.join(key_of("a"), F.col("x") == F.col("_a")).join(key_of("b"), F.col("y") == F.col("_b"))
    shapes = stored(
        nodes.groupBy("key").agg(
            F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine")
        ),
        "jaccard-shapes",
    )

    def filtered(pairs: DataFrame, name: str) -> DataFrame:
        """The distinct pairs of keys that may be similar enough."""
        ordered = (
            pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        for shape in ("sketch", "fine"):  # the coarse ones spare sending most of the fine ones
            for side in "ab":
                own = shapes.select(
                    F.col("key").alias(f"_{side}"), F.col("n").alias(f"n_{side}"), F.col(shape).alias(f"sketch_{side}")
                )
                ordered = ordered.join(own, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
            smaller = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
            ordered = stored(
                ordered.filter(smaller).mapInPandas(partial(close_enough, percent=percent), "a bigint, b bigint"),
                name,
            )
        return ordered

    possible = filtered(keyed.select("a", "b"), "jaccard-possible")
    crowded = (
        found.filter(F.col("kind") == CROWDED)
        .select("a", "sketch")
        .groupBy("a")
        .applyInPandas(lambda rows: crowded_nodes(rows), "x bigint")
        .join(nodes.select("a", "key"), F.col("x") == F.col("a"))
        .select("key")
        .distinct()
    )
    # One document stands for each set.
    holders = documents.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("holder"))

    def sets_of(wanted: DataFrame, columns: str) -> DataFrame:
        """The elements of the sets in ``wanted (key, ...)``, whose other columns they take along."""
        places = holders.join(wanted, "key").drop("key")
        mark = (F.col("id") == F.col("holder.doc_id")) & (F.col("text_hash") == F.col("holder.text_hash"))
        texts = known.join(places, mark).dropDuplicates(["id", "text_hash"]).drop("id", "text_hash", "holder")
        return texts.mapInArrow(partial(element_sets, width=width), f"key bigint, elements binary{columns}")

    dense = stored(sets_of(crowded, ""), "jaccard-sets")
    # Only an order of elements: a bounded list of the most frequent, the rest by hash.
    top = (
        dense.mapInArrow(partial(often, least=4), "element bigint, sets bigint")
        .groupBy("element")
        .agg(F.sum("sets").alias("sets"))
        .orderBy(F.desc("sets"), "element")
        .limit(COMMON)
        .collect()
    )
    common = np.array([r["element"] for r in top], np.int64).view(np.uint64)
    by_value = np.argsort(common)
    rank = len(common) - by_value  # the most frequent has the last place
    first = stored(
        dense.mapInArrow(
            partial(prefixes, percent=percent, common=common[by_value], rank=rank), "element bigint, key bigint"
        ),
        "jaccard-prefixes",
    )
    forget(dense)
    centres = stored(
        first.groupBy(F.col("element").alias("_e"))
        .agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("sets"))
        .filter("sets > 1"),
        "jaccard-centres",
    )
    met = first.join(centres, F.col("element") == F.col("_e"))
    short = met.filter(F.col("sets") <= FEW).groupBy("element").agg(F.collect_set("key").alias("keys"))
    likely = filtered(
        short.select("keys").distinct().mapInPandas(run_pairs, "a bigint, b bigint"), "jaccard-likely"
    )
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(BAND)).cast("int").alias("band")
    reach = int(np.ceil(np.log(100 / percent) / np.log(BAND)))
    stars = met.filter(F.col("sets") > FEW).select(F.col("b").alias("group"), F.col("key").alias("member")).distinct()
    stars = stars.join(shapes.select("key", "n"), F.col("member") == F.col("key")).select("group", "member", band)
    stars = stored(stars, "jaccard-stars")
    forget(first)
    like = stored(
        in_blocks(stars, WIDE, reach)
        .join(shapes.select("key", "n", "fine"), F.col("member") == F.col("key"))
        .groupBy("group", "low", "high")
        .applyInPandas(lambda rows: block_candidates(rows, percent), "a bigint, b bigint"),
        "jaccard-like",
    )
    clusters = components(possible.union(likely).union(like))
    members = clusters.join(shapes, F.col("node") == F.col("key")).select(
        F.col("component").alias("group"), F.col("node").alias("member"), band
    )
    block = "group", "low", "high", "cell"
    placed = in_blocks(members, CHUNK, reach).groupBy(F.col("member").alias("key"))
    placed = placed.agg(F.collect_list(F.struct(*block)).alias("blocks"))
    columns = ", blocks array<struct<" + ",".join(f"{c}: bigint" for c in block) + ">>"
    links = (
        sets_of(placed, columns)
        .select("key", "elements", F.explode("blocks").alias("block"))
        .select("key", "elements", "block.*")
        .groupBy("group", "low", "high")
        .applyInPandas(lambda rows: block_links(rows, percent), "a bigint, b bigint")
    )
    groups = components(links)
    own = documents.join(groups, F.col("key") == F.col("node"), "left").withColumn(
        "_group", F.coalesce("component", "key")
    )
    own = own.filter("n_shingles > 0")
    # Stored, so that the join below meets plain tables and a group of very many documents is split.
    least = stored(
        own.groupBy(F.col("_group").alias("_g")).agg(F.min("doc_id").alias("component_id")), "jaccard-least"
    )
    linked = own.join(least, F.col("_group") == F.col("_g")).select(
        "doc_id", "n_shingles", "component_id", "text_hash", F.col("_group").alias("group_key")
    )
    none = F.lit(None).cast("long")
    alone = documents.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", none.alias("group_key")
    )
    nameless = (
        base.filter("id is null")
        .mapInArrow(partial(element_counts, width=width), "n_shingles bigint, text_hash bigint")
        .select(none.alias("doc_id"), "n_shingles", none.alias("component_id"), "text_hash", none.alias("group_key"))
    )
    return linked.union(alone).union(nameless)


def element_counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column("text").to_pylist(), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(s) for s in sets], pa.int64()), batch.column("text_hash")],
            names=["n_shingles", "text_hash"],
        )


def keep_one_of_each(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row of each group: the document with the smallest id, of several texts of that id the one with
    the smallest hash. Texts without shingles are in no group and stay, as rows without an id do; rows
    that share an id with unrelated texts are told apart by their texts.
    """
    groups = jaccard_groups(docs, id=id, text=text, width=width, percent=percent).filter("doc_id is not null")
    chosen = (
        groups.filter("group_key is not null")
        .groupBy("group_key")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .select("first.*", F.lit(True).alias("one"))
        .distinct()
    )
    alone = groups.filter("group_key is null").select("doc_id", "text_hash", F.lit(False).alias("one")).distinct()
    picked = ("doc_id", "text_hash", "one")
    key, mark, one = (unused(docs, f"picked_{c}") for c in picked)
    stay = chosen.unionByName(alone).select(*[F.col(c).alias(n) for c, n in zip(picked, (key, mark, one))])
    # Stored ids are not NULL, and rows come dealt by what they are told apart by: their texts travel once.
    kept = docs.join(stay, (docs[id].cast("long") == F.col(key)) & (F.xxhash64(docs[text]) == F.col(mark)), "inner")
    once = kept.filter(F.col(one)).dropDuplicates([key, mark])
    every = [once, kept.filter(~F.col(one)), docs.filter(docs[id].isNull())]
    return reduce(DataFrame.unionByName, [df.select(*docs.columns) for df in every])

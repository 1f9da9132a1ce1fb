"""Near-duplicate vectors by cross-polytope hashing, every candidate pair verified.

A vector, padded to a power of two, is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the axis, with sign, it then lies nearest to. ``functions`` such hashes in a
row make a table's bucket. In each of ``tables`` tables a vector also probes the bucket with its
least certain hash replaced by the second best axis. Buckets hold one label and dimension only. Two vectors with cosine
0.98 share one with a probability above 0.999 at the defaults.

Equal vectors of a label are one class and travel as one. A bucket with two classes or more is dealt
in blocks of bounded size; a block takes all its cosines in double precision by matrix
multiplication. A pair that meets in several buckets counts in the first only, which both sides'
hashes tell. A block returns for each linked class how many vectors it found and the smallest class it is connected to;
pairs are never listed.

Vectors that are NULL, empty, zero, or hold NULL, NaN or infinite components, and those with a NULL
label or id, are compared with nothing: no links, their own component. ``kept`` is false for a NULL id. Repeated
rows are vectors of their own and linked with each other. An empty table gives an empty result.
"""

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.components import components, in_blocks
from ordersight.llm.shingles import mix
from ordersight.llm.store import stored, with_package

CHUNK = 128
BLOCK = ["group", "low", "high"]


@lru_cache(maxsize=64)
def signs(padded: int, rotation: int, seed: int) -> np.ndarray:
    return np.random.default_rng([padded, rotation, seed]).choice([-1.0, 1.0], size=(3, padded))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        rows = rows.reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def codes(unit: np.ndarray, tables: int, functions: int, seed: int) -> np.ndarray:
    """For each unit vector, 64-bit bucket names: two for every table."""
    n, size = unit.shape
    padded = 1 << max(1, (size - 1).bit_length())
    start = np.zeros((n, padded))
    start[:, :size] = unit
    out = np.zeros((n, tables, 2), np.uint64)
    every = np.arange(n)
    for t in range(tables):
        best = np.zeros((functions, n), np.int64)
        second = np.zeros((functions, n), np.int64)
        margin = np.zeros((functions, n))
        for f in range(functions):
            rows = start
            for sign in signs(padded, t * functions + f, seed):
                rows = hadamard(rows * sign)
            height = np.abs(rows)
            first = height.argmax(axis=1)
            best[f] = 2 * first + (rows[every, first] < 0)
            top = height[every, first]
            height[every, first] = -1
            other = height.argmax(axis=1)
            second[f] = 2 * other + (rows[every, other] < 0)
            margin[f] = top - height[every, other]
        weak = margin.argmin(axis=0)
        probe = best.copy()
        probe[weak, every] = second[weak, every]
        for j, axes in enumerate((best, probe)):
            name = np.full(n, (t << 32) + padded, np.uint64)
            for f in range(functions):
                name = mix(name, f + 1) ^ axes[f].astype(np.uint64)
            out[:, t, j] = mix(name, 99)
    return out.reshape(n, tables * 2)


def hashed(
    batches: Iterator[pd.DataFrame], tables: int, functions: int, seed: int
) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for size, part in rows.groupby(rows["embedding"].map(len)):
            vectors = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            label = part["label"].map(hash).to_numpy().astype(np.int64).astype(np.uint64)
            found = mix(codes(unit, tables, functions, seed), 5) ^ mix(mix(label, int(size)), 6)[:, None]
            yield part[["rep", "copies"]].assign(
                unit=list(unit), codes=list(found.astype(np.int64))
            )


def sorted_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole blocks and the places where blocks begin and end.

    Rows come sorted by block; the last block of a batch may go on in the next.
    """
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key = rows[BLOCK].to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        done = edges[-1] if len(edges) else 0
        if done:
            yield rows.iloc[:done], np.concatenate([[0], edges])
        rest = rows.iloc[done:]
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def block_links(
    close: np.ndarray, names: np.ndarray, bucket: int, copies: np.ndarray, reps: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked classes of a block, their links found here and the smallest class they reach."""
    left, right = np.nonzero(close)
    # Tables in order, and the smaller name first within one: the first bucket two classes share.
    a = np.sort(names[left].reshape(len(left), -1, 2), axis=2)
    b = names[right].reshape(len(left), -1, 2)
    shared = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3).reshape(len(left), -1)
    first = a.reshape(len(left), -1)[np.arange(len(left)), shared.argmax(axis=1)]
    left, right = left[first == bucket], right[first == bucket]
    links = np.bincount(left, copies[right], len(reps)).astype(np.int64)
    near = reps.copy()
    while len(left):
        low = near.copy()
        np.minimum.at(low, left, near[right])
        if (low == near).all():
            break
        near = low
    return reps[links > 0], links[links > 0], near[links > 0]


def links_of_blocks(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for rows, edges in sorted_blocks(batches):
        whole = {c: rows[c].to_numpy() for c in rows.columns}
        found = []
        for begin, end in zip(edges[:-1], edges[1:]):
            if end - begin < 2:
                continue
            block = {c: v[begin:end] for c, v in whole.items()}
            unit = np.stack(block["unit"])
            close = unit @ unit.T >= least
            np.fill_diagonal(close, False)
            if block["low"][0] != block["high"][0]:
                close &= block["cell"][:, None] != block["cell"][None, :]
            if close.any():
                names = np.stack(block["codes"])
                found.append(block_links(close, names, block["group"][0], block["copies"], block["rep"]))
        if found:
            rep, links, near = map(np.concatenate, zip(*found))
            yield pd.DataFrame({"rep": rep, "links": links, "near": near})


def embedding_links(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    tables: int = 12,
    functions: int = 2,
    seed: int = 17,
) -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component_id`` and ``kept``. Ids must be integers."""
    base = with_package(vectors).select(
        F.col(id).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("embedding"),
        F.col(label).cast("string").alias("label"),
    )
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    marked = base.withColumn("usable", usable)
    # 128 bits name a class, so that the arrays need not be compared or sent.
    name = [F.xxhash64("label", "embedding").alias("c1"), F.xxhash64(F.lit(1), "label", "embedding").alias("c2")]
    classes = stored(
        marked.filter("usable")
        .select(*name, "vec_id", "label", "embedding")
        .groupBy("c1", "c2")
        .agg(
            F.min("vec_id").alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        ),
        "embed-classes",
    )
    coded = stored(
        classes.select("rep", "copies", F.xxhash64("label").alias("label"), "embedding").mapInPandas(
            partial(hashed, tables=tables, functions=functions, seed=seed),
            "rep bigint, copies bigint, unit array<double>, codes array<bigint>",
        ),
        "embed-codes",
    )
    shared = stored(
        coded.select(F.explode(F.array_distinct("codes")).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("_bucket"),
        "embed-buckets",
    )
    placed = coded.select("rep", F.explode(F.array_distinct("codes")).alias("bucket"))
    members = placed.join(shared, F.col("bucket") == F.col("_bucket")).select(
        F.col("bucket").alias("group"), F.col("rep").alias("member"), F.lit(0).alias("band")
    )
    blocks = in_blocks(members, CHUNK)
    whole = coded.withColumnRenamed("rep", "_rep")
    found = stored(
        blocks.join(whole, F.col("member") == F.col("_rep"))
        .withColumnRenamed("_rep", "rep")
        .select(*BLOCK, "cell", "rep", "copies", "unit", "codes")
        .repartition(*BLOCK)
        .sortWithinPartitions(*BLOCK)
        .mapInPandas(partial(links_of_blocks, least=least), "rep bigint, links bigint, near bigint"),
        "embed-links",
    )
    groups = components(found.select(F.col("rep").alias("a"), F.col("near").alias("b")).filter("a <> b"))
    counted = found.groupBy(F.col("rep").alias("_rep")).agg(F.sum("links").alias("links"))
    per_class = stored(
        classes.select("c1", "c2", "rep", "copies")
        .join(counted, F.col("rep") == F.col("_rep"), "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(
            "c1",
            "c2",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        ),
        "embed-results",
    )
    compared = marked.filter("usable").select("vec_id", *name).join(per_class, ["c1", "c2"])
    rest = marked.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = compared.select("vec_id", "n_links", "component_id").union(rest)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.withColumn("kept", kept).withColumnRenamed("vec_id", id)

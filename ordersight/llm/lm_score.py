"""Log-probabilities of texts under a smoothed n-gram model that is never gathered in one place.

Model. P1(w) = (c(w) + 1) / (N + V + 1). Longer contexts u mix in the next shorter one:
P(w|u) = (c(uw) + t(u) P(w|shorter u)) / (c(u) + t(u)), where t(u) = ``mass`` * c(u)^b is the weight of
falling back, and b is fitted so that the sum of c(u)^b over all words is the number of distinct bigrams (how many
continuations a word of count c has). Every P(.|u) sums to 1.

Automaton. A state is a known context. It has an arc for each seen continuation, weighted
log10 P(w|u), and a failure arc to the next shorter context, weighted log10 t(u) / (c(u) + t(u)). A text is scored in one pass
from left to right that carries the state: it follows failure arcs until a word has an arc.

Where the counts live. Documents are taken in slices of ``slice_rows`` rows of the input's scan. A
slice sends its distinct n-grams, as hashes with the slice's own training counts, to buckets by hash;
a bucket adds them up and returns the totals, in the order asked, to every slice that sent them. So a
frequent word or passage is one number per slice, buckets are even, and a slice's part of
the automaton is all it needs. Hashes have 48 bits below the bucket.

``docs`` is read twice and its rows must come in the same partitions and order both times, as
those of stored tables do; use ``store.stored`` for anything else. A NULL text has only the end
token. A NULL id counts as the empty string for the fold. Repeated rows are documents of their
own. An empty table gives an empty result. Texts are read whole.
"""

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.store import stored, with_package

END, BEGIN = b"\n", b"\n\n"  # no words: words hold no white space
BETAS = np.linspace(0.0, 1.0, 41)
ASK = "bucket bigint, slice bigint, n int, keys binary, counts binary"
ASK_ARROW = pa.schema(
    [
        ("bucket", pa.int64()),
        ("slice", pa.int64()),
        ("n", pa.int32()),
        ("keys", pa.binary()),
        ("counts", pa.binary()),
    ]
)
ANSWER = "slice bigint, bucket bigint, n int, totals binary, tokens bigint, types bigint, powers array<double>"
SCORED = (
    "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)
LOW = np.uint64((1 << 48) - 1)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """The n-grams of some documents: for each order, distinct hashes and each token's place there.

    Hashes are sorted by bucket, then by their low 48 bits.
    """

    def __init__(self, texts: list, order: int, buckets: int):
        index: dict[bytes, int] = {END: 0, BEGIN: 1}
        streams, sizes = [], []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            words.append(END)
            for word in words:
                if word not in index:
                    index[word] = len(index)
            streams.append(np.array([index[w] for w in words], np.int32))
            sizes.append(len(words))
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        tokens = np.concatenate(streams) if streams else np.zeros(0, np.int32)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in index], np.uint64)
        own = hashes[tokens]
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        gram, back = own, own
        for n in range(order):
            if n:
                # The token n places earlier, or the beginning of the document.
                earlier = np.concatenate([np.full(1, hashes[1], np.uint64), back[:-1]])
                earlier[self.starts] = hashes[1]
                back = earlier
                gram = mix(earlier, gram)
            low = gram & LOW
            bucket = (gram >> np.uint64(40)) % np.uint64(buckets)
            whole, place = np.unique((bucket << np.uint64(48)) | low, return_inverse=True)
            self.keys.append(whole & LOW)
            self.owners.append((whole >> np.uint64(48)).astype(np.int64))
            self.places.append(place)

    def counts(self, n: int, train: np.ndarray) -> np.ndarray:
        weight = np.repeat(train, self.sizes)
        return np.bincount(self.places[n][weight], minlength=len(self.keys[n]))


def six_bytes(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(data, "u1").reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def small(counts: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, compressed."""
    for kind in ("<u1", "<u2", "<u4", "<u8"):
        if not len(counts) or counts.max() <= np.iinfo(kind).max:
            return kind[-1].encode() + zlib.compress(counts.astype(kind).tobytes(), 1)
    raise ValueError("count too large")


def from_small(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.int64)


def ask(
    batches: Iterator[pa.RecordBatch], order: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    """The n-grams of each slice, by bucket. The rows of a slice follow each other."""
    current, held, texts = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        part = Slice(texts, order, buckets)
        train = ~np.array(held, bool)
        for n in range(order):
            counts = part.counts(n, train)
            owners = part.owners[n]
            cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
            rows = [
                (int(owners[a]), current, n, six_bytes(part.keys[n][a:b]), small(counts[a:b]))
                for a, b in zip(cuts, cuts[1:])
                if b > a
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*rows), ASK_ARROW)], schema=ASK_ARROW
            )

    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            some = batch.slice(begin, 512)
            for slice_, out, text in zip(*[some.column(c).to_pylist() for c in ("slice", "held", "text")]):
                if slice_ != current and texts:
                    yield from flush()
                    held, texts = [], []
                current = slice_
                held.append(out)
                texts.append(text)
    if texts:
        yield from flush()


def add_up(asked: pd.DataFrame) -> pd.DataFrame:
    """Totals for everything asked of one bucket, and the bucket's sums over distinct n-grams."""
    out = []
    for n, rows in asked.groupby("n"):
        keys = [from_six_bytes(k) for k in rows["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([from_small(c) for c in rows["counts"]])
        totals = np.bincount(place, counts, len(distinct)).astype(np.int64)
        seen = totals[totals > 0].astype(float)
        powers = [float((seen**b).sum()) for b in BETAS] if n == 0 else []
        for i, (slice_, bucket, end, own) in enumerate(zip(rows["slice"], rows["bucket"], ends, keys)):
            first = i == 0  # the bucket's sums stand in one row
            out.append(
                (
                    slice_,
                    bucket,
                    n,
                    small(totals[place[end - len(own) : end]]),
                    int(totals.sum()) if first else 0,
                    len(seen) if first else 0,
                    powers if first else [],
                )
            )
    return pd.DataFrame(out, columns=["slice", "bucket", "n", "totals", "tokens", "types", "powers"])


class Automaton:
    """A slice's part of the model, as arrays over its distinct n-grams of each order."""

    def __init__(self, part: Slice, totals: list[np.ndarray], tokens: int, types: int, beta: float, mass: float):
        self.part, self.totals = part, totals
        self.root = np.log10((totals[0] + 1.0) / (tokens + types + 1.0))
        self.beta, self.mass = beta, mass
        ends = part.places[0][part.starts + part.sizes - 1]
        documents = int(totals[0][ends[0]]) if len(ends) else 0
        #: For each order and token: log-weight of its arc, and of the failure arc of the state before.
        self.arcs: list[np.ndarray] = [self.root[part.places[0]]]
        self.fails: list[np.ndarray] = [np.zeros(len(part.places[0]))]
        lower = 10.0 ** self.arcs[0]
        for n in range(1, len(totals)):
            # The context is the n-gram of the token before; at a document's start, the start itself.
            context = np.concatenate([[0], totals[n - 1][part.places[n - 1]][:-1]]).astype(float)
            context[part.starts] = documents
            for k in range(1, n):  # contexts that reach over the start hold it, too
                inside = part.starts[part.sizes > k] + k
                context[inside] = totals[n - 1][part.places[n - 1]][inside - 1]
            fallback = mass * context**beta
            count = totals[n][part.places[n]].astype(float)
            known = context > 0
            weight = np.where(known, context + fallback, 1.0)
            prob = np.where(known, (count + fallback * lower) / weight, lower)
            with np.errstate(divide="ignore"):
                self.arcs.append(np.where(count > 0, np.log10(prob), np.nan))
                self.fails.append(np.where(known, np.log10(np.where(known, fallback, 1.0) / weight), 0.0))
            lower = prob

    def traverse(self, begin: int, end: int) -> float:
        """Follow one document's tokens from left to right, carrying the state."""
        arcs = [a[begin:end].tolist() for a in self.arcs]
        fails = [f[begin:end].tolist() for f in self.fails]
        top = len(arcs) - 1
        state, total = top, 0.0  # words of context that the state knows; the start is known
        for at in range(end - begin):
            weight = arcs[state][at]
            while weight != weight:  # no such arc: fail to the shorter context
                total += fails[state][at]
                state -= 1
                weight = arcs[state][at]
            total += weight
            if state < top:
                state += 1
        return total


def score_slice(
    docs: pd.DataFrame,
    answers: pd.DataFrame,
    order: int,
    buckets: int,
    tokens: int,
    types: int,
    beta: float,
    mass: float,
) -> pd.DataFrame:
    if docs.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in SCORED.split(", ")])
    texts = [t if isinstance(t, str) else None for t in docs["text"]]
    part = Slice(texts, order, buckets)
    answers = answers.sort_values(["n", "bucket"])
    totals = []
    for n in range(order):
        found = [from_small(t) for t in answers.loc[answers["n"] == n, "totals"]]
        totals.append(np.concatenate(found))
        if len(totals[n]) != len(part.keys[n]):
            raise ValueError("the documents of a slice changed between two reads; store them first")
    model = Automaton(part, totals, tokens, types, beta, mass)
    known = (totals[0] > 0)[part.places[0]]
    ends = part.starts + part.sizes
    return pd.DataFrame(
        {
            "doc_id": docs["id"],
            "held_out": docs["held"],
            "n_tokens": part.sizes,
            "n_known": np.add.reduceat(known.astype(np.int64), part.starts),
            "train_tokens": tokens,
            "base_score": np.add.reduceat(model.arcs[0], part.starts),
            "score": [model.traverse(a, b) for a, b in zip(part.starts.tolist(), ends.tolist())],
        }
    )


def fitted_beta(powers: list[float], bigrams: int) -> float:
    """The exponent whose sum over words is the number of distinct bigrams, at most 1."""
    return float(np.interp(bigrams, powers, BETAS)) if powers and powers[-1] > 0 else 1.0


def lm_score(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    order: int = 2,
    folds: int = 7,
    fold: int = 2,
    mass: float = 3.0,
    slice_rows: int = 4096,
) -> DataFrame:
    """One row per document, see ``SCORED``; documents of ``fold`` are scored but not learnt from.

    ``order`` is the longest n-gram. Ids must be integers or strings.
    """
    name = F.col(id).cast("string")  # ids travel as text, which pandas leaves as it is
    sliced = with_package(docs).select(
        name.alias("id"),
        (F.crc32(F.coalesce(name, F.lit(""))) % folds == fold).alias("held"),
        F.col(text).alias("text"),
        F.floor(F.monotonically_increasing_id() / slice_rows).cast("long").alias("slice"),
    )
    kind = docs.schema[id].dataType.simpleString()
    buckets = max(1, -(-docs.count() // slice_rows))
    shape = {"order": order, "buckets": buckets}
    answers = stored(
        sliced.mapInArrow(partial(ask, **shape), ASK)
        .groupBy("bucket")
        .applyInPandas(add_up, ANSWER),
        "lm-answers",
    )
    # Sums over buckets: a few numbers.
    sums = answers.groupBy("n").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    by_order = {r["n"]: r for r in sums.collect()}
    if not by_order:
        return docs.sparkSession.createDataFrame([], SCORED).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", id)
    powers = (
        answers.filter("n = 0 and types > 0")
        .select(F.posexplode("powers").alias("at", "sum"))
        .groupBy("at")
        .agg(F.sum("sum").alias("sum"))
        .orderBy("at")
        .collect()
    )
    bigrams = by_order[1]["types"] if order > 1 else 0
    scorer = partial(
        score_slice,
        **shape,
        tokens=by_order[0]["tokens"],
        types=by_order[0]["types"],
        beta=fitted_beta([r["sum"] for r in powers], bigrams),
        mass=mass,
    )

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return scorer(left, right)

    return (
        sliced.groupBy("slice")
        .cogroup(answers.select("slice", "bucket", "n", "totals").groupBy("slice"))
        .applyInPandas(scored, SCORED)
        .withColumn("doc_id", F.col("doc_id").cast(kind))
        .withColumnRenamed("doc_id", id)
    )

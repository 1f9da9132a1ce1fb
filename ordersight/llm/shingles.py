"""Sets of word shingles as 64-bit hashes, and their PartEnum signatures.

PartEnum, for sets a and b with 100 |a & b| >= percent |a | b|. Their sizes differ by a bounded ratio, and they differ in at
most k elements, k following from the larger size allowed. Sizes are cut into bands; a band's
instance serves the pairs whose smaller set lies in it, so a set belongs to the instance of its band
and, if small enough in it, to the one before.

An instance cuts the domain of elements into n1 first-level partitions, and each into three cells. With
n1 > k / 2 some partition holds at most one difference, so dropping one of its cells leaves equal
projections: the signatures are, for every partition, its three subsets of two cells. An empty
projection says nothing and gives no signature. A set in which more than k / 2 partitions have
elements in two cells or more still meets every partner (here k may be the set's own, smaller one). A
pair could only be missed if both sets lack that; such sets also give the whole projections of
2 (k + 1), 4 (k + 1), ... partitions, up to the first number of which more than k are not empty.
"""

from functools import lru_cache

import numpy as np
import xxhash

CELLS = 3


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """Distinct hashes of runs of ``width`` words, sorted; a shorter text is one run, no words none."""
    index: dict[bytes, int] = {}
    streams = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        for word in words:
            if word not in index:
                index[word] = len(index)
        streams.append(np.array([index[w] for w in words], np.int32))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in index], np.uint64)
    out = []
    for stream in streams:
        own = hashes[stream] if len(stream) else np.zeros(0, np.uint64)
        runs = max(1, len(own) - width + 1) if len(own) else 0
        gram = np.full(runs, min(len(own), width), np.uint64)
        for j in range(min(width, len(own))):
            gram = mix(gram, 1) ^ own[j : j + runs]
        out.append(np.unique(mix(gram, 2)))
    return out


def largest_partner(size: int, percent: int) -> int:
    return size * 100 // percent


def differences(a: int, b: int, percent: int) -> int:
    """Elements in just one of two sets of these sizes, at most, if they are similar enough."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=64)
def bands(percent: int, upto: int) -> np.ndarray:
    """The first size of each band; a band spans twice the ratio that sizes may differ by."""
    found = [1]
    while found[-1] <= upto:
        found.append(max(found[-1] + 1, found[-1] * 100 * 100 // (percent * percent)))
    return np.array(found)


def instances(size: int, percent: int) -> list[tuple[int, int]]:
    """The instances a set of this size belongs to, with their k."""
    begins = bands(percent, 1 << max(10, size.bit_length()))
    own = int(np.searchsorted(begins, size, "right")) - 1
    out = []
    for band in (own, own - 1):
        if band >= 0:
            smaller = int(begins[band + 1]) - 1
            if band == own or size <= largest_partner(smaller, percent):
                out.append((band, differences(smaller, largest_partner(smaller, percent), percent)))
    return out


def partitions(k: int) -> int:
    """First-level partitions: as many as needed, and some for those with a lone cell."""
    half = k // 2
    return half + 1 + half // 8 + 2


def signatures(elements: np.ndarray, percent: int, seed: int = 0) -> np.ndarray:
    """The signatures of one set as 64-bit hashes."""
    if percent <= 50:
        raise ValueError("signatures are for similarities above 50 percent")
    out = []
    # The most this set can differ from any partner, which its band's k may exceed.
    own = differences(len(elements), largest_partner(len(elements), percent), percent)
    value = mix(elements, 101 + seed)
    place = mix(elements, 202 + seed)
    for band, k in instances(len(elements), percent):
        n1 = partitions(k)
        cell = ((place >> np.uint64(8)) % np.uint64(n1)).astype(np.int64) * CELLS
        cell += ((place & np.uint64(0xFF)) % np.uint64(CELLS)).astype(np.int64)
        sums = np.zeros(n1 * CELLS, np.uint64)
        np.add.at(sums, cell, value)
        filled = (np.bincount(cell, minlength=n1 * CELLS) > 0).reshape(n1, CELLS)
        sums = sums.reshape(n1, CELLS)
        rest = sums.sum(axis=1, keepdims=True) - sums
        others = filled.sum(axis=1, keepdims=True) - filled
        name = np.arange(n1 * CELLS, dtype=np.uint64).reshape(n1, CELLS)
        name = name + np.uint64((band + 1) << 40)
        out.append(mix(rest ^ mix(name, 3), 4 + seed)[others > 0])
        solid = int((filled.sum(axis=1) > 1).sum())
        scheme = 0
        while scheme == 0 and solid <= own // 2 or scheme and full <= own:
            scheme += 1
            n = (k + 1) << scheme
            part = (mix(place, scheme) % np.uint64(n)).astype(np.int64)
            sums = np.zeros(n, np.uint64)
            np.add.at(sums, part, value)
            held = np.bincount(part, minlength=n) > 0
            full = int(held.sum())
            name = np.arange(n, dtype=np.uint64) + np.uint64(((band + 1) << 40) + (scheme << 34))
            out.append(mix(sums ^ mix(name, 5), 6 + seed)[held])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a & b| >= percent |a | b| for sorted distinct hashes."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common) and len(both) > 0


def to_bytes(elements: np.ndarray) -> bytes:
    """Sorted elements in six bytes each: their upper 48 bits."""
    return (elements >> np.uint64(16)).astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), "u1")
    wide[:, :6] = np.frombuffer(data, "u1").reshape(-1, 6)
    return wide.reshape(-1).view("<u8")

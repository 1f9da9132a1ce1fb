"""Token ids in 64-bit words: a selector in the top 4 bits, and 60 bits of equally wide slots.

A stream is cut into blocks of ``BLOCK`` ids, each starting a word of its own; per block, the
index of its first word and of its first escape are kept, so that any run of blocks can be
decoded alone. An id too wide for 20 bits is an escape: its slot holds all ones and the id stands in a list.
Encoding takes, at each place, the selector with most slots that hold the next ids; all blocks of
a frame advance together, one word at a time, in numpy.

A frame is a file section for consecutive documents, little-endian:

    magic "S8B1" | u32 documents, blocks, words, escapes | u64 ids
    i64 doc ids | u8 whether the id is known | u32 lengths | u32 first words | u32 first escapes
    u64 words | u32 escapes
"""

import struct
from dataclasses import dataclass

import numpy as np

BLOCK = 240
MAGIC = b"S8B1"
HEAD = struct.Struct("<4s4IQ")

#: Slots in a word and their width in bits, by selector.
SLOTS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))

COUNT = np.array([n for n, _ in SLOTS])
ESCAPED = 13  # the selector whose slots can hold an escape
ESCAPE = (1 << 20) - 1
#: The first selector with no more slots than so many ids are left.
FITTING = np.array([int(np.argmax(COUNT <= max(left, 1))) for left in range(BLOCK + 1)])


def _all_of(ok: np.ndarray, n: int) -> np.ndarray:
    """Whether ``ok`` holds at a place and the ``n - 1`` after it; nothing holds past the end."""
    done, out = 1, ok
    while done < n:
        step = min(done, n - done)
        out = out & np.concatenate([out[step:], np.zeros(min(step, len(out)), bool)])
        done += step
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, first word and first escape of every block."""
    ids = ids.astype(np.uint32)
    total = len(ids)
    codes = np.minimum(ids, ESCAPE)
    best = np.full(total, ESCAPED, np.uint8)
    for s in range(ESCAPED - 1, -1, -1):
        n, width = SLOTS[s]
        fits = _all_of(codes < (1 << width), n)
        if not fits.any():
            break  # then more ids with fewer bits fit nowhere either
        best[fits] = s
    begins = np.arange(0, total, BLOCK)
    ends = np.minimum(begins + BLOCK, total)
    at, owner = begins.copy(), np.arange(len(begins))
    places, chosen, owners = [], [], []
    while len(at):
        s = np.maximum(best[at], FITTING[ends[owner] - at])
        # The last one or two ids of a block take wide slots, which know no escape.
        s[(s == 14) & (ids[at] | ids[np.minimum(at + 1, total - 1)] >= 1 << 30)] = 15
        places.append(at)
        chosen.append(s)
        owners.append(owner)
        at = at + COUNT[s]
        alive = at < ends[owner]
        at, owner = at[alive], owner[alive]
    if not places:
        none = np.zeros(0, np.uint32)
        return np.zeros(0, np.uint64), none, none, none
    where, select, block = (np.concatenate(x) for x in (places, chosen, owners))
    order = np.argsort(where)
    where, select, block = where[order], select[order], block[order]
    words = select.astype(np.uint64) << np.uint64(60)
    wide = ids.astype(np.uint64)
    for s in np.unique(select):
        n, width = SLOTS[s]
        if width:
            source = codes if s == ESCAPED else wide
            rows = np.flatnonzero(select == s)
            for j in range(n):
                words[rows] |= source[where[rows] + j].astype(np.uint64) << np.uint64(j * width)
    slotted = np.zeros(total, bool)
    rows = where[select == ESCAPED]
    for j in range(SLOTS[ESCAPED][0]):
        slotted[rows + j] = True
    escaped = np.flatnonzero(slotted & (codes == ESCAPE))
    first_word = np.searchsorted(where, begins).astype(np.uint32)
    first_escape = np.searchsorted(escaped, begins).astype(np.uint32)
    return words, ids[escaped], first_word, first_escape


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole blocks."""
    select = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNT[select]
    where = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint32)
    escaped = []
    for s in np.unique(select):
        n, width = SLOTS[s]
        if width:
            rows = np.flatnonzero(select == s)
            mask = np.uint64((1 << width) - 1)
            for j in range(n):
                out[where[rows] + j] = ((words[rows] >> np.uint64(j * width)) & mask).astype(np.uint32)
            if s == ESCAPED and len(escapes):
                spots = (where[rows][:, None] + np.arange(n)).ravel()
                escaped = np.sort(spots[out[spots] == ESCAPE])
    if len(escapes):
        out[escaped] = escapes
    return out


def write_frame(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, escapes, first_word, first_escape = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        [
            HEAD.pack(MAGIC, len(doc_ids), len(first_word), len(words), len(escapes), len(ids)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            np.array(lengths, "<u4").tobytes(),
            first_word.astype("<u4").tobytes(),
            first_escape.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u4").tobytes(),
        ]
    )


@dataclass
class Frame:
    doc_ids: list
    lengths: np.ndarray
    first_word: np.ndarray
    first_escape: np.ndarray
    words: np.ndarray
    escapes: np.ndarray
    n_ids: int

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``begin`` to ``end``, decoding only the blocks that hold them."""
        end = self.n_ids if end is None else end
        if begin >= end:
            return np.zeros(0, np.uint32)
        low, high = begin // BLOCK, -(-end // BLOCK)
        word = [*self.first_word, len(self.words)]
        escape = [*self.first_escape, len(self.escapes)]
        found = unpack(
            self.words[word[low] : word[high]], self.escapes[escape[low] : escape[high]]
        )
        return found[begin - low * BLOCK : end - low * BLOCK]


def read_frame(data: bytes) -> Frame:
    magic, docs, blocks, n_words, n_escapes, n_ids = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("this is no frame of token ids")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, known = take("<i8", docs), take("u1", docs)
    return Frame(
        [int(d) if k else None for d, k in zip(doc_ids, known)],
        take("<u4", docs),
        take("<u4", blocks),
        take("<u4", blocks),
        take("<u8", n_words),
        take("<u4", n_escapes),
        n_ids,
    )

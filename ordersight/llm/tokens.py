"""Token ids of whole texts with the tokenizers library, one pass in the Python workers.

A byte-level tokenizer never merges across a space between two non-blank characters. So a text
is cut there, and each distinct chunk is encoded once per worker and remembered. A text in which a space stands beside
other white space is encoded in one piece. Either way the ids are those of the whole text.

Words of letters are most of what a worker meets for the first time. tiktoken runs their merges, as the
file of the library lists them: the same ids in a third of the time. All else is left to the library.
"""

import json
import os
from array import array
from collections.abc import Collection, Iterator
from functools import lru_cache

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core already

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: What a worker may remember of chunks and words, in bytes.
REMEMBERED = 250_000_000
#: What an entry takes besides its text and ids.
ENTRY = 200
AT_ONCE = 4096
TEXT_BYTES = 16_000_000
#: Words that are encoded as one text.
TOGETHER = 256
#: Letters from here on are left to the library, whose tables of letters may be older.
LATE_LETTERS = "　"


def byte_letters() -> dict[int, str]:
    """How a byte-level model spells bytes that are not printable Latin-1: by letters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


#: Fixed value: how a byte-level tokenizer cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level JSON file, whose merges tiktoken runs faster than the library of the file.

    That needs pieces cut by the usual pattern and byte-level merges in the order of their ids; any
    other file is an error.
    """
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    odd = byte_letters()
    letters = {odd.get(b, chr(b)): bytes([b]) for b in range(256)}
    special = {t["content"] for t in told["added_tokens"]}
    vocab = {s: i for s, i in told["model"]["vocab"].items() if s not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in told["model"]["merges"]]
    cut = told["pre_tokenizer"] or {}
    plain = (
        told["normalizer"] is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut["add_prefix_space"]
        and told["model"]["type"] == "BPE"
        and not any(told["model"].get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix"))
        and sorted(vocab, key=vocab.get)[len(letters) :] == merged
    )
    if not plain:
        raise ValueError(f"{path} is no plain byte-level tokenizer")
    ranks = {b"".join(map(letters.__getitem__, s)): i for s, i in vocab.items()}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def slices(
    batch: pa.RecordBatch, column: str, at_once: int = AT_ONCE, text_bytes: int = TEXT_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``at_once`` texts and, unless a single text has more, ``text_bytes``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin, before = 0, 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(ends, before + text_bytes, "right"))
        end = min(max(end, begin + 1), begin + at_once, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin, before = end, ends[end - 1]


class Encoder:
    """``ids(texts)`` gives each text's ids as unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words come here once, so that remembering them twice only costs time
        self.spelling = byte_letters()
        try:
            self.words = byte_level(path)
        except ValueError:
            self.words = None  # nothing is known of this file's cuts: whole texts go to the library
        else:
            every = range(self.words.n_vocab)
            self.widths = np.array([len(self.words.decode_single_token_bytes(i)) for i in every])
        self.newline = next(self.encode(["\n"]))
        self.forget()

    def forget(self) -> None:
        #: Ids by chunk, the space in front left out; none for a chunk whose text has to be encoded whole.
        self.memo: dict[str, bytes] = {}
        #: The same for words that begin a line, and for full stops and commas.
        self.first: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.held = 0

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for begin in range(0, len(texts), AT_ONCE):
            part = texts[begin : begin + AT_ONCE]
            for found in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                yield array("I", found.ids).tobytes()

    def merge(self, piece: str) -> bytes:
        """Ids of one piece as the tokenizer's pattern cuts them (letters, marks, at most a space in
        front): only the model has to run."""
        if piece.isascii():
            spelled = piece.replace(" ", self.spelling[32])
        else:
            spelled = piece.encode().decode("latin-1").translate(self.spelling)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def merge_words(self, words: list[str]) -> None:
        """Ids of words of letters after a space, many at once: they never merge with each other."""
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        found = [self.words.encode_to_numpy(" " + " ".join(part), disallowed_special=()) for part in parts]
        ids = np.concatenate(found)
        sizes = np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words))
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes + 1)) + 1
        data, bounds = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        self.memo.update(zip(words, map(data.__getitem__, map(slice, bounds, bounds[1:]))))
        self.held += ENTRY * len(words) + int(sizes.sum()) + len(data)

    def word(self, chunk: str, space: str, known: dict[str, bytes]) -> bytes | None:
        """Ids of letters with full stops or commas behind them, after ``space``; None for anything else."""
        letters = chunk.rstrip(".,")
        if not letters.isalpha() or not (letters.isascii() or max(letters) < LATE_LETTERS):
            return None
        ids = known.get(letters)
        if ids is None:
            ids = known[letters] = self.merge(space + letters)
            self.held += ENTRY + len(letters) + len(ids)
        if len(letters) == len(chunk):
            return ids
        marks = chunk[len(letters) :]
        if marks not in self.tails:
            self.tails[marks] = self.merge(marks)
            self.held += ENTRY + len(marks) + len(self.tails[marks])
        return ids + self.tails[marks]

    def learn(self, chunks: Collection[str]) -> None:
        """Ids of new chunks: words, two words with a line end between them, others by the library."""
        other, memo = [], self.memo
        letters = {chunk.rstrip(".,") for chunk in chunks}
        new = [w for w in letters if w.isalpha() and w not in memo and (w.isascii() or max(w) < LATE_LETTERS)]
        if new:
            self.merge_words(new)
        for chunk in chunks:
            if chunk in memo:
                continue  # a word without marks
            ids = self.word(chunk, " ", memo)
            if ids is None and "\n" in chunk:
                before, _, after = chunk.partition("\n")
                last, first = self.word(before, " ", memo), self.word(after, "", self.first)
                ids = None if last is None or first is None else last + self.newline + first
            if ids is not None:
                memo[chunk] = ids
                self.held += ENTRY + len(chunk) + len(ids)
            elif chunk and not chunk[0].isspace() and not chunk[-1].isspace():
                other.append(chunk)
            else:
                memo[chunk] = b""
        for chunk, ids in zip(other, self.encode([" " + c for c in other])):
            memo[chunk] = ids
            self.held += ENTRY + len(chunk) + len(ids)

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        if self.words is None:
            return list(self.encode(texts.to_pylist()))
        if self.held > REMEMBERED:
            self.forget()
        return self.ids_of_batch(texts.cast(pa.large_string()))

    def ids_of_batch(self, texts: pa.Array) -> list[bytes]:
        """Python only meets the different chunks of a batch; Arrow cuts the texts, numpy gathers the ids."""
        cut = pc.split_pattern(texts, " ")
        begins = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy().copy()
        heads = [chunks[i] for i in at[begins[:-1]].tolist()]
        # A text begins without a space, so its first chunk has ids of its own.
        at[begins[:-1]] = np.arange(len(chunks), len(chunks) + len(texts))
        ids = list(map(self.memo.get, chunks))
        if None in ids:
            holes = [i for i, x in enumerate(ids) if x is None]
            self.learn([chunks[i] for i in holes])
            for i in holes:
                ids[i] = self.memo[chunks[i]]
        ids.extend(self.encode(heads))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        odd = sizes == 0
        odd[len(chunks) :] = [head[-1:].isspace() for head in heads]
        odd[len(chunks) :] &= np.diff(begins) > 1
        many = sizes[at]
        ends = np.cumsum(many)
        first = np.cumsum(sizes) - sizes
        source = np.repeat((first[at] - (ends - many)).astype(np.int32), many)
        source += np.arange(len(source), dtype=np.int32)
        gathered = np.frombuffer(b"".join(ids), "<u4")[source].tobytes()
        bounds = (4 * np.concatenate([[0], ends])[begins]).tolist()
        whole = np.logical_or.reduceat(odd[at], begins[:-1]) if len(texts) else odd[:0]
        out = [b"" if w else gathered[x:y] for w, x, y in zip(whole.tolist(), bounds, bounds[1:])]
        again = np.flatnonzero(whole).tolist()
        for i, found in zip(again, self.encode([texts[i].as_py() for i in again])):
            out[i] = found
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    return Encoder(path)

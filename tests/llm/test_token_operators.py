import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import docs as small
from ordersight.llm.packing import batch_pieces, best_fit_decreasing, bins_needed, cut, pack_pieces, token_pieces
from ordersight.llm.simple8b import read_frame, write_frame
from ordersight.llm.store import scratch_path
from ordersight.llm.token_files import read_token_files, write_token_files
from ordersight.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "a", "the", "é", "!", "'s", "\t", "x" * 70, "<|endoftext|>", "12", "　", "\x1c", "word", "日本", ".", ","]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=5))
def test_remembered_chunks_change_no_ids(texts):
    encoder = test_remembered_chunks_change_no_ids.__dict__.setdefault("encoder", Encoder(PATH))
    assert encoder.ids(texts) == list(encoder.encode(texts))


def test_packing_leaves_nothing_remembered(library):
    texts = [small.words(30, start=i) if i % 7 else None for i in range(2500)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    found = [row for b in batch_pieces(iter([batch, batch[:0]]), PATH, 0, 2048) for row in b.to_pylist()]
    assert [(r["doc_id"], r["length"]) for r in found] == [(i, len(library(t))) for i, t in enumerate(texts)]
    assert not encoder(PATH).memo and not encoder(PATH).held
    assert list(batch_pieces(iter([]), PATH, 0, 2048)) == []


@settings(max_examples=100, deadline=None)
@given(
    st.lists(
        st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**32 - 1)),
        max_size=700,
    )
)
def test_simple8b_round_trip(ids):
    frame = read_frame(write_frame([5, None], [len(ids), 0], np.array(ids, np.uint32)))
    assert frame.ids().tolist() == ids and frame.doc_ids == [5, None]
    middle = len(ids) // 3
    assert frame.ids(middle, 2 * middle).tolist() == ids[middle : 2 * middle]


def test_frames_know_themselves():
    with pytest.raises(ValueError):
        read_frame(b"nope" + bytes(40))


def test_token_files(spark, library):
    rows = small.AWKWARD + [(i, f"text number {i} <|endoftext|>", "a") for i in range(50, 90)]
    path = scratch_path(spark, "tokens")
    write_token_files(small.table(spark, rows).repartition(5), path, PATH, frame_ids=300)
    got = sorted(map(tuple, read_token_files(spark, path).collect()), key=lambda r: r[1])
    want, start = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library(t), "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_token_files_of_nothing(spark):
    path = scratch_path(spark, "tokens")
    write_token_files(small.table(spark, []), path, PATH)
    assert read_token_files(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_best_fit_is_valid_and_bounded(lengths):
    lengths = np.array(lengths)
    bins, offsets, used = best_fit_decreasing(lengths, 100)
    load = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        load[b].append((o, n))
    assert len(load) == used
    for items in load.values():
        end = 0
        for o, n in sorted(items):
            assert o == end
            end += n
        assert end <= 100
    rooms = []  # plain best-fit decreasing
    for n in sorted(lengths.tolist(), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((100 if fit is None else fit) - n)
    assert used == len(rooms)
    assert -(-lengths.sum() // 100) <= bins_needed(lengths, 100) <= used


def test_bounds_beat_the_sum():
    assert bins_needed(np.full(7, 51), 100) == 7
    assert bins_needed(np.full(7, 34), 100) == 4
    assert bins_needed(np.zeros(0, int), 100) == 0


def test_cut_leaves_the_rest_in_front():
    assert cut(5, 2) == [(0, 1), (1, 2), (3, 2)]
    assert cut(4, 2) == [(0, 2), (2, 2)]
    assert cut(1, 2) == [(0, 1)]


@pytest.mark.parametrize("group", [8, 1 << 14])
def test_packing(spark, library, group):
    rows = small.AWKWARD + [(i, small.words(i * 37 % 290), "a") for i in range(100, 260)]
    got = pack_pieces(token_pieces(small.table(spark, rows), PATH, 512), 512, group=group).collect()
    want = Counter()
    for d, t, _ in rows:
        ids = np.array(library(t), "<u4")
        for k, (s, n) in enumerate(cut(len(ids), 512)):
            want[(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for items in filled.values():
        end = 0
        for o, n in sorted(items):
            assert o == end
            end += n
        assert end <= 512
    lengths = np.array([r.length for r in got])
    if group > len(got):
        assert len(filled) == best_fit_decreasing(lengths, 512)[2]
    # A certified group may still waste what rounding up its own bound costs, under a sequence each.
    assert len(filled) <= bins_needed(lengths, 512) + -(-len(got) // group)


def test_packing_of_nothing(spark):
    assert pack_pieces(token_pieces(small.table(spark, []), PATH, 512), 512).count() == 0

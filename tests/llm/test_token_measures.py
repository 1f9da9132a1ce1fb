"""Alignment of two tokenizers, token counts and the filter audit, against plain Python."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import docs as small
from ordersight.llm import token_alignment, token_counts as counting
from ordersight.llm.filter_audit import (
    FIGURES,
    audit_orders,
    failed_filters,
    filter_audit,
    mask_cells,
    text_mask,
)
from ordersight.llm.oracles import FILTER_AUDIT
from ordersight.llm.queries import QUERIES
from ordersight.llm.tokens import byte_letters, byte_level

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BITS = [
    "word", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "ß", "▁", "▁x", "a", " b", "7", "123", "...",
    "'s", "\U0001f600", "\xa0", "\x1c", "\x85", "x́", "<s>", "</s>", "<|endoftext|>", "<|startoftext|>",
    "　", "漢字", "\x00", "<0x41>", "don't", ";\r", "--", " ", "İ", "`",
]


def odd_texts(n, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choices(BITS, k=draw.randint(1, 14))) for _ in range(n)]


def spelled_a(tokenizer):
    odd = byte_letters()
    letters = {odd.get(b, chr(b)): bytes([b]) for b in range(256)}
    return {i: b"".join(letters.get(c, c.encode()) for c in s) for s, i in tokenizer.get_vocab().items()}


def aligned_by_hand(texts):
    """Per text: ids of A, of B, groups as (A's, B's) and linked pairs; None where bytes differ."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a = spelled_a(first)

    def piece(i):
        return bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else (
            second.id_to_piece(i).replace("▁", " ").encode()
        )

    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != data or b"".join(map(piece, b)) != data:
            yield None
            continue
        owner_a = [k for k, i in enumerate(a) for _ in bytes_a[i]]
        owner_b = [k for k, i in enumerate(b) for _ in piece(i)]
        links = sorted(set(zip(owner_a, owner_b)))
        groups, i, j = [], 0, 0
        for at in range(len(data)):
            if at + 1 == len(data) or (owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1]):
                groups.append((a[i : owner_a[at] + 1], b[j : owner_b[at] + 1]))
                i, j = owner_a[at] + 1, owner_b[at] + 1
        yield a, b, groups, [(a[x], b[y]) for x, y in links]


def measures_by_hand(texts):
    found = list(aligned_by_hand(texts))
    counts = Counter(pair for f in found if f for pair in set(f[3]))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for f in found:
        if f is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = f
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)
        yield (len(a), len(b), len(groups), len(links), *sums, hashlib.sha256(told.encode()).hexdigest())


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check_alignment(df, rows):
    got = sorted(((r.doc_id is None, r.doc_id or 0), tuple(r[c] for c in ALIGNED)) for r in df.collect())
    wanted = sorted(((d is None, d or 0), m) for (d, *_), m in zip(rows, measures_by_hand([t for _, t, _ in rows])))
    assert got == wanted


@pytest.mark.parametrize("block", [token_alignment.BLOCK, 50])
def test_alignment_of_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(token_alignment, "BLOCK", block)
    rows = small.AWKWARD + [(100 + i, t, "s") for i, t in enumerate(odd_texts(150))] + [(7, "same text", "a")] * 3
    check_alignment(token_alignment.token_alignment(small.table(spark, rows), A, B), rows)


def test_alignment_of_the_given_documents(spark):
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_alignment(QUERIES["op11_token_alignment"](spark, SF), rows)


def test_alignment_of_no_documents(spark):
    assert token_alignment.token_alignment(small.table(spark, []), A, B).collect() == []
    nothing = token_alignment.token_alignment(small.table(spark, [(1, None, "a"), (2, "", "a")]), A, B)
    assert [tuple(r)[1:] for r in nothing.collect()] == [(0,) * 6 + ("",)] * 2


def test_long_texts_are_aligned_a_few_at_once(monkeypatch):
    worker, sizes = token_alignment.aligner(A, B), []
    align = worker.align
    monkeypatch.setattr(worker, "align", lambda texts: sizes.append([len(t) for t in texts]) or align(texts))
    texts = [f"{i} " + "words of a long text " * 20_000 for i in range(12)] + ["short"] * 1300
    keys = [str(i).encode() for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"text": texts, "text_key": keys, "copies": [1] * len(texts)})
    got = pa.Table.from_batches(token_alignment._align(iter([batch]), A, B))
    assert got.column("text_key").to_pylist() == keys
    assert max(map(sum, sizes)) <= token_alignment.TEXT_BYTES and max(map(len, sizes)) <= token_alignment.AT_ONCE
    assert sum(map(len, sizes)) == len(texts)


def test_aligner_remembers_chunks_without_changing_them():
    texts = [t for t in odd_texts(3000, seed=5) if t]
    worker = token_alignment.Aligner(A, B)
    once = [worker.align([t]) for t in texts]
    again = worker.align(texts)
    assert again["groups_sha256"] == [h for x in once for h in x["groups_sha256"]]
    assert (again["totals"] == [x["totals"][0] for x in once]).all()


def test_byte_level_files_are_checked():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    same = byte_level(A)
    texts = odd_texts(2000, seed=9) + ["x" * 3000, " " * 500, "\n" * 99 + "a", "'s't 's" * 9]
    assert [same.encode_ordinary(t) for t in texts] == [
        library.encode(t, add_special_tokens=False).ids for t in texts
    ]
    with pytest.raises(ValueError):
        byte_level(WORDS)


def counted_by_hand(path, texts):
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("path,by_piece", [(WORDS, True), (A, False)])
def test_counts_of_odd_texts(spark, path, by_piece):
    rows = small.AWKWARD + [(100 + i, t, "s") for i, t in enumerate(odd_texts(400))]
    assert counting.PieceCounter(path).by_piece is by_piece
    df = counting.token_counts(small.table(spark, rows), path, 30)
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())
    wanted = zip(rows, counted_by_hand(path, [t for _, t, _ in rows]))
    assert got == sorted(((d or -1), len((t or "").encode()), n, n > 30) for (d, t, _), n in wanted)


def test_counts_of_the_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    counts = dict(zip(docs, counted_by_hand(WORDS, docs.values())))
    assert all((r.n_bytes, r.n_tokens) == (len((docs[r.doc_id] or "").encode()), counts[r.doc_id]) for r in rows)


def test_frequent_pieces_are_bounded_and_caches_emptied(spark, monkeypatch):
    texts = [" ".join(f"w{i % 7} rare{i}-{j}" for j in range(30)) for i in range(60)]
    df = small.table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    monkeypatch.setattr(counting, "FREQUENT", 40)
    assert set(counting.frequent_pieces(df)) == {f"w{i}" for i in range(7)}
    monkeypatch.setattr(counting, "CACHED_CHARS", 100)
    counter = counting.PieceCounter(WORDS)
    assert counter.count(texts, {}) == counted_by_hand(WORDS, texts) == counter.count(texts, {})
    assert len(counter.cache) < 100
    packed = counting.Frequent(["the", "1" * 900], WORDS)
    assert packed.table() == {"the": 1}


def test_counts_of_no_documents(spark):
    assert counting.token_counts(small.table(spark, []), WORDS, 5).collect() == []


LABELS = "doc_id bigint, quality int, toxic int, mask int, part string"


def audit_by_hand(rows, labels):
    """Apply the filters one by one, in every order, document by document."""
    named = []
    for d, t, s in rows:
        t = t or ""
        fails = {x for i, x in enumerate("ABCD") if text_mask(t) >> i & 1}
        if d is not None and any((u or "") == t and e is not None and e < d for e, u, _ in rows):
            fails.add("E")
        told = [x for x in labels if d is not None and x[0] == d]
        named.append((s or "", fails, any(x[1] == 1 for x in told), any(x[2] == 1 for x in told)))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in named}:
            left = [x for x in named if x[0] == part]
            everyone = left
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                out[part, order, step] = (
                    len(left),
                    len(gone),
                    sum(letter in x[1] for x in everyone) - len(gone),
                    sum(x[1] == {letter} for x in everyone),
                    sum(x[2] for x in gone),
                    sum(x[3] for x in gone),
                )
                shapley[part, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_by_hand(spark):
    draw = random.Random(4)
    texts = [small.words(250), small.words(60), "THE BIG " * 120, "a | b " * 150, "same words " * 101, ""]
    rows = small.AWKWARD + [(20 + i // 2, draw.choice(texts), draw.choice("ab")) for i in range(60)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 60, 2)]
    labels += [(21, 1, 0), (21, 0, None), (None, 1, 1)]
    told = spark.createDataFrame([(*x, 0, "p") for x in labels], LABELS)
    df = filter_audit(small.table(spark, rows), told)
    got = {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIGURES) + (r.shapley,) for r in df.collect()}
    assert got == audit_by_hand(rows, labels)


def test_filter_masks():
    assert text_mask("") == 0b0001
    assert text_mask(small.words(200)) == 0
    assert text_mask("a " * 200) == 0b0010
    assert text_mask(small.words(199) + "\xa0x") == 0b0001  # no blank of ASCII
    assert text_mask(small.words(200) + " " + "ABCDEFGHIJKLMNOPQRSTUVWXYZ") == 0b0100
    assert text_mask(small.words(200) + " ÄÖÜ" * 40 + " 1|2") == 0b1000


def test_filter_audit_of_no_documents(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit(small.table(spark, []), labels).collect() == []
    assert filter_audit(small.table(spark, [(1, None, None)]), labels).count() == 600


def test_audit_of_many_parts_and_other_letters(spark):
    """More rows than the recursion may have by default, and the setting as it was afterwards."""
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "500")
    try:
        failed = spark.range(90).select(
            "id", (F.col("id") % 30).cast("string").alias("part"), (F.col("id") % 8).cast("int").alias("mask")
        )
        cells = mask_cells(failed.withColumnRenamed("id", "doc_id"), spark.createDataFrame([], LABELS))
        rows = audit_orders(cells, "XYZ")
        assert rows.count() == 30 * 6 * 3
        shares = rows.select("part", "filter_order", "removed").groupBy("part", "filter_order").agg(F.sum("removed"))
        failing = {r[0]: r[1] for r in failed.filter("mask > 0").groupBy("part").count().collect()}
        assert all(r[2] == failing.get(r[0], 0) for r in shares.collect())
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "500"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_copies_fail_against_the_smallest_id_of_all_parts(spark):
    rows = [(3, "x", "a"), (1, "x", "b"), (1, "x", "c"), (None, "x", "a"), (4, "", "a"), (5, None, "b")]
    masks = {(r.doc_id, r.part): r.mask >> 4 for r in failed_filters(small.table(spark, rows)).collect()}
    assert masks == {(3, "a"): 1, (1, "b"): 0, (1, "c"): 0, (None, "a"): 0, (4, "a"): 0, (5, "b"): 1}


def test_filter_audit_sql(spark):
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    wanted = connection.execute(FILTER_AUDIT)
    names = [c[0] for c in wanted.description]
    got = [tuple(r) for r in QUERIES["op13_filter_audit"](spark, SF).select(*names).collect()]
    assert sorted(got) == sorted(wanted.fetchall())

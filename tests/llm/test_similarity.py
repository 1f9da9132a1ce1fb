import random
import time
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import docs as small
from ordersight.llm import ngram_join
from ordersight.llm.components import components
from ordersight.llm.embed_dedup import embedding_links, hadamard
from ordersight.llm.ngram_join import FEW, PAIR, SLICE, jaccard_groups, keep_one_of_each, meet, send
from ordersight.llm.shingles import from_bytes, similar, signatures, to_bytes
from ordersight.llm.store import forget, stored


def joined(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(40)] + [(None, 3), (7, 7)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    real = [(a, b) for a, b in edges if a is not None]
    assert {r.node: r.component for r in got} == joined({x for e in real for x in e}, real)
    assert len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 40), 60, 150, 700]:
        for _ in range(12):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            drop, add = rng.integers(0, size // 3 + 1, 2)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            a = np.unique(a)
            if len(b) and similar(a, b, percent):
                assert set(signatures(a, percent)) & set(signatures(b, percent))


def test_element_bytes():
    a = np.sort(np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64))
    assert (from_bytes(to_bytes(a)) == a >> np.uint64(16)).all()


def test_a_bucket_needs_little_more_than_its_signatures():
    rng = np.random.default_rng(8)
    few, crowded = rng.integers(0, 2**48, (2, 60), dtype=np.uint64)
    rows, held = [], defaultdict(set)
    for number in (3, 7, *range(20, 38)):
        own = np.unique(rng.integers(0, 2**48, 20_000, dtype=np.uint64))
        own = np.concatenate([own, crowded, few if number < 30 else few[:0]])
        places = rng.integers(0, SLICE, len(own)).astype("<u2")
        rows.append((0, number, to_bytes(own << np.uint64(16)), places.tobytes()))
        for sig, place in zip(own.tolist(), places.tolist()):
            held[sig].add(number * SLICE + place)
    sent = pd.DataFrame(rows, columns=["bucket", "slice", "sigs", "places"])
    pairs = {(a, b) for nodes in held.values() if len(nodes) <= FEW for a in nodes for b in nodes if a < b}
    many = {a for nodes in held.values() if len(nodes) > FEW for a in nodes}
    tracemalloc.start()
    got = meet(sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    paired = got["kind"] == PAIR
    found = list(zip(got["a"][paired], got["b"][paired]))
    assert len(found) == len(pairs) and set(found) == pairs
    assert sorted(got["a"][~paired]) == sorted(many)
    assert peak < 4 * sum(len(r[2]) + len(r[3]) for r in rows)


def test_slices_do_not_depend_on_batches():
    texts = [small.words(20 + i % 50, start=i % 700) if i % 9 else None for i in range(SLICE + 1500)]
    ids = list(range(len(texts)))
    table = pa.RecordBatch.from_pydict({"slice": [i // SLICE for i in ids], "id": ids, "text_hash": ids, "text": texts})
    cuts = [0, 0, 700, 3000, 5000, len(texts)]
    parts = [table.slice(x, y - x) for x, y in zip(cuts, cuts[1:])]
    tracemalloc.start()
    found = [row for b in send(iter(parts), 5, 80, 3) for row in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [row for b in send(iter([table]), 5, 80, 3) for row in b.to_pylist()]
    assert peak < 5 * sum(len(row["sigs"] + row["places"]) for row in found)


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def near_copies():
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows, n = [], 100
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 30])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text), "a"))
            n += 1
    for _ in range(40):  # unrelated, but for a passage
        own = [rng.choice(vocabulary) for _ in range(rng.choice([5, 15, 60]))]
        rows.append((n, " ".join(passage + own), "a"))
        n += 1
    return rows + [(n + 1, rows[0][1].upper(), "b"), (n + 2, "one two", "b"), (n + 3, "One  TWO", "b")]


def test_jaccard_groups(spark):
    rows = near_copies() + small.AWKWARD
    got = jaccard_groups(small.table(spark, rows).repartition(3)).collect()
    sets = {d: shingles(t) for d, t, _ in rows if d is not None}
    ids = list(sets)
    linked = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    group = joined(ids, linked)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), group[r.doc_id])
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (1, None)]
    kept = keep_one_of_each(small.table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(group.values()))


def test_no_text_of_a_repeated_id_is_lost(spark):
    rows = [
        (1, small.words(40), "a"),
        (1, small.words(40, start=500), "a"),  # unrelated
        (1, small.words(41), "b"),  # near the first
        (2, small.words(42), "a"),  # near the first
        (3, "", "a"),
        (3, None, "a"),
        (3, "", "b"),
        (None, small.words(40), "a"),
    ]
    kept = sorted((r.doc_id or 0, r.text or "") for r in keep_one_of_each(small.table(spark, rows)).collect())
    assert [d for d, _ in kept] == [0, 1, 1, 3, 3, 3]
    texts = [t for d, t in kept if d == 1]
    assert rows[1][1] in texts and len({rows[0][1], rows[2][1]} & set(texts)) == 1


def test_jaccard_of_nothing(spark):
    assert jaccard_groups(small.table(spark, [])).count() == 0
    assert keep_one_of_each(small.table(spark, [])).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1):
        for size in (1, 1, 2, 5, 150):
            centre = rng.normal(size=24)
            for _ in range(size):
                noise = rng.normal(size=24) * np.linalg.norm(centre) * 0.02
                rows.append((n, [float(v) for v in centre + noise], label))
                n += 1
    rows += [(n + i, rows[3][1], rows[3][2]) for i in range(3)]
    n += 3
    odd = [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] + [0.0] * 23]
    bad = [(n + i, v, 0) for i, v in enumerate(odd)]
    bad += [(n + 10, rows[0][1], None), (None, rows[0][1], 0), (n + 11, [1.0, 2.0], 0)]
    schema = "vec_id bigint, embedding array<double>, label int"
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows + bad, schema)).collect()}
    assert len(got) == len(rows) + len(bad)
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([x for *_, x in rows])
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    found = sum(got[i].n_links for i, *_ in rows)
    assert 0.97 * close.sum() <= found <= close.sum()
    group = joined([i for i, *_ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(close))])
    assert sum(got[i].component_id == group[i] for i, *_ in rows) >= 0.97 * len(rows)
    for i, _, _ in bad:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, i is not None)
    assert embedding_links(spark.createDataFrame([], schema)).count() == 0


def test_copies_are_not_paired_anew_in_every_bucket(spark, monkeypatch):
    rows = []
    for family in range(10):
        base = small.words(150, start=200 * family).split()
        for copy in range(12):
            rows.append((100 * family + copy, " ".join([*base, f"copy{copy}"]), "a"))
    written = {}

    def counted(df, name, real=ngram_join.stored):
        out = real(df, name)
        written.setdefault(name, out.count())
        return out

    monkeypatch.setattr(ngram_join, "SLICE", 2)  # slices and buckets as in a much larger table
    monkeypatch.setattr(ngram_join, "stored", counted)
    got = jaccard_groups(small.table(spark, rows).repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d // 100 * 100 for d, _, _ in rows}
    assert written["jaccard-found"] < 10 * len(rows)


def test_a_common_passage_alone_makes_no_candidates():
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    sets = []
    for size in [20, 20, 300, 300, 300, 5000]:
        passage = draw(size // 2)
        for copies in (1, 1, 3):
            base = np.concatenate([passage, draw(size - size // 2)])
            for _ in range(copies):
                own = np.concatenate([base[: size - size // 20], draw(size // 20)])
                sets.append(np.unique(own))
    rows = pd.DataFrame({"key": range(len(sets)), "n": [len(x) for x in sets], "cell": 0, "low": 0, "high": 0})
    rows["fine"] = [ngram_join.histogram(x, ngram_join.fine_cells(len(x))) for x in sets]
    got = ngram_join.block_candidates(rows, 80)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    linked = [p for p in pairs if similar(sets[p[0]], sets[p[1]], 80)]
    assert linked
    assert joined(range(len(sets)), got.itertuples(index=False)) == joined(range(len(sets)), linked)
    across = ngram_join.block_candidates(rows.assign(cell=[i % 2 for i in range(len(sets))], high=1), 80)
    apart = [(a, b) for a, b in linked if a % 2 != b % 2]
    assert joined(range(len(sets)), across.itertuples(index=False)) == joined(range(len(sets)), apart)


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    df = spark.range(5000).repartition(5, "id").selectExpr("id", "uuid() AS u")
    before = disk.getAllFiles().size()
    table = stored(df, "shuffled")
    until = time.time() + 20
    while disk.getAllFiles().size() > before and time.time() < until:
        time.sleep(0.1)
    assert disk.getAllFiles().size() <= before
    assert table.count() == 5000
    forget(table)
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(table.inputFiles()[0]).count()

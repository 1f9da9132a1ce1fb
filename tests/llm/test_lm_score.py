import math
import zlib
from collections import Counter

import numpy as np
import pytest

import docs as small
from ordersight.llm.lm_score import BETAS, from_six_bytes, from_small, lm_score, six_bytes, small as packed


def by_hand(rows, order, mass):
    counts = [Counter() for _ in range(order)]
    texts = []
    for d, t, _ in rows:
        words = (t or "").encode().lower().split() + [b"\n"]
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        texts.append((d, words, held))
        padded = [b"^"] * (order - 1) + words
        if not held:
            for i in range(order - 1, len(padded)):
                for n in range(order):
                    counts[n][tuple(padded[i - n : i + 1])] += 1
    total, types, documents = sum(counts[0].values()), len(counts[0]), counts[0][(b"\n",)]
    sums = [sum(c**b for c in counts[0].values()) for b in BETAS]
    beta = float(np.interp(len(counts[1]), sums, BETAS)) if order > 1 else 1.0

    def prob(word, context):
        if not context:
            return (counts[0][(word,)] + 1) / (total + types + 1)
        shorter = prob(word, context[1:])
        seen = documents if set(context) == {b"^"} else counts[len(context) - 1][context]
        back = mass * seen**beta
        return (counts[len(context)][(*context, word)] + back * shorter) / (seen + back) if seen else shorter

    out = []
    for d, words, held in texts:
        padded = [b"^"] * (order - 1) + words
        score = sum(
            math.log10(prob(padded[i], tuple(padded[i - order + 1 : i]))) for i in range(order - 1, len(padded))
        )
        base = sum(math.log10(prob(w, ())) for w in words)
        known = sum(counts[0][(w,)] > 0 for w in words)
        out.append((d, held, len(words), known, total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("slice_rows", [3, 4096])
def test_scores(spark, order, slice_rows):
    rows = small.AWKWARD + [(i, small.words(i % 9, i % 4) + " the The end", "a") for i in range(100, 140)]
    docs = small.table(spark, rows).coalesce(2)
    got = sorted(map(tuple, lm_score(docs, order=order, slice_rows=slice_rows).collect()), key=str)
    want = sorted(by_hand(rows, order, 3.0), key=str)
    assert [r[:5] for r in sorted(got, key=lambda r: (str(r[0]), r[2]))] == [
        r[:5] for r in sorted(want, key=lambda r: (str(r[0]), r[2]))
    ]
    for g, w in zip(
        sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2]))
    ):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_scores_of_nothing(spark):
    assert lm_score(small.table(spark, [])).count() == 0


def test_the_model_beats_its_base_on_held_out_texts(spark):
    held = lm_score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out")
    score, base = held.selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base


def test_packed_numbers():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**48, 99, dtype=np.uint64))
    assert (from_six_bytes(six_bytes(keys)) == keys).all()
    for top in (3, 300, 70_000, 2**40):
        assert from_small(packed(np.array([0, top]))).tolist() == [0, top]

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordersight.operators import cut_to_ranks, global_rank, rank_table, top_k, with_group_sizes

SCHEMA = "id int, g string, v decimal(10,2)"


def frame(spark, *vs, g="a"):
    return spark.createDataFrame(
        [(i, g, None if v is None else Decimal(v)) for i, v in enumerate(vs)], SCHEMA
    )


def ranked(df, name="rnk"):
    return sorted((r.id, r[name]) for r in df.collect())


def reference_ranks(vs, dense=False, nulls_first=True):
    """Rank by definition: one more than the rows (or distinct values) ahead."""

    def ahead(a, b):
        if b is None:
            return False if a is None else not nulls_first
        if a is None:
            return nulls_first
        return a > b

    others = set(vs) if dense else vs
    return [1 + sum(ahead(a, b) for a in others) for b in vs]


def test_null_ranks_first_when_descending_unless_told(spark):
    df = frame(spark, 5, 3, None)
    assert ranked(top_k(df, "v", 2)) == [(0, 2), (2, 1)]
    assert ranked(top_k(df, "v", 2, nulls="last")) == [(0, 1), (1, 2)]


def test_rank_and_dense_rank_differ_after_a_tie(spark):
    df = frame(spark, 9, 9, 8, 7)
    assert ranked(top_k(df, "v", 4)) == [(0, 1), (1, 1), (2, 3), (3, 4)]
    assert ranked(top_k(df, "v", 3)) == [(0, 1), (1, 1), (2, 3)]
    assert ranked(top_k(df, "v", 2, ties="dense")) == [(0, 1), (1, 1), (2, 2)]


def test_limit_cuts_a_tie_and_rank_keeps_it(spark):
    df = frame(spark, 4, 4, 1)
    assert [r.id for r in top_k(df, "v", 1, ties="none", tie_break=["id"]).collect()] == [0]
    assert ranked(top_k(df, "v", 1)) == [(0, 1), (1, 1)]


def test_ascending_puts_null_last(spark):
    assert ranked(top_k(frame(spark, 2, None, 1), "v", 1, descending=False)) == [(2, 1)]


def test_within_groups_including_the_null_group(spark):
    rows = [(0, "x", 5), (1, "x", 5), (2, "y", 1), (3, "y", None), (4, None, 7), (5, None, 8)]
    df = spark.createDataFrame(
        [(i, g, None if v is None else Decimal(v)) for i, g, v in rows], SCHEMA
    )
    assert ranked(top_k(df, "v", 1, within=["g"])) == [(0, 1), (1, 1), (3, 1), (5, 1)]
    cut = top_k(df, "v", 1, within=["g"], ties="none", tie_break=["id"])
    assert sorted(r.id for r in cut.collect()) == [0, 3, 5]


def test_rank_table_stays_small_however_many_rows_tie(spark):
    df = spark.range(5000).selectExpr("cast(id as int) id", "'a' g", "cast(id % 3 as long) v")
    table = rank_table(df, "v", 2, ties="rank")
    assert [tuple(r) for r in table.collect()] == [(2, 1)]
    assert top_k(df, "v", 1).count() == 1666


def test_weight_counts_a_row_as_many(spark):
    df = spark.createDataFrame([(9, 4), (8, 7), (7, 1)], "v int, w int")
    assert [tuple(r) for r in rank_table(df, "v", 5, weight="w").orderBy("v").collect()] == [
        (8, 5),
        (9, 1),
    ]


VALUES = st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=1, max_size=25)


@settings(max_examples=12, deadline=None)
@given(VALUES, st.integers(1, 5), st.booleans(), st.booleans())
def test_top_k_follows_the_definition(spark, vs, k, dense, nulls_first):
    got = top_k(
        frame(spark, *vs),
        "v",
        k,
        ties="dense" if dense else "rank",
        nulls="first" if nulls_first else "last",
    )
    want = reference_ranks(vs, dense, nulls_first)
    assert ranked(got) == [(i, r) for i, r in enumerate(want) if r <= k]


@pytest.mark.parametrize("descending", [True, False])
def test_global_rank_across_partitions(spark, descending):
    generator = random.Random(3)
    vs = [generator.choice([None, *range(400)]) for _ in range(3000)]
    # A third of all rows share one value.
    vs += [77] * 1500
    generator.shuffle(vs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(global_rank(frame(spark, *vs), "v", descending=descending))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    if descending:
        want = reference_ranks(vs)
    else:
        want = reference_ranks([None if v is None else -v for v in vs], nulls_first=False)
    assert got == list(enumerate(want))


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.none() | st.integers(0, 6), max_size=20), st.integers(1, 5), st.booleans(), st.booleans()
)
def test_a_cut_keeps_what_the_ranks_keep(spark, vs, k, descending, nulls_first):
    df = frame(spark, *vs)
    how = {"descending": descending, "nulls": "first" if nulls_first else "last"}
    kept = cut_to_ranks(df, rank_table(df, "v", k, **how), "v", descending=descending)
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in top_k(df, "v", k, **how).collect())


def test_group_sizes_count_null_and_empty_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "a"), (5, None), (6, None)], "id int, g string")
    rows = with_group_sizes(df, n="g", same="id").orderBy("id").collect()
    assert [r.n for r in rows] == [2, 3, 1, 2, 3, 3] and all(r.same == 1 for r in rows)
    assert df.columns + ["n", "same"] == rows[0].__fields__

"""Marts: distinct counts that roll up, and month-wise refreshing that leaves other months alone."""

import pathlib
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordersight.operators import count_members, member_bitmaps
from ordersight.plans import business_review
from ordersight.plans.marts import build_marts, kpis_from_marts, read_marts, write_marts
from ordersight.sources import (
    overwrite_months,
    read_clean,
    refresh_late,
    refresh_months,
    star_tables,
    write_clean,
)
from small import table, tables, values

JAN, FEB, MAR = date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)
ORDERS = [
    {"order_id": 1, "order_date": "2024-01-10", "customer_id": 7},
    {"order_id": 2, "order_date": "2024-01-11", "customer_id": 7},
    {"order_id": 3, "order_date": "2024-02-10", "customer_id": 8, "order_amount": None},
    {"order_id": 4, "order_date": "2024-02-11", "customer_id": 7, "restaurant_id": 99},
    {"order_id": 5, "order_date": "soon", "customer_id": None},
    {"order_id": 6, "order_date": "2024-03-11", "customer_id": 9, "status": "cancelled"},
]


def files(root):
    """Data files by month folder, with when they were written."""
    found = sorted(pathlib.Path(root).rglob("*.parquet"))
    return {(f.parent.name, f.name, f.stat().st_mtime_ns) for f in found}


def months(listing, *names):
    return {x for x in listing if x[0] in {f"order_month={n}" for n in names}}


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(1, 3),
            st.none() | st.integers(-3, 3) | st.integers(-(2**62), 2**62) | st.integers(32766, 32770),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_bitmaps_count_like_sets(spark, rows):
    df = spark.createDataFrame(rows, "k int, id bigint")
    bitmaps = member_bitmaps(df, ["k"], "id")
    everyone = count_members(bitmaps, [])
    assert (values(everyone) or [(None,)])[0][0] == (len({i for _, i in rows if i is not None}) or None)
    per_key = dict(values(count_members(bitmaps, ["k"])))
    sets = {k: {i for j, i in rows if j == k and i is not None} for k, _ in rows}
    assert per_key == {k: len(ids) for k, ids in sets.items() if ids}


def test_identifiers_are_gathered_before_bitmaps_are_made(spark, capsys):
    """Bitmaps of 4 KB are neither shuffled nor sorted to build them."""
    df = spark.createDataFrame([(1, 5), (1, 5), (2, None), (None, 7)], "k int, id bigint")
    bitmaps = member_bitmaps(df, ["k"], "id")
    bitmaps.explain()
    plan = capsys.readouterr().out
    assert plan.rindex("bitmap_construct_agg") < plan.index("Exchange") and plan.count("Exchange") == 1
    assert sorted(values(bitmaps.select("k", F.bitmap_count("members"))), key=str) == [(1, 1), (2, 0), (None, 1)]


def test_kpis_from_stored_marts(spark, tmp_path):
    t = tables(spark, orders=ORDERS)
    write_marts(build_marts(t), str(tmp_path))
    marts = read_marts(spark, str(tmp_path))
    by_month = kpis_from_marts(marts, "month").orderBy(F.col("period").asc_nulls_last())
    assert values(by_month) == values(business_review.monthly_kpis(t)) == [
        (JAN, 200.0, 2, 100.0, 1),
        (FEB, 100.0, 2, 100.0, 2),
        (None, 100.0, 1, 100.0, 0),
    ]
    yearly = kpis_from_marts(marts.__class__(marts.sales.filter("order_month is not null"), marts.active), "year")
    assert values(yearly) == [(JAN, 300.0, 4, 100.0, 2)]
    by_city = kpis_from_marts(marts, "quarter", "city_key")
    assert sorted(values(by_city), key=str) == sorted(
        [(JAN, "chennai", 200.0, 3, 100.0, 2), (JAN, None, 100.0, 1, 100.0, 1), (None, "chennai", 100.0, 1, 100.0, 0)],
        key=str,
    )


@pytest.mark.parametrize("grain", ["week", "year"])
def test_marts_agree_with_the_facts_at_other_grains(spark, grain):
    t = star_tables(spark, "/root/testdata/sf0.001")
    plain = values(business_review.kpis_by_period(t, grain))
    assert sorted(values(kpis_from_marts(build_marts(t), grain)), key=str) == sorted(plain, key=str)


def test_refreshing_a_month_leaves_the_others(spark, tmp_path):
    t = tables(spark, orders=ORDERS)
    root = str(tmp_path)
    write_clean(t, root)
    before, rows = files(tmp_path), sorted(values(read_clean(spark, root).orders), key=str)
    for _ in range(2):
        refresh_months(t, root, [FEB])
        assert sorted(values(read_clean(spark, root).orders), key=str) == rows
        after = files(tmp_path)
        assert before - after == months(before, FEB) and after - before == months(after, FEB)
    refresh_months(t, root, [None])
    assert sorted(values(read_clean(spark, root).orders), key=str) == rows


def test_late_orders_reopen_their_months_only(spark, tmp_path):
    root = str(tmp_path)
    write_clean(tables(spark, orders=ORDERS), root)
    before = files(tmp_path)
    late = [
        {"order_id": 10, "order_date": "2024-01-31"},
        {"order_id": 11, "order_date": "2024-04-02"},
        {"order_id": 12, "order_date": "never"},
    ]
    all_orders = tables(spark, orders=ORDERS + late)
    reopened = refresh_late(all_orders, table(spark, "orders", late), root)
    assert set(reopened) == {JAN, date(2024, 4, 1), None}
    after = files(tmp_path)
    assert months(before, FEB, MAR) == months(after, FEB, MAR)
    assert {x for x in before if "order_month" not in x[0]} == {x for x in after if "order_month" not in x[0]}
    assert sorted(values(read_clean(spark, root).orders), key=str) == sorted(values(all_orders.orders), key=str)


def test_an_emptied_month_is_left_empty(spark, tmp_path):
    root = str(tmp_path)
    t = tables(spark, orders=ORDERS)
    write_clean(t, root)
    cancelled = t.with_orders(lambda o: o.filter("order_month > '2024-01-01'"))
    refresh_months(cancelled, root, [JAN, None])
    left = read_clean(spark, root).orders
    assert sorted(values(left, "order_id")) == [(3,), (4,), (6,)]
    refresh_months(t, root, [JAN, None])
    assert read_clean(spark, root).orders.count() == len(ORDERS)


def test_marts_refresh_by_month(spark, tmp_path):
    root = str(tmp_path)
    write_marts(build_marts(tables(spark, orders=ORDERS)), root)
    before = files(tmp_path)
    more = build_marts(tables(spark, orders=[*ORDERS, {"order_id": 20, "order_date": "2024-02-20", "customer_id": 1}]))
    for _ in range(2):
        write_marts(more, root, [FEB])
        kpis = dict((v[0], v[1:]) for v in values(kpis_from_marts(read_marts(spark, root), "month")))
        assert kpis[FEB] == (200.0, 3, 100.0, 3) and kpis[JAN] == (200.0, 2, 100.0, 1)
    after = files(tmp_path)
    assert before - after == months(before, FEB) and after - before == months(after, FEB)


def test_nothing_asked_changes_nothing(spark, tmp_path):
    t = tables(spark, orders=ORDERS)
    write_clean(t, str(tmp_path))
    before = files(tmp_path)
    overwrite_months(t.orders, f"{tmp_path}/orders", "order_month", [])
    assert files(tmp_path) == before

"""Figures behind the questions: fits, days, missing amounts and a city's decline."""

import math
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordersight.operators import linear_fit
from ordersight.plans import business_review, operations, revenue
from small import tables, values


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-50, 50), st.none() | st.decimals(0, 5, places=2)), max_size=25))
def test_linear_fit_is_the_textbook_one(spark, pairs):
    df = spark.createDataFrame(pairs, "x int, y decimal(4,2)")
    n, slope, correlation = values(linear_fit(df, "x", "y"))[0]
    known = [(x, float(y)) for x, y in pairs if x is not None and y is not None]
    assert n == len(known)
    xs, ys = (np.array(v, float) for v in zip(*known)) if known else (np.zeros(0), np.zeros(0))
    if n == 0 or np.ptp(xs) == 0:
        assert slope is None and correlation is None
        return
    assert slope == pytest.approx(np.polyfit(xs, ys, 1)[0], abs=6e-5)
    if np.ptp(ys) == 0:
        assert correlation is None
    else:
        assert correlation == pytest.approx(np.corrcoef(xs, ys)[0, 1], abs=1e-9)


def test_busier_agents_rated_lower(spark):
    agents = [{"agent_id": i} for i in (1, 2, 3)]
    rows = [(1, 5), (2, 4), (2, 4), (3, 3), (3, 3), (3, 3), (9, 1)]
    deliveries = [{"agent_id": a, "delivery_rating": r} for a, r in rows]
    t = tables(spark, delivery_agents=agents, deliveries=deliveries)
    n, slope, correlation = values(operations.load_vs_rating_fit(t))[0]
    assert (n, slope) == (3, -1.0) and math.isclose(correlation, -1)


def test_speed_against_rating_counts_an_order_once(spark):
    orders = [{"order_id": i, "delivery_time_minutes": m} for i, m in ((1, 20), (2, 40), (3, None), (4, 60))]
    deliveries = [{"order_id": o, "delivery_rating": r} for o, r in ((1, 5), (1, 4), (2, 4), (3, 1), (4, None))]
    fit = operations.speed_vs_rating_fit(tables(spark, orders=orders, deliveries=deliveries))
    assert values(fit) == [(2, -0.025, -1.0)]


def test_weekend_days_against_weekdays(spark):
    days = ["2024-01-05", "2024-01-05", "2024-01-08", "2024-01-06", "2024-01-06", "2024-01-06", "unknown"]
    orders = [{"order_date": d, "order_amount": a} for d, a in zip(days, (100, 50, None, 10, 20, 30, 999))]
    rows = dict((r[0], r[1:]) for r in values(revenue.weekday_weekend_per_day(tables(spark, orders=orders))))
    assert rows == {"weekday": (2, 1.5, 75.0, 75.0), "weekend": (1, 3.0, 60.0, 20.0)}


def test_missing_revenue_under_each_policy(spark):
    amounts = [(1, 100), (1, 51), (1, None), (2, 10), (3, None), (None, None), (None, 9)]
    orders = [{"restaurant_id": r, "order_amount": a} for r, a in amounts]
    (row,) = values(revenue.missing_revenue_policies(tables(spark, orders=orders)))
    assert row == (170.0, 3, 42.86, 1, 170 + 75.5 + 9, 170 + 3 * 42.5)


def test_a_citys_decline_by_restaurant(spark):
    places = [{"restaurant_id": 1}, {"restaurant_id": 2}, {"restaurant_id": 3, "city": "Madurai"}]
    rows = [(1, "01", 100), (1, "01", 50), (1, "03", None), (2, "03", 30), (2, "01", 130), (2, "01", 1), (3, "01", 7)]
    orders = [
        {"restaurant_id": r, "order_date": f"2024-{m}-09", "order_amount": a} for r, m, a in rows
    ] + [{"order_date": "2024-02-09"}]
    t = tables(spark, orders=orders, restaurants=places)
    decline = business_review.city_decline_by_restaurant(t, first=date(2024, 1, 1), last=date(2024, 3, 1))
    assert [(r[0], *r[2:]) for r in values(decline)] == [
        (1, 1, 50.0, 150.0, 59.76),
        (2, 1, 50.0, 101.0, 40.24),
    ]
    assert Decimal("59.76") + Decimal("40.24") == 100

from datetime import date

import pytest

from ordersight.operators import distinct_in_periods, period_growth, spikes
from ordersight.plans import business_review, customers, revenue
from small import tables, values

QUARTER = [("2024-01-05", 22140), ("2024-02-05", 20840), ("2024-03-05", 13715)]


def test_average_skips_missing_amount_but_count_does_not(spark):
    known = [{"order_amount": 13715 - 18 * 700}] + [{"order_amount": 700}] * 18
    t = tables(spark, orders=known + [{"order_amount": None}])
    month = values(business_review.monthly_kpis(t))
    assert month == [(date(2024, 1, 1), 13715.0, 20, 721.84, 1)]


def test_growth_of_the_quarter(spark):
    t = tables(spark, orders=[{"order_date": d, "order_amount": a} for d, a in QUARTER])
    growth = values(business_review.monthly_growth(t), "growth_rate_pct")
    assert growth == [(None,), (-5.87,), (-34.19,)]
    labelled = values(revenue.growth_labelled(t))
    assert labelled[0] == (None, None)
    assert [c for c, _ in labelled[1:]] == ["jan-feb", "feb-march"]
    assert labelled[1][1] == pytest.approx(-100 * 1300 / 22140)


def test_growth_after_a_zero_is_unknown(spark):
    df = spark.createDataFrame([(1, 0), (2, 5)], "p int, v int")
    assert values(period_growth(df, "p", "v"), "growth_rate_pct") == [(None,), (None,)]


def test_months_of_different_years_stay_apart(spark):
    t = tables(
        spark, orders=[{"order_date": "2023-01-05"}, {"order_date": "2024-01-09"}]
    )
    assert values(revenue.monthly_revenue(t)) == [("Jan", 100.0), ("Jan", 100.0)]


def test_driver_changes(spark):
    orders = [
        {"order_date": "2024-01-03", "order_amount": 100},
        {"order_date": "2024-01-04", "order_amount": 200},
        {"order_date": "2024-02-03", "order_amount": 90},
    ]
    rows = values(business_review.driver_decomposition(tables(spark, orders=orders)))
    assert rows[1][1:] == (90.0, 1, 90.0, -210.0, -1, -60.0)


def test_concentration_of_the_decline(spark):
    lost = {"c": (12, 5), "d": (3, 2), "e": (4, 2)}
    orders, places = [], []
    for i, (city, (before, after)) in enumerate(lost.items(), start=1):
        places.append({"restaurant_id": i, "city": city.upper()})
        orders += [{"restaurant_id": i, "order_date": "2024-01-08"}] * before
        orders += [{"restaurant_id": i, "order_date": "2024-03-08"}] * after
    t = tables(spark, orders=orders, restaurants=places)
    rows = values(business_review.decline_concentration(t), "region", "order_loss_pct")
    assert rows == [("c", 70.0), ("e", 20.0), ("d", 10.0)]


def test_spike_compares_active_days_and_lists_calendar_neighbours(spark):
    orders = [
        {"order_date": "2024-01-01", "order_amount": 10},
        {"order_date": "2024-01-02", "order_amount": 20},
        {"order_date": "2024-01-05", "order_amount": 50},
    ]
    rows = values(revenue.revenue_spikes(tables(spark, orders=orders)))
    by_day = {}
    for row in rows:
        by_day.setdefault(row[0].day, []).append((row[1], row[3], row[4], row[5].day))
    assert by_day == {
        1: [(None, None, None, 1)],
        2: [(10.0, 10.0, 100.0, 1), (10.0, 10.0, 100.0, 2)],
        5: [(20.0, 30.0, 150.0, 5)],
    }
    assert [r[0].day for r in rows] == [5, 2, 2, 1]


def test_spikes_can_be_cut_at_a_rank(spark):
    orders = [{"order_date": f"2024-01-0{i}", "order_amount": i * i} for i in range(1, 7)]
    t = tables(spark, orders=orders)
    top = spikes(t.orders, "order_dt", "restaurant_id", k=1)
    assert {r.spike_date.day for r in top.collect()} == {2}


def test_an_identifier_counts_once_a_period(spark):
    day = date(2024, 1, 1)
    rows = [("a", day, 1, 2), ("a", day, 1, 3), ("a", day, 2, None), ("b", None, 3, 4)]
    df = spark.createDataFrame(rows, "k string, m date, id int, v int")
    counted = distinct_in_periods(df, ["k"], "m", {"january": day}, "id", ["v"])
    assert sorted(values(counted, "k", "v", "january")) == [("a", 5, 2), ("b", 4, 0)]


def test_weekday_weekend(spark):
    days = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"]
    t = tables(spark, orders=[{"order_date": d, "order_amount": a} for a, d in enumerate(days)])
    assert sorted(values(revenue.weekday_weekend(t))) == [
        ("weekday", 2, 3.0, 1.5),
        ("weekend", 2, 3.0, 1.5),
    ]


def test_city_frequency(spark):
    orders = [{"customer_id": 1}, {"customer_id": 1}, {"customer_id": 2}, {"restaurant_id": 2}]
    places = [{"city": " CHENNAI"}, {"city": "Madurai"}]
    t = tables(spark, orders=orders, restaurants=places)
    assert values(business_review.city_frequency(t)) == [(date(2024, 1, 1), 2, 3, 1.5)]


def test_clean_and_naive_growth(spark):
    orders = [
        {"order_date": "2024-01-05", "order_amount": 100},
        {"order_date": "2024-02-05", "order_amount": 50},
        {"order_date": "2024-02-06", "order_amount": 100, "status": "CANCELLED "},
    ]
    rows = values(revenue.growth_clean_vs_naive(tables(spark, orders=orders)))
    assert rows[1][1:] == (150.0, 50.0, 50.0, -50.0)


def test_spike_drivers_tell_volume_from_value(spark):
    orders = [
        {"order_date": "2024-01-03", "order_amount": 100},
        {"order_date": "2024-01-05", "order_amount": 80},
        {"order_date": "2024-01-05", "order_amount": 70},
        {"order_date": None, "order_amount": 9},
    ]
    out = values(revenue.revenue_spike_drivers(tables(spark, orders=orders)))
    assert out[0][0] == date(2024, 1, 3) and out[0][1:3] == (1, 100.0)
    assert out[0][3:] == (None,) * 6
    assert out[1] == (date(2024, 1, 5), 2, 150.0, 1, 100.0, 1, 100.0, 50.0, 50.0)


def test_flagged_customers_exceed_the_exact_share(spark):
    rows = [("1", "cancelled")] * 3 + [("1", "delivered")] + [("2", "cancelled")] * 4
    orders = [{"customer_id": int(c), "status": s} for c, s in rows]
    t = tables(spark, orders=orders, customers=[{}, {}])
    flagged = customers.cancel_rate_min_orders(t, above=75)
    assert values(flagged, "customer_id", "cancellation_rate_pct") == [(2, 100)]


GAP = [
    {"order_id": 1, "order_date": "2024-01-30", "customer_id": 1},
    {"order_id": 2, "order_date": "2024-01-31", "customer_id": 1},
    {"order_id": 3, "order_date": "2024-03-05", "customer_id": 2, "order_amount": 300},
    {"order_id": 4, "order_date": "2024-04-05", "customer_id": 2, "order_amount": None},
    {"order_id": 5, "order_date": "someday"},
]


def test_growth_over_a_month_without_orders(spark):
    t = tables(spark, orders=GAP)
    assert values(business_review.growth_by_period(t, "month")) == [
        (date(2024, 1, 1), 200.0, 2, None),
        (date(2024, 2, 1), 0.0, 0, -100.0),
        (date(2024, 3, 1), 300.0, 1, None),  # nothing grows from nothing
        (date(2024, 4, 1), None, 1, None),
        (None, 100.0, 1, None),
    ]
    without = values(business_review.growth_by_period(t, "month", every=False))
    assert [row[0] for row in without] == [date(2024, m, 1) for m in (1, 3, 4)] + [None]
    assert without[1] == (date(2024, 3, 1), 300.0, 1, 50.0)


@pytest.mark.parametrize(
    "grain,first,count",
    [("day", date(2024, 1, 30), 67), ("week", date(2024, 1, 29), 10), ("quarter", date(2024, 1, 1), 2),
     ("year", date(2024, 1, 1), 1)],
)
def test_every_period_of_a_grain(spark, grain, first, count):
    rows = values(business_review.kpis_by_period(tables(spark, orders=GAP), grain, every=True))
    assert rows[0][0] == first and rows[-1][0] is None and len(rows) == count + 1
    assert sum(r[2] for r in rows) == 5
    with pytest.raises(ValueError):
        business_review.kpis_by_period(tables(spark, orders=GAP), "fortnight")


def test_every_period_of_every_region(spark):
    places = [{"restaurant_id": 1}, {"restaurant_id": 2, "city": "Madurai"}]
    orders = [
        {"order_date": "2023-02-01"},
        {"order_date": "2023-08-01", "restaurant_id": 2, "order_amount": None},
    ]
    rows = values(business_review.orders_by_region_period(tables(spark, orders=orders, restaurants=places)))
    starts = [date(2023, m, 1) for m in (1, 4, 7)]
    assert rows == [("chennai", d, n, r) for d, n, r in zip(starts, (1, 0, 0), (100.0, 0.0, 0.0))] + [
        ("madurai", d, n, r) for d, n, r in zip(starts, (0, 0, 1), (0.0, 0.0, None))
    ]


def test_no_orders_make_no_periods(spark):
    t = tables(spark, orders=[{"status": "cancelled"}])
    assert values(business_review.kpis_by_period(t, "week", every=True)) == []
